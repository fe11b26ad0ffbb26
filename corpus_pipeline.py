"""A corpus pipeline of five operators; each stage gets what the one before it wrote.

Stages: language ID (texts without a language go), n-gram Jaccard join (one document of each group of near copies
stays), substring dedup (repeated passages go), mixing to target weights (documents are taken at their rates), best-fit
packing (bins of several lengths).  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tessella.llm.common import discard, mark, release, table
from tessella.llm.jaccard_join import without_near_copies
from tessella.llm.language_id import fit_language_model, identified, trainable
from tessella.llm.mixing import WEIGHTS, label_domains, mixed
from tessella.llm.packing import pack, word_counts
from tessella.llm.substring_dedup import without_repeats
from tessella.sources.shared import new_folder


#: Intermediate tables of the last stage, as marks.
_held: list[tuple[int, int]] = []


def _let_go(spark: SparkSession) -> None:
    while _held:
        discard(spark, *_held.pop())
    release(spark)


def _stage(function: Callable) -> Callable:
    """A stage begins when its predecessor's result has been written, so it lets go of that one's intermediate tables."""

    @wraps(function)
    def begun(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _let_go(spark)
        since = mark()
        out = function(spark, docs, sf_dir)
        _held.append((since, mark()))
        return out

    return begun


@_stage
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; the model learns from those that are not held out."""
    return identified(docs, fit_language_model(trainable(docs)))


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: word 5-grams, Jaccard similarity of 0.8 or more."""
    return without_near_copies(docs)


@_stage
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words or more that they repeat from earlier ones."""
    return without_repeats(docs)


@_stage
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The largest mix without repeats that has the target shares of the domains of ``labels``."""
    return mixed(docs, label_domains(table(spark, sf_dir, "labels")), WEIGHTS)


@_stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document, with its bin."""
    return pack(word_counts(docs))


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard_join", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("mixing", mixing),
    ("best_fit_packing", packing),
]

#: The first stage learns a classifier and the fourth fits rates by iteration; SQL has neither.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    base = new_folder(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    _let_go(spark)
    return docs
