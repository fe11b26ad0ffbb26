"""Token ids in Parquet list columns, with selective reads of ids and of metadata.

Texts are tokenised in ascending doc_id order and written by Spark's own Parquet writer, so the files are committed by
Hadoop's committer and survive lost executors.  Format: version 2 pages, so that integer columns without a dictionary
are delta encoded; a dictionary for the ids of a list column where asked for; row groups and pages of stated sizes;
column and offset indexes, which Parquet's writer adds to every column.  A reader that selects doc_id and n_tokens, or
a range of doc_id, reads no token pages of others.

Tokenising goes by white-space separated chunks, each distinct one encoded once per worker with the tokenizers
library: ``exact_by_chunk`` says for which tokenizers a text's ids are the ids of its chunks, and others encode whole
texts.

Null texts are empty and have the end id alone.  Ties in doc_id are ordered by text; null ids come first.  An empty
table gives files without rows.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.sources.shared import new_folder

from .common import map_arrow, steps
from .ordering import part_of, splitters

#: Bytes of a row group and of a page, before compression.
ROW_GROUP, PAGE = 32 << 20, 256 << 10
END_ID = 1
#: Distinct chunks whose ids a worker remembers.
REMEMBERED = 500_000

#: Characters beyond those whose lower case, normal form and white space are the same to Python and to tokenizers,
#: character by character: Latin letters, digits and common punctuation.  A text with one of these is encoded whole.
_OTHER = re.compile("[^\t-\r\x20-\x7e\x85\xa0-\u012f\u0131-\u017f\u2010-\u2027\u2030-\u205e\u20ac]")
_TAIL = re.compile(r"^(.*[^\W_])([.,;:!?]+)$", re.S)


def exact_by_chunk(tokenizer_json: str) -> bool:
    """Whether no token, normalisation or pre-token of this tokenizer spans white space: it is split off and dropped."""
    spec = json.loads(tokenizer_json)
    steps_ = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    split = next((s for s in steps_ if s.get("type") == "Split"), None)
    return bool(
        split
        and split.get("behavior") == "Removed"
        and split.get("invert")
        and r"[^\s\p{L}\p{N}]+" in json.dumps(split["pattern"]).replace("\\\\", "\\")
        and spec["model"]["type"] == "BPE"
        and not any(" " in t["content"] for t in spec.get("added_tokens", []))
    )


def lower_cases(tokenizer_json: str) -> bool:
    """Whether the tokenizer lower-cases texts itself.

    Special tokens, which are matched as they stand, all hold "<|"; texts with that are left as they are.
    """
    spec = json.loads(tokenizer_json)
    inner = (spec.get("normalizer") or {}).get("normalizers", [])
    return any(n.get("type") == "Lowercase" for n in inner) and all("<|" in t["content"] for t in spec.get("added_tokens", []))


def letters_alone(tokenizer_json: str) -> bool:
    """Whether a run of lower-case letters is one pre-token, which goes to the model byte by byte and as it is."""
    spec = json.loads(tokenizer_json)
    steps_ = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    if [s.get("type") for s in steps_] != ["Split", "ByteLevel"] or not exact_by_chunk(tokenizer_json) or not lower_cases(tokenizer_json):
        return False
    kinds = steps_[0]["pattern"].get("Regex", "").split("|")
    others = {r"[\p{N}]", r"[^\s\p{L}\p{N}]+"}
    plain = not steps_[1].get("add_prefix_space") and not steps_[1].get("use_regex") and not spec["model"].get("dropout")
    return plain and r"[\p{L}]+" in kinds and all(k.startswith("'") or k in others or k == r"[\p{L}]+" for k in kinds)


def _byte_letters() -> dict[int, str]:
    """What the byte-level alphabet writes for each byte: itself if it is printable, else the next character from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_BYTE_LETTERS = _byte_letters()


class _Chunks(dict):
    """Ids of chunks, as bytes of 32-bit integers, each made when it is first asked for."""

    def __init__(self, encode):
        super().__init__()
        self.encode_one = encode

    def __missing__(self, chunk: str) -> bytes:
        # Letters and the punctuation behind them are pre-tokens of their own, so a word is learned once for all of it.
        m = _TAIL.match(chunk) if "<" not in chunk else None
        ids = self[m[1]] + self[m[2]] if m else self.encode_one(chunk)
        self[chunk] = ids
        return ids


class Encoder:
    """Ids of texts by a tokenizer file, without special tokens added."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = self.tokenizer.to_str()
        self.by_chunk, self.folds_case = exact_by_chunk(spec), lower_cases(spec)
        self.model = self.tokenizer.model if letters_alone(spec) else None
        self.known = _Chunks(self._chunk)

    def _one(self, text: str) -> bytes:
        return array("i", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _chunk(self, text: str) -> bytes:
        """A chunk of a text without other characters; letters go to the model alone, as the rest has nothing to do there."""
        if self.model is None or not text.isalpha() or text != text.lower():
            return self._one(text)
        letters = text if text.isascii() else text.encode().decode("latin-1").translate(_BYTE_LETTERS)
        return array("i", [t.id for t in self.model.tokenize(letters)]).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as bytes of 32-bit integers."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        get, out = self.known.__getitem__, []
        for text in texts:
            if not self.by_chunk or _OTHER.search(text):
                out.append(self._one(text))
                continue
            if self.folds_case and "<|" not in text:
                text = text.lower()
            out.append(b"".join(map(get, text.split())))
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _tokenised(path: str, end_id: int):
    end = array("i", [end_id]).tobytes()

    def run(batches):
        part, before = None, 0
        for batch in batches:
            for sliced, texts in steps(batch, "text"):
                parts = sliced.column(sliced.schema.get_field_index("part")).to_pylist()
                ids = encoder(path).encode(texts)
                sizes = np.array([len(x) // 4 + 1 for x in ids], np.int64)
                starts = np.empty(len(ids), np.int64)
                for i, p in enumerate(parts):
                    if p != part:
                        part, before = p, 0
                    starts[i] = before
                    before += int(sizes[i])
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                values = np.frombuffer(b"".join(x + end for x in ids), np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        sliced.column(sliced.schema.get_field_index("part")),
                        sliced.column(sliced.schema.get_field_index("doc_id")),
                        pa.array(starts),
                        pa.array(sizes),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)),
                    ],
                    names=["part", "doc_id", "start_in_part", "n_tokens", "tokens"],
                )

    return run


SCHEMA = "part int, doc_id long, start_in_part long, n_tokens long, tokens array<int>"


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, row_group: int = ROW_GROUP, page: int = PAGE, dictionary: bool = True) -> str:
    """Write (doc_id, text) as token files below ``path``; returns the path.

    ``dictionary``: token ids by dictionary, which suits vocabularies of some ten thousand ids, else by deltas.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    bounds = splitters(docs.select("doc_id").where("doc_id is not null"))
    ordered = docs.withColumn("part", part_of(bounds)("doc_id")).repartition("part").sortWithinPartitions("part", "doc_id", "text")
    (
        map_arrow(ordered, _tokenised(tokenizer, end_id), SCHEMA)
        .write.option("parquet.writer.version", "v2")
        .option("parquet.block.size", row_group)
        .option("parquet.page.size", page)
        .option("parquet.enable.dictionary", "false")
        .option("parquet.enable.dictionary#tokens.list.element", str(dictionary).lower())
        .option("parquet.dictionary.page.size", 1 << 20)
        .option("compression", "zstd")
        .parquet(path)
    )
    return path


def read_tokens(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """Token rows of the documents from ``first`` to ``last``; page indexes leave out other documents' pages."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    if first is not None:
        rows = rows.where(F.col("doc_id") >= first)
    return rows if last is None else rows.where(F.col("doc_id") <= last)


def token_metadata(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it) and n_tokens, without a look at the ids.

    A part's base is the number of ids in the parts before it: one row a part, at most ``ordering.MOST_PARTS``.
    """
    rows = spark.read.schema(SCHEMA).parquet(path)
    return rows.join(_bases(rows), "part").select("doc_id", (F.col("start_in_part") + F.col("base")).alias("start"), "n_tokens")


def _bases(rows: DataFrame) -> DataFrame:
    sums = rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()
    base, out = 0, []
    for r in sorted(sums, key=lambda r: r["part"]):
        out.append((r["part"], base))
        base += r["n"]
    return F.broadcast(rows.sparkSession.createDataFrame(out, "part int, base long"))


def _checked(batches):
    for batch in batches:
        tokens = batch.column(batch.schema.get_field_index("tokens"))
        values, offsets = tokens.flatten().to_numpy().astype("<u4"), tokens.offsets.to_numpy()
        offsets = offsets - offsets[0]
        sums = [zlib.crc32(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
        names = [n for n in batch.schema.names if n != "tokens"]
        yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in names), pa.array(sums, pa.int64())], names=[*names, "ids_crc32"])


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, all from the files."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    based = rows.join(_bases(rows), "part").select("doc_id", (F.col("start_in_part") + F.col("base")).alias("start"), "n_tokens", "tokens")
    return map_arrow(based, _checked, "doc_id long, start long, n_tokens long, ids_crc32 long")


def new_path(spark: SparkSession) -> str:
    return new_folder(spark, "tokens")
