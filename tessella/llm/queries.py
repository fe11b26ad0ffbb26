"""The ``opN_<name>`` queries: each applies one operator, with its production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import jaccard_classes

    return jaccard_classes(table(spark, sf_dir, "documents"))


def op7_collinear_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import repeated_passages

    return repeated_passages(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learn from the rows that are not held out, predict every row from its text."""
    from .common import held_out
    from .language_id import fit_language_model, predict_language, trainable

    docs = table(spark, sf_dir, "documents")
    model = fit_language_model(trainable(docs))
    return predict_language(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learn labels of the rows that are not held out, score every row from its text."""
    from pyspark.sql import functions as F

    from .common import held_out
    from .quality import fit_quality, score_quality

    docs = table(spark, sf_dir, "documents")
    net = fit_quality(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, net).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store every text as a FLAC stream, read the streams back, digest what was read."""
    from .flac import flac_column, media_digests

    return media_digests(flac_column(table(spark, sf_dir, "documents")))


def op3_iblt_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprint import fingerprints

    return fingerprints(table(spark, sf_dir, "documents"))


def op9_parquet_token_ids(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """Write token files to the shared folder, read starts, counts and ids back from them."""
    from .tokens import new_path, token_digests, write_tokens

    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return token_digests(spark, write_tokens(table(spark, sf_dir, "documents"), new_path(spark), tokenizer))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents by their number of words."""
    from .packing import pack, word_counts

    return pack(word_counts(table(spark, sf_dir, "documents")))


def op1_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates that give the domains of the labels table their target shares of the corpus's tokens."""
    from .mixing import WEIGHTS, label_domains, mix

    return mix(table(spark, sf_dir, "documents"), label_domains(table(spark, sf_dir, "labels")), WEIGHTS)


def op5_chat_tool_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import format_chats

    return format_chats(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op5_chat_tool_linking": OP5_SQL}


#: User turns are calls, assistant turns results; JSON keys in sorted order, as the canonical form has them.
OP5_SQL = """
WITH e AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text,
         CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'message' END AS kind,
         CASE role WHEN 'user' THEN conv_id || ':' || turn WHEN 'assistant' THEN conv_id || ':' || (turn - 1) END AS call_id
  FROM conversations
), calls AS (SELECT * FROM e WHERE kind = 'call'
), results AS (
  SELECT conv_id, call_id, count(*) AS n_results, min(turn) AS result_turn, arg_min(text, turn) AS result
  FROM e WHERE kind = 'result' GROUP BY ALL
)
SELECT c.conv_id, c.turn, CAST(0 AS INTEGER) AS ordinal, 'call' AS kind, c.call_id, CAST(0 AS INTEGER) AS level,
       c.text <> '' AS valid, CAST(c.text = '' AS INTEGER) AS n_errors, coalesce(r.n_results, 0) AS n_results, r.result_turn,
       '{"arguments":{"prompt":' || CAST(to_json(c.text) AS VARCHAR) || ',"turn":' || c.turn || '},"conv_id":' || c.conv_id
       || ',"errors":[' || CASE WHEN c.text = '' THEN '"$.prompt: shorter than 1"' ELSE '' END || '],"id":"' || c.call_id
       || '","name":"reply","result":' || coalesce(CAST(to_json(r.result) AS VARCHAR), 'null') || ',"turn":' || c.turn || ',"type":"call"}' AS json
FROM calls c LEFT JOIN results r ON c.conv_id = r.conv_id AND c.call_id = r.call_id
UNION ALL
SELECT e.conv_id, e.turn, 0, 'orphan_result', e.call_id, 0, NULL, 0, 0, NULL,
       '{"conv_id":' || e.conv_id || ',"id":"' || e.call_id || '","result":' || CAST(to_json(e.text) AS VARCHAR) || ',"turn":' || e.turn || ',"type":"orphan_result"}'
FROM e ANTI JOIN calls c ON e.conv_id = c.conv_id AND e.call_id = c.call_id WHERE e.kind = 'result'
UNION ALL
SELECT e.conv_id, e.turn, 0, 'more_result', e.call_id, 0, NULL, 0, 0, NULL,
       '{"conv_id":' || e.conv_id || ',"id":"' || e.call_id || '","result":' || CAST(to_json(e.text) AS VARCHAR) || ',"turn":' || e.turn || ',"type":"more_result"}'
FROM e SEMI JOIN calls c ON e.conv_id = c.conv_id AND e.call_id = c.call_id
JOIN results r ON e.conv_id = r.conv_id AND e.call_id = r.call_id
WHERE e.kind = 'result' AND (e.turn IS DISTINCT FROM r.result_turn OR e.text <> r.result)
UNION ALL
SELECT e.conv_id, e.turn, 0, 'message', NULL, 0, NULL, 0, 0, NULL,
       '{"conv_id":' || e.conv_id || ',"role":' || CAST(to_json(e.role) AS VARCHAR) || ',"text":' || CAST(to_json(e.text) AS VARCHAR) || ',"turn":' || e.turn || ',"type":"message"}'
FROM e WHERE e.kind = 'message'
"""
