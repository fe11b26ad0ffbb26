"""Token files against whole texts encoded by the library."""

import os
import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

P = pytest.importorskip("public_tokenizers")

from tessella.llm.tokens import Encoder, exact_by_chunk, new_path, read_tokens, token_digests, token_metadata, write_tokens  # noqa: E402

PATH = P.path("word_bpe_49k.json")
ODD = ["<|endoftext|> a<|startoftext|>, it's don't 'sad ’s", "é x ́y ÉÈ. Ω Σ ς ΑΣ. İx", "a b　c\x1cd\x85e​f g", "x,'s y!'re .,'ll ,.!!? DON'T. <|ENDOFTEXT|> A<b. <a.", "😀👍🏽. 12,345.67_8 ab_. ½. ²,", "H̱ẖ", "", "   ", "SCHÖN! schön, Schön", "a" * 3000]


def test_chunks_equal_whole_texts():
    e = Encoder(PATH)
    assert e.by_chunk
    rng = random.Random(0)
    texts = ODD + ["".join(rng.choice("aBé.,!' \n'1_<|ß²") for _ in range(80)) for _ in range(300)]
    for _ in range(2):
        for text, got in zip(texts, e.encode(texts)):
            assert np.frombuffer(got, np.int32).tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids, text
    letters = "abcdefgzéèßüñçæøåþðœšžÿĀıſaAB"
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 14))) for _ in range(3000)]
    assert e.model is not None
    for text in (" ".join(words[k : k + 30]) for k in range(0, 3000, 30)):
        assert np.frombuffer(e.encode([text])[0], np.int32).tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids, text
    other = Encoder(P.path("byte_bpe_50k.json"))
    assert other.model is None and not other.by_chunk and not exact_by_chunk(other.tokenizer.to_str())
    assert np.frombuffer(other.encode(["a b"])[0], np.int32).tolist() == other.tokenizer.encode("a b", add_special_tokens=False).ids


@pytest.mark.parametrize("rows_per_part", [1000, 7])
def test_files(spark, monkeypatch, rows_per_part):
    monkeypatch.setattr("tessella.llm.tokens.splitters", lambda ids: __import__("tessella.llm.ordering", fromlist=["splitters"]).splitters(ids, rows_per_part))
    rows = [(i * 11 % 97, t) for i, t in enumerate(ODD * 5)] + [(200, None), (None, "no id"), (None, None), (3, "twice"), (3, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as part", "2 as tokens", "3 as start")
    path = write_tokens(docs, new_path(spark), PATH)
    got = token_digests(spark, path).collect()
    e, at, want = Encoder(PATH), 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*e.tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert sorted(r["start"] for r in token_metadata(spark, path).collect()) == [w[1] for w in want]
    some = read_tokens(spark, path, 10, 20).collect()
    assert {r["doc_id"] for r in some} == {i for i, _ in rows if i is not None and 10 <= i <= 20}
    empty = write_tokens(docs.limit(0), new_path(spark), PATH)
    assert token_digests(spark, empty).count() == 0


def test_format(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "concat('some words number ', id, ' and more of them') as text").coalesce(1)
    path = write_tokens(docs, new_path(spark), PATH, row_group=1 << 16, page=1 << 12).removeprefix("file://")
    files = [f"{path}/{f}" for f in sorted(os.listdir(path)) if f.endswith(".parquet")]
    columns = {}
    for f in files:
        meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            for c in range(meta.num_columns):
                col = meta.row_group(g).column(c)
                columns.setdefault(col.path_in_schema, set()).update(col.encodings)
                assert col.has_offset_index and col.has_column_index
    assert "RLE_DICTIONARY" in columns["tokens.list.element"] and "DELTA_BINARY_PACKED" in columns["doc_id"]
    plain = write_tokens(docs.limit(50), new_path(spark), PATH, dictionary=False).removeprefix("file://")
    f = next(f for f in os.listdir(plain) if f.endswith(".parquet"))
    meta = pq.ParquetFile(f"{plain}/{f}").metadata.row_group(0)
    assert "DELTA_BINARY_PACKED" in next(meta.column(c) for c in range(meta.num_columns) if meta.column(c).path_in_schema == "tokens.list.element").encodings
