"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.sources.shared import new_folder

#: Text bytes that one vectorised step works on; it bounds a worker's memory whatever the batch size.
STEP_BYTES = 1_000_000
#: Folders of intermediate tables, in the order in which they were written.
_written: list[str] = []


def stored(df: DataFrame, name: str = "step") -> DataFrame:
    """Write to Parquet in the shared folder and read back: the rows are computed once and survive lost executors."""
    path = new_folder(df.sparkSession, name)
    _written.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mark() -> int:
    """A point in the list of intermediate tables, for ``discard``."""
    return len(_written)


def discard(spark: SparkSession, since: int, until: int | None = None) -> None:
    """Delete the intermediate tables written between two marks; nothing may read them any more."""
    for path in _written[since:until]:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def unused(df: DataFrame, name: str) -> str:
    """``name``, or with a number, so that no column of ``df`` has it, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    return next(n for k in range(len(taken) + 1) if (n := f"{name}_{k}" if k else name).lower() not in taken)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps now: its cleaner acts when the driver's JVM collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id"):
    """True where crc32 of the id as text leaves the remainder 1 of 3: rows no model may learn from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def steps(batch: pa.RecordBatch, column: str, most: int = STEP_BYTES) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of a batch with about ``most`` text bytes at most (one longer text stands alone), nulls read as empty."""
    texts = batch.column(batch.schema.get_field_index(column)).to_pylist()
    first, size = 0, 0
    for i, text in enumerate(texts):
        n = len(text or "")
        if i > first and size + n > most:
            yield batch.slice(first, i - first), [t or "" for t in texts[first:i]]
            first, size = i, 0
        size += n
    if first < len(texts):
        yield batch.slice(first), [t or "" for t in texts[first:]]


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows with equal keys, from batches that come sorted by them; one group is in memory at a time."""
    kept: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys]
        start = 0
        for i, key in enumerate(zip(*columns)):
            if key != last:
                if i > start:
                    kept.append(batch.slice(start, i - start))
                if kept:
                    yield pa.Table.from_batches(kept)
                kept, start, last = [], i, key
        kept.append(batch.slice(start))
    if kept:
        yield pa.Table.from_batches(kept)


def map_arrow(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    return df.mapInArrow(function, schema)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an edge list, as rows (node, label), label being the least node of the component.

    Every round each node points to the least of itself and its neighbours; pointers are doubled until they reach
    their roots, and the edges are contracted to the roots, without loops and copies.  Stars and ordered paths vanish in
    one round, and a path of n nodes takes log2(n) doublings.  All state is distributed and written to the shared
    folder, where only the last labels stay; the driver only learns whether something is left to do.  Null
    ends are ignored; an empty edge list gives no rows.
    """
    spark, since = edges.sparkSession, mark()
    live = stored(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("a") != F.col("b"))).distinct())
    labels = None
    while True:
        up = stored(live.union(live.select("b", "a")).groupBy(F.col("a").alias("node")).agg(F.min("b").alias("up")).select("node", F.least("node", "up").alias("up")))
        while True:
            far = up.select(F.col("node").alias("up"), F.col("up").alias("far"))
            jumped = stored(up.join(far, "up", "left").select("node", "up", F.coalesce("far", "up").alias("far")))
            up = jumped.select("node", F.col("far").alias("up"))
            if jumped.where("far <> up").isEmpty():
                break
        if labels is None:
            labels = up.withColumnRenamed("up", "label")
        else:
            moved = labels.join(up.withColumnRenamed("node", "label"), "label", "left")
            labels = moved.select("node", F.coalesce("up", "label").alias("label"))
        one, two = up.toDF("a", "x"), up.toDF("b", "y")
        live = stored(live.join(one, "a").join(two, "b").where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct())
        end = mark()
        labels = stored(labels)
        if live.isEmpty():
            discard(spark, since, end)
            return labels
        # Only the edges and labels that the next round reads stay.
        discard(spark, since, end - 1)
        since = end - 1


def flat(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def binary_values(column: pa.Array | pa.ChunkedArray, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """All values of a binary column as one array, and the offsets of its rows in it."""
    cells = flat(column).to_pylist()
    size = np.dtype(dtype).itemsize
    offsets = np.zeros(len(cells) + 1, np.int64)
    np.cumsum([len(c) // size for c in cells], out=offsets[1:])
    return np.frombuffer(b"".join(cells), dtype), offsets
