"""Tiling: cells to chunks and back.

Where an element goes is div and mod of its coordinates, in generated code.  A chunk is put together from at most
``chunk_elements`` rows, so no task holds more than whole chunks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.index import flat, idiv
from tessella.plans.geometry import ArrayPlan, strides
from tessella.plans.spec import dtype


def placed(cells: DataFrame, plan: ArrayPlan) -> DataFrame:
    """Add ``chunk``, the chunk's coordinates in storage order, and ``pos``, the element's place in the chunk."""
    stored = plan.spec.stored
    chunk = F.array(*[idiv(d.name, d.n) for d in stored])
    return cells.withColumn("chunk", chunk).withColumn("pos", flat([F.col(d.name) % d.n for d in stored], [d.n for d in stored]))


def _assemble(size: int, kind: str, fill: float):
    def run(batches):
        for batch in batches:
            pos, values = (batch.column(batch.schema.get_field_index(n)) for n in ("pos", "vals"))
            at, v, offsets = pos.flatten().to_numpy(), values.flatten(), pos.offsets.to_numpy()
            v = np.array(v.to_pylist(), dtype=kind) if pa.types.is_decimal(v.type) else v.to_numpy(zero_copy_only=False).astype(kind)
            offsets = offsets - offsets[0]
            out = []
            for a, b in zip(offsets[:-1], offsets[1:]):
                chunk = np.full(size, fill, kind)
                chunk[at[a:b]] = v[a:b]
                out.append(chunk.tobytes())
            names = [n for n in batch.schema.names if n not in ("pos", "vals")]
            columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(out, pa.binary())], names=[*names, "payload"])

    return run


def tile(cells: DataFrame, plan: ArrayPlan, by: tuple[str, ...] = ()) -> DataFrame:
    """Chunks of cells: ``by`` columns, chunk, cells (how many there are), payload.

    The payload has the elements in storage order, row-major, little-endian; cells that are not there have the fill
    value.  Chunks without a cell are no rows.  ``by`` names further key columns, such as level or array_id.
    """
    grouped = placed(cells, plan).groupBy(*by, "chunk").agg(F.count("*").alias("cells"), F.collect_list(F.struct("pos", "value")).alias("got"))
    parts = grouped.select(*by, "chunk", "cells", F.col("got.pos").alias("pos"), F.col("got.value").alias("vals"))
    kinds = dict(parts.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "chunk array<bigint>", "cells bigint", "payload binary"])
    d = dtype(plan.spec.dtype)
    return parts.mapInArrow(_assemble(plan.chunk_elements, d.numpy, plan.spec.fill), schema)


def _scatter(kind: str, names: list[str], sizes: list[int], by: list[str], arrow: pa.DataType):
    steps, total = strides(sizes), int(np.prod(sizes))
    pos = np.arange(total)
    within = [pos // s % n for s, n in zip(steps, sizes)]

    def run(batches):
        for batch in batches:
            chunks = batch.column(batch.schema.get_field_index("chunk")).to_pylist()
            payloads = batch.column(batch.schema.get_field_index("payload")).to_pylist()
            for i, (chunk, payload) in enumerate(zip(chunks, payloads)):
                v = np.frombuffer(payload, kind)
                values = pa.array([int(x) for x in v], pa.decimal128(20, 0)) if pa.types.is_decimal(arrow) else pa.array(v).cast(arrow)
                own = [pa.repeat(batch.column(batch.schema.get_field_index(c))[i], total) for c in by]
                coords = [pa.array(c * n + w) for c, n, w in zip(chunk, sizes, within)]
                yield pa.RecordBatch.from_arrays([*own, *coords, values], names=[*by, *names, "value"])

    return run


def untile(chunks: DataFrame, plan: ArrayPlan, by: tuple[str, ...] = ()) -> DataFrame:
    """Cells of chunks, padding included; see ``cells.inside`` for the array's extents alone."""
    stored = plan.spec.stored
    d = dtype(plan.spec.dtype)
    kinds = dict(chunks.dtypes)
    arrow = {"smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64(), "tinyint": pa.int8(), "float": pa.float32(), "double": pa.float64()}.get(d.spark, pa.decimal128(20, 0))
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in by), *(f"`{x.name}` bigint" for x in stored), f"value {d.spark}"])
    out = chunks.select(*by, "chunk", "payload").mapInArrow(_scatter(d.numpy, [x.name for x in stored], [x.n for x in stored], list(by), arrow), schema)
    return out.select(*by, *plan.spec.names, "value")
