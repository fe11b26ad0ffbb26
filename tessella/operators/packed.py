"""The pyramid over packed chunks: a second form of ``pyramid`` for dense data.

A task reduces a whole chunk with numpy and passes on its half-size result, so a level shuffles 1/2**k of the bytes of
the one before (k downsampled dimensions) and no cell is ever a row.  Chunk edges of downsampled dimensions must be
even.  ``packed_levels`` makes all levels that the chunk edges' powers of two allow from one look at a chunk, with a
single shuffle for all of them.  Results equal those of ``pyramid`` followed by ``tile``.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.plans.geometry import ArrayPlan
from tessella.plans.spec import SpecError, dtype


def reduce_block(block: np.ndarray, axes: list[int], method: str) -> np.ndarray:
    """Windows of two along each axis, reduced; odd extents end in smaller windows."""
    integral = block.dtype.kind in "ui"
    if integral and method == "mean" and block.dtype.itemsize < 8 and not any(block.shape[a] % 2 for a in axes):
        # Whole windows of narrow integers: halves are added up along one axis after the other.
        total = block.astype(np.int64 if block.dtype.itemsize == 4 else np.int32)
        for a in axes:
            even, odd_ = (total[tuple(slice(k, None, 2) if b == a else slice(None) for b in range(block.ndim))] for k in (0, 1))
            total = even + odd_
        if block.dtype.kind == "i":
            total += (total < 0) * ((1 << len(axes)) - 1)
        return (total >> len(axes)).astype(block.dtype)
    odd = [(0, block.shape[a] % 2 if a in axes else 0) for a in range(block.ndim)]
    there = np.pad(np.ones(block.shape, bool), odd)
    full = np.pad(block, odd, mode="edge")
    shape = [x for a, n in enumerate(full.shape) for x in ((n // 2, 2) if a in axes else (n,))]
    order, window, at = [], [], 0
    for a in range(full.ndim):
        order.append(at)
        if a in axes:
            window.append(at + 1)
        at += 2 if a in axes else 1

    def windows(x: np.ndarray) -> np.ndarray:
        y = x.reshape(shape).transpose(order + window)
        return y.reshape(*y.shape[: full.ndim], -1)

    w, m = windows(full), windows(there)
    if method in ("min", "max"):
        return getattr(w, method)(axis=-1)
    n = m.sum(axis=-1)
    if method == "mean":
        if not integral:
            return (np.where(m, w.astype(np.float64), 0).sum(axis=-1) / n).astype(block.dtype)
        total = np.where(m, w.astype(object) if block.dtype.itemsize == 8 else w.astype(np.int64), 0).sum(axis=-1)
        if block.dtype.itemsize == 8:
            return np.array([int(abs(t) // k * (1 if t >= 0 else -1)) for t, k in zip(total.ravel(), n.ravel())], object).reshape(n.shape).astype(block.dtype)
        return (np.sign(total) * (np.abs(total) // n)).astype(block.dtype)
    # Order statistics of the cells that exist: those that do not are sorted behind all others.
    first = method == "max_sup"
    rank = np.argsort(w, axis=-1, kind="stable")
    if first:
        rank = rank[..., ::-1]
    exists = np.take_along_axis(m, rank, -1)
    behind = np.argsort(~exists, axis=-1, kind="stable")
    values = np.take_along_axis(np.take_along_axis(w, rank, -1), behind, -1)
    pick = n // 2 if method == "median" else np.minimum(1, n - 1)
    return np.take_along_axis(values, pick[..., None], -1)[..., 0]


def next_level(chunks: DataFrame, plan: ArrayPlan, level: int, frames: int | None = None) -> DataFrame:
    """Chunks (chunk, payload) of level + 1 from those of a level."""
    spec = plan.spec
    kind, fill = dtype(spec.dtype).numpy, spec.fill
    extents = plan.stored_extents(level, frames)
    axes = [i for i, e in enumerate(extents) if e.name in spec.lod_dims]
    # Only the spatial levels are made here: along the append dimensions nothing is folded yet.
    first = {e.name: e.size for e in plan.stored_extents(0, frames)}
    edges, sizes = [e.chunk for e in extents], [e.size if e.name in spec.lod_dims else first[e.name] for e in extents]
    if any(edges[a] % 2 for a in axes):
        raise SpecError("packed pyramids need even chunk edges along downsampled dimensions")
    half = [n // 2 if i in axes else n for i, n in enumerate(edges)]

    def shrink(batches):
        for batch in batches:
            at = batch.column(batch.schema.get_field_index("chunk")).to_pylist()
            payloads = batch.column(batch.schema.get_field_index("payload")).to_pylist()
            parents, corners, shapes, out = [], [], [], []
            for c, p in zip(at, payloads):
                there = [min(n, s - x * n) if s else n for n, s, x in zip(edges, sizes, c)]
                block = np.frombuffer(p, kind).reshape(edges)[tuple(map(slice, there))]
                small = reduce_block(block, axes, spec.reduce)
                parents.append([x // 2 if i in axes else x for i, x in enumerate(c)])
                corners.append([x % 2 * h if i in axes else 0 for i, (x, h) in enumerate(zip(c, half))])
                shapes.append(list(small.shape))
                out.append(small.tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(parents, pa.list_(pa.int64())), pa.array(corners, pa.list_(pa.int64())), pa.array(shapes, pa.list_(pa.int64())), pa.array(out, pa.binary())],
                names=["chunk", "corner", "shape", "part"],
            )

    def join(batches):
        for batch in batches:
            out = []
            for parts in batch.column(batch.schema.get_field_index("parts")).to_pylist():
                whole = np.full(edges, fill, kind)
                for r in parts:
                    whole[tuple(slice(c, c + n) for c, n in zip(r["corner"], r["shape"]))] = np.frombuffer(r["part"], kind).reshape(r["shape"])
                out.append(whole.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("chunk")), pa.array(out, pa.binary())], names=["chunk", "payload"])

    parts = chunks.select("chunk", "payload").mapInArrow(shrink, "chunk array<bigint>, corner array<bigint>, shape array<bigint>, part binary")
    grouped = parts.groupBy("chunk").agg(F.collect_list(F.struct("corner", "shape", "part")).alias("parts"))
    return grouped.mapInArrow(join, "chunk array<bigint>, payload binary")


def packed_levels(chunks: DataFrame, plan: ArrayPlan, frames: int | None = None) -> DataFrame:
    """(level, chunk, payload) of all levels of the chunks given, which are read once for level 0 and once for the others."""
    spec, base = plan.spec, chunks.select(F.lit(0).alias("level"), "chunk", "payload")
    extents = plan.stored_extents(0, frames)
    kind, edges, sizes = dtype(spec.dtype).numpy, [e.chunk for e in extents], [e.size for e in extents]
    axes = [i for i, e in enumerate(extents) if e.name in spec.lod_dims]
    depth = 0
    while depth + 1 < plan.levels and all(edges[a] % (2 << depth) == 0 for a in axes):
        depth += 1
    if not depth:
        return base if plan.levels == 1 else _stacked(packed_pyramid(chunks, plan, frames))
    fill, names = spec.fill, ["level", "chunk", "corner", "shape", "part"]

    def shrink(batches):
        """Every level of a chunk: chunks begin at multiples of all windows, so none of these reaches beyond a chunk."""
        for batch in batches:
            rows = []
            columns = (batch.column(batch.schema.get_field_index(c)) for c in ("chunk", "payload"))
            for c, payload in zip(*columns):
                c = c.as_py()
                there = [min(n, s - x * n) if s else n for n, s, x in zip(edges, sizes, c)]
                block = np.frombuffer(payload.as_buffer(), kind).reshape(edges)[tuple(map(slice, there))]
                for level in range(1, depth + 1):
                    block = reduce_block(block, axes, spec.reduce)
                    parent = [x >> level if i in axes else x for i, x in enumerate(c)]
                    corner = [(x - (x >> level << level)) * (n >> level) if i in axes else 0 for i, (x, n) in enumerate(zip(c, edges))]
                    rows.append((level, parent, corner, list(block.shape), block.tobytes()))
            types = [pa.int32(), *[pa.list_(pa.int64())] * 3, pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types], names=names)

    def join(batches):
        for batch in batches:
            out = []
            for parts in batch.column(batch.schema.get_field_index("parts")).to_pylist():
                whole = np.full(edges, fill, kind)
                for r in parts:
                    whole[tuple(slice(c, c + n) for c, n in zip(r["corner"], r["shape"]))] = np.frombuffer(r["part"], kind).reshape(r["shape"])
                out.append(whole.tobytes())
            keys = [batch.column(batch.schema.get_field_index(c)) for c in ("level", "chunk")]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(out, pa.binary())], names=["level", "chunk", "payload"])

    parts = chunks.select("chunk", "payload").mapInArrow(shrink, "level int, chunk array<bigint>, corner array<bigint>, shape array<bigint>, part binary")
    grouped = parts.groupBy("level", "chunk").agg(F.collect_list(F.struct("corner", "shape", "part")).alias("parts"))
    done = base.unionByName(grouped.mapInArrow(join, "level int, chunk array<bigint>, payload binary"))
    last = done.where(F.col("level") == depth).select("chunk", "payload")
    for level in range(depth, plan.levels - 1):
        last = next_level(last, plan, level, frames)
        done = done.unionByName(last.select(F.lit(level + 1).alias("level"), "chunk", "payload"))
    return done


def _stacked(levels: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [x.select(F.lit(i).alias("level"), "chunk", "payload") for i, x in enumerate(levels)])


def packed_pyramid(chunks: DataFrame, plan: ArrayPlan, frames: int | None = None) -> list[DataFrame]:
    """Chunks of every level; the first are those given."""
    out = [chunks.select("chunk", "payload")]
    for level in range(plan.levels - 1):
        out.append(next_level(out[-1], plan, level, frames))
    return out
