"""Geometry of an array at all levels: a pure function of its specification, computed once on the driver.

One plan feeds both the data layout and the metadata, so they cannot disagree.  chunks_per_shard is the same at all
levels, but no more than the chunks that there are.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property
from math import prod

from pyspark.sql import DataFrame, SparkSession

from .spec import MAX_BATCH_EPOCHS, MAX_LEVELS, MAX_PARTS, ArraySpec, Dim, SpecError, ceildiv, dtype, log, next_pow2, with_chunk_bytes


@dataclass(frozen=True)
class Extent:
    """A dimension at a level."""

    name: str
    size: int
    chunk: int
    chunk_count: int
    chunks_per_shard: int

    @property
    def shard_count(self) -> int:
        return ceildiv(self.chunk_count, self.chunks_per_shard)


def halved(size: int) -> int:
    return (size + 1) // 2


def level_count(sizes: list[int], chunks: list[int], most: int = 0) -> int:
    """Levels until every downsampled dimension fits in one chunk; all of them halve while any does not."""
    most, levels = most or MAX_LEVELS, 1
    while levels < most and any(s > c for s, c in zip(sizes, chunks)):
        sizes, levels = [halved(s) for s in sizes], levels + 1
    return levels


def strides(shape: list[int]) -> list[int]:
    """Elements between neighbours along each dimension, the last one being the fastest."""
    return [prod(shape[d + 1 :]) for d in range(len(shape))]


def inverse_permutation(p: list[int]) -> list[int]:
    return sorted(range(len(p)), key=p.__getitem__)


def lifted_strides(sizes: list[int], chunks: list[int], positions: list[int]) -> list[tuple[int, int]]:
    """For each dimension, what a step of a chunk and a step within a chunk add to an element's place in the pool.

    The pool holds whole chunks, one after the other in storage order.
    """
    order = inverse_permutation(positions)
    counts = [ceildiv(sizes[d], chunks[d]) for d in order]
    outer, inner = strides(counts), strides([chunks[d] for d in order])
    size = prod(chunks)
    return [(outer[positions[d]] * size, inner[positions[d]]) for d in range(len(sizes))]


@dataclass(frozen=True)
class ArrayPlan:
    spec: ArraySpec

    @cached_property
    def levels(self) -> int:
        s = self.spec
        lod = [d for d in s.inner if d.downsample]
        return level_count([d.size for d in lod], [d.n for d in lod], s.max_levels) if lod else 1

    def size(self, dim: Dim, level: int, frames: int | None = None) -> int:
        """Extent of a dimension at a level; ``frames`` is that of an unbounded first dimension, 0 while unknown."""
        s, size = self.spec, dim.size
        if dim.name == s.dims[0].name and frames is not None:
            size = frames
        if dim.name in s.lod_dims:
            for _ in range(level):
                size = halved(size)
        elif s.append_downsample and dim.name == s.append[-1].name and size:
            # Whole epochs are merged: the last group is as long as its longest epoch.  ceil(size / 2**level) for chunks of 1.
            whole, rest = divmod(size, dim.n)
            group = (whole - (not rest)) >> level
            size = group * dim.n + (dim.n if group << level < whole else rest)
        return size

    def extents(self, level: int = 0, frames: int | None = None) -> list[Extent]:
        """Dimensions at a level, in the order of the specification."""
        out = []
        for d in self.spec.dims:
            size = self.size(d, level, frames)
            count = ceildiv(size, d.n) if size else 1
            per = d.chunks_per_shard or count
            # An unbounded dimension's shards keep their room, however few chunks have come.
            out.append(Extent(d.name, size, d.n, count, min(per, count) if d.size else per))
        return out

    def stored_extents(self, level: int = 0, frames: int | None = None) -> list[Extent]:
        by_name = {e.name: e for e in self.extents(level, frames)}
        return [by_name[d.name] for d in self.spec.stored]

    def shape(self, level: int = 0, frames: int | None = None) -> list[int]:
        return [e.size for e in self.extents(level, frames)]

    @property
    def chunk_elements(self) -> int:
        return prod(d.n for d in self.spec.dims)

    @property
    def chunk_bytes(self) -> int:
        return self.chunk_elements * dtype(self.spec.dtype).nbytes

    def chunks_per_epoch(self, level: int = 0) -> int:
        inner = {d.name for d in self.spec.inner}
        return prod(e.chunk_count for e in self.extents(level) if e.name in inner)

    @property
    def total_chunks_per_epoch(self) -> int:
        return sum(self.chunks_per_epoch(level) for level in range(self.levels))

    @property
    def frame_elements(self) -> int:
        """Elements of one index of the append dimensions."""
        return prod(d.size for d in self.spec.inner)

    @property
    def epoch_frames(self) -> int:
        return prod(d.n for d in self.spec.append)

    @property
    def epoch_elements(self) -> int:
        """Elements that complete the chunks of one index of the append dimensions' chunks."""
        return self.frame_elements * self.epoch_frames

    @property
    def padded_epoch_elements(self) -> int:
        """The same with inner dimensions padded to whole chunks."""
        return self.chunks_per_epoch() * self.chunk_elements

    @property
    def bounded_append_chunks(self) -> int:
        return prod(d.chunk_count for d in self.spec.append[1:])

    @property
    def capacity(self) -> int | None:
        """Elements that an array of bounded extent takes; None if the first dimension is unbounded."""
        return prod(d.size for d in self.spec.dims) if self.spec.dims[0].size else None

    @property
    def epochs_per_batch(self) -> int:
        k = self.spec.epochs_per_batch or next_pow2(ceildiv(self.spec.target_batch_chunks or 1024, self.total_chunks_per_epoch))
        return min(k, MAX_BATCH_EPOCHS)

    def append_sizes_midway(self, chunks: int) -> list[int]:
        """Extents of the append dimensions after so many flat append chunks."""
        a = self.spec.append
        return [ceildiv(chunks, self.bounded_append_chunks) * a[0].n, *(d.size for d in a[1:])]

    def append_sizes_final(self, elements: int, level: int = 0) -> list[int]:
        """Exact extents of the append dimensions after so many elements, at a level."""
        a = self.spec.append
        frames = elements // (self.frame_elements * prod(d.size for d in a[1:]))
        return [self.size(a[0], level, frames), *(self.size(d, level) for d in a[1:])]

    @property
    def slots(self) -> int:
        """Chunks that a shard of level 0 has room for."""
        return prod(e.chunks_per_shard for e in self.extents())

    def memory_bytes(self, epochs: int | None = None) -> dict[str, int]:
        """What tasks hold for one batch of epochs: cells, whole chunks, compressed chunks at worst, and shard indexes."""
        k, bpe = epochs or self.epochs_per_batch, dtype(self.spec.dtype).nbytes
        chunks = k * self.total_chunks_per_epoch
        return {
            "cells": k * self.epoch_elements * (bpe + 8 * self.spec.rank),
            "chunks": chunks * self.chunk_bytes,
            "compressed": chunks * (self.chunk_bytes + self.chunk_bytes // 255 + 64),
            "index": 16 * self.slots + 4,
        }

    def check_shards(self, part_bytes: int = 8 << 20) -> None:
        """Refuse shards that a multipart upload with parts of this size could not hold."""
        worst = self.slots * self.chunk_bytes
        if ceildiv(worst, part_bytes) > MAX_PARTS:
            raise SpecError(f"a shard of {worst} bytes needs more than {MAX_PARTS} parts of {part_bytes}")

    def rows(self, frames: int | None = None) -> list[tuple]:
        return [
            (level, i, e.name, e.size, e.chunk, e.chunk_count, e.chunks_per_shard, e.shard_count)
            for level in range(self.levels)
            for i, e in enumerate(self.extents(level, frames))
        ]

    def to_df(self, spark: SparkSession, frames: int | None = None) -> DataFrame:
        """The geometry as a table, one row for each level and dimension."""
        return spark.createDataFrame(
            self.rows(frames), "level int, dim int, name string, size bigint, chunk_size bigint, chunk_count bigint, chunks_per_shard bigint, shard_count bigint"
        )

    def __str__(self) -> str:
        head = ("level", "dim", "name", "size", "chunk", "chunks", "per shard", "shards")
        return "\n".join("  ".join(str(c).rjust(9) for c in r) for r in [head, *self.rows()])


def advise_chunks(spec: ArraySpec, target_bytes: int, ratios: list[int], budget_bytes: int) -> ArraySpec:
    """The largest chunks up to ``target_bytes`` with which a batch fits the memory budget; the target halves until then."""
    from dataclasses import replace

    target = target_bytes
    while target >= dtype(spec.dtype).nbytes:
        found = replace(spec, dims=tuple(with_chunk_bytes(spec.dims, target, spec.dtype, ratios)))
        if sum(ArrayPlan(found).memory_bytes().values()) <= budget_bytes:
            return found
        target //= 2
    log.warning("no chunk size fits %d bytes", budget_bytes)
    raise SpecError("no chunk size fits the memory budget")
