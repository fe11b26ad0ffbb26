"""Shards: chunks of one shard, one after the other by slot, with an index of (offset, size) pairs and a CRC32C.

Slots and shards follow the chunk grid: shard = chunk div chunks-per-shard, slot = the rest, row-major in storage
order.  An empty slot has both numbers all ones.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.index import flat, idiv
from tessella.plans.geometry import ArrayPlan

EMPTY = 0xFFFFFFFFFFFFFFFF


def _rows(table: np.ndarray, n: int) -> np.ndarray:
    """Tables for 0 to n - 1 further bytes of zeros behind a byte: a checksum of n bytes is the sum of their entries."""
    out = [table]
    for _ in range(n - 1):
        out.append(table[out[-1] & 0xFF] ^ (out[-1] >> np.uint32(8)))
    return np.stack(out)


def _table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0x82F63B78), t >> 1)
    return t


_SLICE = 256
_CRC = _rows(_table(), _SLICE)


def crc32c(data: bytes) -> int:
    """CRC-32C: the checksum so far goes into the first four bytes of a slice, whose bytes are then looked up at once."""
    x, c = np.frombuffer(data, np.uint8), 0xFFFFFFFF
    for lo in range(0, len(x), _SLICE):
        part = x[lo : lo + _SLICE].copy()
        n = len(part)
        head = np.frombuffer(struct.pack("<I", c), np.uint8)[: min(4, n)]
        part[: len(head)] ^= head
        rest = c >> 8 * n if n < 4 else 0
        c = int(np.bitwise_xor.reduce(_CRC[np.arange(n - 1, -1, -1), part])) ^ rest
    return c ^ 0xFFFFFFFF


def shard_of(plan: ArrayPlan, chunk: str = "chunk", level: int = 0, frames: int | None = None) -> Column:
    return F.array(*[idiv(F.col(chunk)[i], e.chunks_per_shard) for i, e in enumerate(plan.stored_extents(level, frames))])


def slot_of(plan: ArrayPlan, chunk: str = "chunk", level: int = 0, frames: int | None = None) -> Column:
    e = plan.stored_extents(level, frames)
    return flat([F.col(chunk)[i] % x.chunks_per_shard for i, x in enumerate(e)], [x.chunks_per_shard for x in e])


def shard_number(plan: ArrayPlan, shard: str = "shard", level: int = 0, frames: int | None = None) -> Column:
    """Flat index of a shard; the first dimension may be unbounded."""
    e = plan.stored_extents(level, frames)
    return flat([F.col(shard)[i] for i in range(len(e))], [x.shard_count for x in e])


def shard_key(shard: str = "shard") -> Column:
    """The object's name below its array: c/i0/i1/..."""
    return F.concat_ws("/", F.lit("c"), F.transform(F.col(shard), lambda x: x.cast("string")))


def key_from_number(number: int, counts: list[int]) -> str:
    """The same from a flat index; the first dimension takes what is left."""
    out = []
    for n in reversed(counts[1:]):
        number, rest = divmod(number, n)
        out.append(rest)
    return "/".join(["c", str(number), *map(str, reversed(out))])


def with_slots(chunks: DataFrame, plan: ArrayPlan, level: int = 0, frames: int | None = None) -> DataFrame:
    return chunks.withColumn("shard", shard_of(plan, level=level, frames=frames)).withColumn("slot", slot_of(plan, level=level, frames=frames))


def with_offsets(slotted: DataFrame, by: tuple[str, ...] = (), alignment: int = 0) -> DataFrame:
    """Add the offset of every chunk in its shard: an exclusive running sum of nbytes by slot.

    With an alignment the last chunk of a shard gets ``padding`` bytes after it, so that what follows starts on a
    multiple.  A window holds the chunks of one shard.
    """
    shard = Window.partitionBy(*by, "shard")
    before = shard.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    out = slotted.where("nbytes > 0").withColumn("offset", F.coalesce(F.sum("nbytes").over(before), F.lit(0)).cast("bigint"))
    if not alignment:
        return out.withColumn("padding", F.lit(0).cast("bigint"))
    is_last = F.col("slot") == F.max("slot").over(shard)
    return out.withColumn("padding", F.when(is_last, F.pmod(-(F.col("offset") + F.col("nbytes")), F.lit(alignment))).otherwise(0).cast("bigint"))


def shard_index(slotted: DataFrame, plan: ArrayPlan, by: tuple[str, ...] = (), level: int = 0, frames: int | None = None) -> DataFrame:
    """(by, shard, slot, offset, nbytes) for every slot of every shard that has a chunk; empty ones have -1."""
    slots = int(np.prod([e.chunks_per_shard for e in plan.stored_extents(level, frames)]))
    present = with_offsets(slotted, by).groupBy(*by, "shard").agg(F.map_from_entries(F.collect_list(F.struct("slot", F.struct("offset", "nbytes")))).alias("m"))
    every = present.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(slots - 1).cast("bigint"))))
    got = F.try_element_at("m", F.col("slot"))
    none = F.lit(-1).cast("bigint")
    return every.select(*by, "shard", "slot", F.coalesce(got["offset"], none).alias("offset"), F.coalesce(got["nbytes"], none).alias("nbytes"))


def pack_shard(chunks: list[tuple[int, bytes]], slots: int, alignment: int = 0) -> bytes:
    """The bytes of a shard from its (slot, data): data, padding, index, checksum of the index."""
    pairs = np.full((slots, 2), EMPTY, "<u8")
    body, at = [], 0
    for slot, data in sorted(chunks):
        if data:
            pairs[slot] = at, len(data)
            body.append(data)
            at += len(data)
    if alignment:
        body.append(bytes(-at % alignment))
    index = pairs.tobytes()
    return b"".join([*body, index, struct.pack("<I", crc32c(index))])


def parse_index(data: bytes, slots: int) -> np.ndarray:
    """(offset, nbytes) of each slot, from the end of a shard; checks the checksum."""
    index, (check,) = data[-16 * slots - 4 : -4], struct.unpack("<I", data[-4:])
    if len(index) != 16 * slots or crc32c(index) != check:
        raise ValueError("the shard's index is damaged")
    return np.frombuffer(index, "<u8").reshape(slots, 2)


def parse_shard(data: bytes, slots: int) -> dict[int, bytes]:
    return {i: data[int(o) : int(o + n)] for i, (o, n) in enumerate(parse_index(data, slots)) if o != EMPTY}


def assemble(encoded: DataFrame, plan: ArrayPlan, by: tuple[str, ...] = (), level: int = 0, frames: int | None = None) -> DataFrame:
    """One row per shard: (by, shard, key, object).  A task holds one shard, whose size the plan bounds."""
    plan.check_shards()
    slots = int(np.prod([e.chunks_per_shard for e in plan.stored_extents(level, frames)]))
    alignment = plan.spec.shard_alignment
    slotted = with_slots(encoded, plan, level, frames).select(*by, "shard", "slot", "data")
    kinds = dict(slotted.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "shard array<bigint>", "object binary"])

    def run(batches):
        for batch in batches:
            slot = batch.column(batch.schema.get_field_index("slots")).to_pylist()
            data = batch.column(batch.schema.get_field_index("chunks")).to_pylist()
            keys = [batch.column(batch.schema.get_field_index(c)) for c in (*by, "shard")]
            out = [pack_shard(list(zip(s, d)), slots, alignment) for s, d in zip(slot, data)]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(out, pa.large_binary() if sum(map(len, out)) >= 1 << 31 else pa.binary())], names=[*by, "shard", "object"])

    grouped = slotted.groupBy(*by, "shard").agg(F.collect_list(F.struct("slot", "data")).alias("c"))
    parts = grouped.select(*by, "shard", F.col("c.slot").alias("slots"), F.col("c.data").alias("chunks"))
    return parts.mapInArrow(run, schema).withColumn("key", shard_key())
