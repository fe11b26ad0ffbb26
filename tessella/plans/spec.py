"""Description of a chunked array: element type, dimensions, codec, reduction; all checks are made here, on the driver."""

from __future__ import annotations

import logging
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, replace

log = logging.getLogger("tessella")

#: Fixed values of the store format and the engine's limits.
MAX_RANK, MAX_LEVELS, MAX_BATCH_EPOCHS, MAX_PARTS = 32, 32, 128, 10_000
REDUCERS = ("mean", "min", "max", "median", "max_sup", "min_sup")
FOLDERS = ("mean", "mean_fold", "min", "max")
AXIS_TYPES = ("space", "time", "channel", "other")


class SpecError(ValueError):
    """A specification that no array can have."""


@dataclass(frozen=True)
class DType:
    """An element type.  ``spark`` holds every value: Spark has no unsigned and no half-precision types."""

    name: str
    zarr: str
    nbytes: int
    spark: str
    numpy: str

    @property
    def integral(self) -> bool:
        return self.name[0] in "ui"

    @property
    def accumulator_bytes(self) -> int:
        """Width that a mean is summed in: the next wider one for integers up to 32 bits."""
        return {1: 4, 2: 4, 4: 8}.get(self.nbytes, self.nbytes) if self.integral else max(4, self.nbytes)

    @property
    def bounds(self) -> tuple[int, int] | None:
        if not self.integral:
            return None
        bits = 8 * self.nbytes
        return (0, 2**bits - 1) if self.name[0] == "u" else (-(2 ** (bits - 1)), 2 ** (bits - 1) - 1)


DTYPES = {
    d.name: d
    for d in (
        DType("u8", "uint8", 1, "smallint", "<u1"),
        DType("u16", "uint16", 2, "int", "<u2"),
        DType("u32", "uint32", 4, "bigint", "<u4"),
        DType("u64", "uint64", 8, "decimal(20,0)", "<u8"),
        DType("i8", "int8", 1, "tinyint", "<i1"),
        DType("i16", "int16", 2, "smallint", "<i2"),
        DType("i32", "int32", 4, "int", "<i4"),
        DType("i64", "int64", 8, "bigint", "<i8"),
        DType("f16", "float16", 2, "float", "<f2"),
        DType("f32", "float32", 4, "float", "<f4"),
        DType("f64", "float64", 8, "double", "<f8"),
    )
}


def dtype(name: str | DType) -> DType:
    if isinstance(name, DType):
        return name
    found = DTYPES.get(name) or next((d for d in DTYPES.values() if d.zarr == name), None)
    if found is None:
        raise SpecError(f"no element type {name!r}")
    return found


@dataclass(frozen=True)
class Codec:
    """Chunk compression: none, lz4 (raw blocks), zstd, blosc-lz4 or blosc-zstd."""

    name: str = "none"
    level: int | None = None
    shuffle: str = "none"

    @property
    def is_blosc(self) -> bool:
        return self.name.startswith("blosc")

    @property
    def has_device_form(self) -> bool:
        """Whether the format is one that needs no host-only library."""
        return not self.is_blosc

    def check(self) -> None:
        if self.name not in ("none", "lz4", "zstd", "blosc-lz4", "blosc-zstd"):
            raise SpecError(f"no codec {self.name!r}")
        if self.shuffle not in ("none", "byte", "bit"):
            raise SpecError(f"no shuffle {self.shuffle!r}")
        if self.name == "lz4" and self.level is not None and not 1 <= self.level <= 12:
            raise SpecError("lz4 has the levels 1 to 12")
        if self.is_blosc and self.level is not None and not 0 <= self.level <= 9:
            raise SpecError("blosc has the levels 0 to 9")


def ceildiv(a: int, b: int) -> int:
    return -(-a // b)


def align_up(a: int, b: int) -> int:
    return ceildiv(a, b) * b


def ceil_log2(n: int) -> int:
    return (n - 1).bit_length() if n > 1 else 0


def next_pow2(n: int) -> int:
    return 1 << ceil_log2(n)


@dataclass(frozen=True)
class Dim:
    """A dimension, slowest first in an array.  size 0: unbounded, for the first one only."""

    name: str
    size: int
    chunk: int | None = None
    chunks_per_shard: int = 0
    downsample: bool = False
    position: int | None = None
    axis: str = "space"
    unit: str | None = None
    scale: float = 0.0

    @property
    def n(self) -> int:
        return self.size if self.chunk is None else self.chunk

    @property
    def chunk_count(self) -> int:
        """Chunks along the dimension; 1 stands for an unbounded extent."""
        return ceildiv(self.size, self.n) if self.size else 1


def dims(names: Sequence[str], sizes: Sequence[int]) -> list[Dim]:
    """One dimension for each name; chunks as large as the dimension, stored in the order given."""
    if len(names) != len(sizes):
        raise SpecError("as many names as sizes are needed")
    return [Dim(n, s, chunk=s or 1, position=i) for i, (n, s) in enumerate(zip(names, sizes))]


def with_chunks(ds: Sequence[Dim], chunks: Sequence[int]) -> list[Dim]:
    return [replace(d, chunk=c) for d, c in zip(ds, chunks, strict=True)]


def with_storage_order(ds: Sequence[Dim], order: Iterable[str]) -> list[Dim]:
    """Store the dimensions in the order of these names."""
    place = {name: i for i, name in enumerate(order)}
    if sorted(place) != sorted(d.name for d in ds) or len(place) != len(ds):
        raise SpecError("the storage order must name every dimension once")
    return [replace(d, position=place[d.name]) for d in ds]


def with_downsample(ds: Sequence[Dim], names: Iterable[str]) -> list[Dim]:
    wanted = set(names)
    return [replace(d, downsample=d.downsample or d.name in wanted) for d in ds]


def with_chunk_budget(ds: Sequence[Dim], elements: int, ratios: Sequence[int]) -> list[Dim]:
    """Chunks with 2**floor(log2(elements)) elements, edges being powers of two.

    Bit by bit, the dimension with the fewest bits for its ratio gets the next one, the later one on a tie; ratio 0
    means an edge of 1.
    """
    if elements < 1 or not any(ratios):
        return list(ds)
    bits = [0] * len(ds)
    for _ in range(elements.bit_length() - 1):
        lucky = min((i for i, r in enumerate(ratios) if r), key=lambda i: (bits[i] / ratios[i], -i))
        bits[lucky] += 1
    return with_chunks(ds, [1 << b for b in bits])


def with_chunk_bytes(ds: Sequence[Dim], target: int, of: str | DType, ratios: Sequence[int]) -> list[Dim]:
    return with_chunk_budget(ds, target // dtype(of).nbytes, ratios)


def with_shard_counts(ds: Sequence[Dim], counts: Sequence[int]) -> list[Dim]:
    """As many shards as stated along each dimension; 0 leaves one as it is."""
    return [d if not c else replace(d, chunks_per_shard=ceildiv(d.chunk_count, c)) for d, c in zip(ds, counts, strict=True)]


def append_count(ds: Sequence[Dim]) -> int:
    """Leading dimensions with chunks of 1, up to the first that is downsampled; at least one."""
    prefix = next((i for i, d in enumerate(ds) if d.n != 1), len(ds))
    if prefix < 2:
        return 1
    return next((i + 1 for i in range(prefix) if ds[i].downsample), prefix)


def check_dims(ds: Sequence[Dim]) -> None:
    if not 0 < len(ds) <= MAX_RANK:
        raise SpecError(f"an array has 1 to {MAX_RANK} dimensions")
    if len({d.name for d in ds}) != len(ds):
        raise SpecError("dimension names must differ")
    for i, d in enumerate(ds):
        if d.n <= 0:
            raise SpecError(f"{d.name}: the chunk size must be positive")
        if d.size < 0 or (i and not d.size):
            raise SpecError(f"{d.name}: only the first dimension may be unbounded")
        if d.axis not in AXIS_TYPES:
            raise SpecError(f"{d.name}: no axis type {d.axis!r}")
    if not ds[0].size and not ds[0].chunks_per_shard:
        raise SpecError("an unbounded dimension needs chunks_per_shard")
    positions = [i if d.position is None else d.position for i, d in enumerate(ds)]
    if sorted(positions) != list(range(len(ds))):
        raise SpecError("storage positions must be a permutation")
    if positions[: append_count(ds)] != list(range(append_count(ds))):
        raise SpecError("append dimensions keep their place in the storage order")


@dataclass(frozen=True)
class ArraySpec:
    """An array and what becomes of it."""

    dims: tuple[Dim, ...]
    dtype: str = "u16"
    reduce: str = "mean"
    append_reduce: str = "mean"
    codec: Codec = Codec()
    fill: float = 0.0
    max_levels: int = 0
    epochs_per_batch: int = 0
    target_batch_chunks: int = 1024
    shard_alignment: int = 0
    name: str = "0"

    def __post_init__(self) -> None:
        object.__setattr__(self, "dims", tuple(replace(d, position=i if d.position is None else d.position) for i, d in enumerate(self.dims)))
        self.check()

    def check(self) -> None:
        check_dims(self.dims)
        dtype(self.dtype)
        self.codec.check()
        if self.reduce not in REDUCERS:
            raise SpecError(f"no reduction {self.reduce!r}")
        if not 0 <= self.max_levels <= MAX_LEVELS:
            raise SpecError(f"at most {MAX_LEVELS} levels")
        if self.epochs_per_batch < 0 or self.target_batch_chunks < 0 or self.shard_alignment < 0:
            raise SpecError("counts must not be negative")
        if self.append_downsample:
            if self.append_reduce not in FOLDERS:
                raise SpecError("the append dimension folds by mean, mean_fold, min or max")
            if not self.lod_dims:
                raise SpecError("downsampling the append dimension needs a downsampled inner dimension")

    @property
    def rank(self) -> int:
        return len(self.dims)

    @property
    def n_append(self) -> int:
        return append_count(self.dims)

    @property
    def append(self) -> tuple[Dim, ...]:
        return self.dims[: self.n_append]

    @property
    def inner(self) -> tuple[Dim, ...]:
        return self.dims[self.n_append :]

    @property
    def lod_dims(self) -> list[str]:
        """Downsampled dimensions other than append ones."""
        return [d.name for d in self.inner if d.downsample]

    @property
    def append_downsample(self) -> bool:
        return self.append[-1].downsample

    @property
    def names(self) -> list[str]:
        return [d.name for d in self.dims]

    @property
    def stored(self) -> tuple[Dim, ...]:
        """Dimensions in storage order."""
        return tuple(sorted(self.dims, key=lambda d: d.position))

    @classmethod
    def of(cls, options: Mapping, **more) -> ArraySpec:
        """From a plain mapping, such as parsed JSON: {"dims": [{"name": ..., ...}], ...}."""
        fields = dict(options) | more
        fields["dims"] = tuple(d if isinstance(d, Dim) else Dim(**d) for d in fields["dims"])
        if isinstance(fields.get("codec"), Mapping):
            fields["codec"] = Codec(**fields["codec"])
        return cls(**fields)
