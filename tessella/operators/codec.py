"""Chunk compression as a map over rows."""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from tessella.plans.spec import Codec, SpecError


def available(codec: Codec) -> bool:
    """Blosc needs a library of its own."""
    if not codec.is_blosc:
        return True
    try:
        import blosc2  # noqa: F401
    except ImportError:
        return False
    return True


def require(codec: Codec) -> None:
    codec.check()
    if not available(codec):
        raise SpecError(f"codec {codec.name} is not available in this build")


def worst_size(codec: Codec, nbytes: int) -> int:
    """A bound of the compressed size."""
    if codec.name == "none":
        return nbytes
    if codec.name == "lz4":
        return nbytes + nbytes // 255 + 16
    if codec.name == "zstd":
        return nbytes + (nbytes >> 8) + (max(0, (128 << 10) - nbytes) >> 11) + 64
    return nbytes + 32


@lru_cache(maxsize=32)
def _coder(name: str, level: int | None):
    if name == "zstd":
        return zstandard.ZstdCompressor(level=3 if level is None else level)
    if name == "lz4":
        return pa.Codec("lz4_raw", level)
    return None


def compress(data: bytes, codec: Codec, typesize: int = 1) -> bytes:
    if codec.name == "none":
        return data
    if codec.name == "zstd":
        return _coder("zstd", codec.level).compress(data)
    if codec.name == "lz4":
        return bytes(_coder("lz4", codec.level).compress(data))
    require(codec)
    import blosc2

    shuffles = {"none": blosc2.Filter.NOFILTER, "byte": blosc2.Filter.SHUFFLE, "bit": blosc2.Filter.BITSHUFFLE}
    inner = blosc2.Codec.LZ4 if codec.name == "blosc-lz4" else blosc2.Codec.ZSTD
    return blosc2.compress2(data, codec=inner, clevel=5 if codec.level is None else codec.level, filters=[shuffles[codec.shuffle]], typesize=typesize)


def decompress(data: bytes, codec: Codec, nbytes: int) -> bytes:
    if codec.name == "none":
        return data
    if codec.name == "zstd":
        return zstandard.ZstdDecompressor().decompress(data, max_output_size=nbytes)
    if codec.name == "lz4":
        return bytes(_coder("lz4", None).decompress(data, nbytes))
    require(codec)
    import blosc2

    return blosc2.decompress2(data)


def _mapped(source: str, target: str, function):
    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(source)
            out = [None if x is None else function(x) for x in batch.column(at).to_pylist()]
            names = [target if n == source else n for n in batch.schema.names]
            columns = [pa.array(out, pa.binary()) if i == at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _schema(frame: DataFrame, source: str, target: str) -> str:
    return ", ".join(f"`{target if n == source else n}` {t}" for n, t in frame.dtypes)


def encode(chunks: DataFrame, codec: Codec, typesize: int = 1) -> DataFrame:
    """Replace ``payload`` by ``data``, its compressed form."""
    require(codec)
    return chunks.mapInArrow(_mapped("payload", "data", lambda x: compress(x, codec, typesize)), _schema(chunks, "payload", "data"))


def decode(chunks: DataFrame, codec: Codec, nbytes: int) -> DataFrame:
    """Replace ``data`` by ``payload``; ``nbytes`` is the size of a whole chunk."""
    require(codec)
    return chunks.mapInArrow(_mapped("data", "payload", lambda x: decompress(x, codec, nbytes)), _schema(chunks, "data", "payload"))
