"""Index algebra, as Column expressions that run in generated code and as driver functions for plans."""

from __future__ import annotations

from collections.abc import Sequence
from math import prod

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.plans.geometry import strides


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def idiv(a: str | Column, b: int | Column) -> Column:
    """Integer division; truncates toward zero, as for C integers."""
    b = F.lit(b) if isinstance(b, int) else b
    return F.call_function("div", _col(a).cast("bigint"), b.cast("bigint"))


def ceil_div(a: str | Column, b: int) -> Column:
    return idiv(_col(a) + (b - 1), b)


def unravel(index: str | Column, shape: Sequence[int], bounded: bool = True) -> list[Column]:
    """Coordinates of a flat index, the last dimension being the fastest; the first may be unbounded."""
    out = []
    for d, (size, step) in enumerate(zip(shape, strides(list(shape)))):
        c = idiv(index, step) if step > 1 else _col(index).cast("bigint")
        out.append(c if d == 0 and not bounded else c % size)
    return out


def unravel_first_fastest(index: str | Column, shape: Sequence[int]) -> list[Column]:
    return [idiv(index, prod(shape[:d])) % size for d, size in enumerate(shape)]


def ravel(coords: Sequence[str | Column], steps: Sequence[int]) -> Column:
    """Dot product of coordinates and strides."""
    total = F.lit(0).cast("bigint")
    for c, s in zip(coords, steps):
        total = total + _col(c).cast("bigint") * s
    return total


def flat(coords: Sequence[str | Column], shape: Sequence[int]) -> Column:
    return ravel(coords, strides(list(shape)))


def offset_of(index: str | Column, shape: Sequence[int], steps: Sequence[int]) -> Column:
    """Unravel by one shape, then dot with other strides: where an element goes when the layout changes."""
    return ravel(unravel(index, shape), steps)


def permuted(array: str | Column, p: Sequence[int]) -> Column:
    """out[i] = array[p[i]]"""
    return F.array(*[_col(array)[i] for i in p])


def morton_key(coords: Sequence[str | Column], bits: int) -> Column:
    """Bit-interleaved key; the last dimension has the most significant bit of each digit."""
    key = F.lit(0).cast("bigint")
    n = len(coords)
    for b in range(bits):
        for d, c in enumerate(coords):
            key = key.bitwiseOR(F.shiftleft(F.shiftright(_col(c).cast("bigint"), b).bitwiseAND(F.lit(1).cast("bigint")), b * n + d))
    return key


def morton_rank(shape: Sequence[int], coords: Sequence[int]) -> int:
    """Number of in-bounds cells whose interleaved key is less: the compacted Morton rank."""
    n, bits = len(shape), max(1, max(s - 1 for s in shape).bit_length())

    def inside(base: Sequence[int], edge: int) -> int:
        return prod(max(0, min(s - b, edge)) for s, b in zip(shape, base))

    rank, corner = 0, [0] * n
    for b in reversed(range(bits)):
        digit = sum((coords[d] >> b & 1) << d for d in range(n))
        for below in range(digit):
            rank += inside([corner[d] + ((below >> d & 1) << b) for d in range(n)], 1 << b)
        for d in range(n):
            corner[d] += (digit >> d & 1) << b
    return rank


def voxel_code(coords: Sequence[str | Column], bits: int = 3) -> Column:
    """Coordinates in fields of so many bits, the last one lowest."""
    code = F.lit(0).cast("bigint")
    for c in coords:
        code = F.shiftleft(code, bits).bitwiseOR(_col(c).cast("bigint").bitwiseAND(F.lit((1 << bits) - 1).cast("bigint")))
    return code


_HALF = (1 << 32) - 1


def _low(x: Column, bits: int) -> Column:
    return x.bitwiseAND(F.lit((1 << bits) - 1).cast("bigint"))


def _high(x: Column, bits: int) -> Column:
    return F.shiftrightunsigned(x, bits)


def wrapping_add(a: Column, b: Column) -> Column:
    """a + b modulo 2**64, where Spark's own sum is an error beyond 63 bits."""
    low = _low(a, 32) + _low(b, 32)
    return F.shiftleft(_high(a, 32) + _high(b, 32) + _high(low, 32), 32).bitwiseOR(_low(low, 32))


def wrapping_multiply(a: Column, factor: int) -> Column:
    """a * factor modulo 2**64: products of 16 and 32 bits, which fit, moved to their places."""
    low, high = F.lit(factor & _HALF).cast("bigint"), F.lit(factor >> 32 & _HALF).cast("bigint")
    whole = wrapping_add(_low(a, 16) * low, F.shiftleft(_low(_high(a, 16), 16) * low, 16))
    cross = _low(_high(a, 32), 16) * low + F.shiftleft(_low(_high(a, 48) * low, 16), 16)
    cross = cross + _low(a, 16) * high + F.shiftleft(_low(_low(_high(a, 16), 16) * high, 16), 16)
    return wrapping_add(whole, F.shiftleft(cross, 32))
