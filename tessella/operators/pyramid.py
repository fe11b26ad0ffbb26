"""Multiscale pyramids: every level halves the downsampled dimensions of the level before it.

A window is what exists of a 2x..x2 block, so windows at the end of an odd extent are smaller.  Each level is made of
the stored values of the one before: an integer mean truncates toward zero at every level.
"""

from __future__ import annotations

from functools import reduce as _reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.index import idiv
from tessella.plans.geometry import ArrayPlan
from tessella.plans.spec import SpecError, dtype

#: Windows hold 2 ** (downsampled dimensions) values at most, so lists of them are short.
_SORTED = {"median": 0, "max_sup": 0, "min_sup": 0}


def reducer(method: str, of: str, value: str = "value") -> Column:
    """The aggregate that makes a window's value.

    median is the upper one; max_sup and min_sup are the second highest and second lowest value, copies counting, and a
    lone value is itself.
    """
    d, v = dtype(of), F.col(value)
    if method == "mean":
        if of == "u64":
            out = F.floor(F.sum(v) / F.count(v).cast("decimal(20,0)"))
        else:
            out = F.call_function("div", F.sum(v), F.count(v)) if d.integral else F.avg(v)
    elif method in ("min", "max"):
        out = getattr(F, method)(v)
    elif method == "median":
        values = F.sort_array(F.collect_list(v))
        out = F.get(values, F.call_function("div", F.count(v), F.lit(2)).cast("int"))
    elif method in ("max_sup", "min_sup"):
        values = F.sort_array(F.collect_list(v), method == "min_sup")
        out = F.coalesce(F.get(values, F.lit(1)), F.get(values, F.lit(0)))
    else:
        raise SpecError(f"no reduction {method!r}")
    return out.cast(d.spark).alias("value")


def reduce_level(cells: DataFrame, plan: ArrayPlan, by: tuple[str, ...] = (), first: tuple[Column, ...] = ()) -> DataFrame:
    """The next level of cells.  ``first`` are grouping expressions that the rows are already partitioned by."""
    lod = set(plan.spec.lod_dims)
    keys = [idiv(n, 2).alias(n) if n in lod else F.col(n) for n in plan.spec.names]
    return cells.groupBy(*first, *by, *keys).agg(reducer(plan.spec.reduce, plan.spec.dtype))


def pyramid(cells: DataFrame, plan: ArrayPlan, by: tuple[str, ...] = ()) -> DataFrame:
    """All levels of (dimensions, value), told apart by ``level``.

    The cells are dealt out once, by the block of the coarsest level that they fall into and by the other dimensions;
    every level groups within such a block, so no level after that shuffles.
    """
    spec, top = plan.spec, plan.levels - 1
    if not top:
        return cells.select(F.lit(0).alias("level"), *by, *spec.names, "value")
    lod = set(spec.lod_dims)
    # Neighbouring blocks along the last append dimension may stay together; other keys spread the blocks.
    blocks = {f"__{n}": (idiv(n, 1 << top) if n in lod else F.col(n)) for n in spec.names}
    frame = cells.select(*by, *spec.names, "value", *[c.alias(n) for n, c in blocks.items()])
    frame = frame.repartition(*by, *blocks)
    levels = [frame]
    keys = [idiv(n, 2).alias(n) if n in lod else F.col(n) for n in spec.names]
    for _ in range(top):
        levels.append(levels[-1].groupBy(*by, *blocks, *keys).agg(reducer(spec.reduce, spec.dtype)))
    return _reduce(DataFrame.unionByName, [x.select(F.lit(i).alias("level"), *by, *spec.names, "value") for i, x in enumerate(levels)])
