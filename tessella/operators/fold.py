"""Folding along the growing append dimension: at level l, 2**l consecutive epochs become one.

Whole epochs are merged, element by element: with chunks of n frames, frame w of the result's epoch e is made of the
frames w of its epochs.  Every index of the append dimensions before the last has its own sequence of epochs.
"""

from __future__ import annotations

from functools import reduce as _reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.index import idiv
from tessella.operators.pyramid import pyramid
from tessella.plans.geometry import ArrayPlan
from tessella.plans.spec import SpecError, dtype


def folder(method: str, of: str, level: int, order: Column, value: str = "value") -> Column:
    """The aggregate of up to 2**level values in epoch order.

    mean is the truncated mean of the values there are.  mean_fold is the running form for integers: from the second
    value on, acc = (acc + x) >> level, and the last acc as it is; for floats it is the mean.
    """
    d, v = dtype(of), F.col(value)
    if method == "mean_fold" and d.integral and d.nbytes < 8:
        values = F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), v.cast("bigint").alias("v")))), lambda s: s["v"])
        rest = F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(1)))
        out = F.aggregate(rest, F.get(values, F.lit(0)), lambda acc, x: F.shiftright(acc + x, level))
    elif method == "mean_fold" and d.integral:
        out = F.sum(v)  # the running form never divides 64-bit integers
    elif method in ("mean", "mean_fold"):
        if of == "u64":
            out = F.floor(F.sum(v) / F.count(v).cast("decimal(20,0)"))
        else:
            out = F.call_function("div", F.sum(v), F.count(v)) if d.integral else F.avg(v)
    elif method in ("min", "max"):
        out = getattr(F, method)(v)
    else:
        raise SpecError(f"no fold {method!r}")
    return out.cast(d.spark).alias("value")


def folded_coordinate(plan: ArrayPlan, level: Column | int) -> Column:
    a = plan.spec.append[-1]
    shift = F.lit(level) if isinstance(level, int) else level
    return (F.call_function("shiftright", idiv(a.name, a.n), shift.cast("int")) * a.n + F.col(a.name) % a.n).cast("bigint")


def fold_level(cells: DataFrame, plan: ArrayPlan, level: int, by: tuple[str, ...] = (), counted: bool = False) -> DataFrame:
    """One level's cells, folded; with ``counted`` also the number of epochs that each came from."""
    a = plan.spec.append[-1]
    keys = [folded_coordinate(plan, level).alias(n) if n == a.name else F.col(n) for n in plan.spec.names]
    frame = cells.withColumn("__epoch", idiv(a.name, a.n))
    out = frame.groupBy(*by, *keys).agg(folder(plan.spec.append_reduce, plan.spec.dtype, level, F.col("__epoch")), F.count("*").alias("epochs"))
    return out.select(*by, *plan.spec.names, "value", *(["epochs"] if counted else []))


def fold(levels: DataFrame, plan: ArrayPlan, by: tuple[str, ...] = (), counted: bool = False) -> DataFrame:
    """All levels of a pyramid, each folded by its own number of epochs; level 0 stays as it is."""
    if not plan.spec.append_downsample:
        return levels
    parts = []
    for level in range(plan.levels):
        own = levels.where(F.col("level") == level).drop("level")
        done = fold_level(own, plan, level, by, counted) if level else own.select(*own.columns, *([F.lit(1).cast("bigint").alias("epochs")] if counted else []))
        parts.append(done.withColumn("level", F.lit(level)))
    return _reduce(DataFrame.unionByName, parts).select("level", *by, *plan.spec.names, "value", *(["epochs"] if counted else []))


def all_levels(cells: DataFrame, plan: ArrayPlan, by: tuple[str, ...] = ()) -> DataFrame:
    """The whole multiscale array: the pyramid over inner dimensions, folded along the append dimension."""
    return fold(pyramid(cells, plan, by), plan, by)


def emits(epoch: Column, level: int) -> Column:
    """Whether a level is complete after this epoch."""
    return (epoch + 1) % (1 << level) == 0
