"""Cells: one row per element, with a column for each dimension and ``value``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.index import flat, idiv, unravel
from tessella.plans.geometry import ArrayPlan
from tessella.plans.spec import ArraySpec, SpecError, dtype


def cells(rows: DataFrame, spec: ArraySpec, index: str | Column = "idx", value: str | Column = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """Cells of elements that come with their flat row-major index; those beyond the array's capacity are left out."""
    plan = ArrayPlan(spec)
    i = F.col(index) if isinstance(index, str) else index
    if plan.capacity is not None:
        rows = rows.where((i >= 0) & (i < plan.capacity))
    coords = unravel(i, [d.size for d in spec.dims], bounded=bool(spec.dims[0].size))
    v = F.col(value) if isinstance(value, str) else value
    return rows.select(*keep, *[c.alias(d.name) for c, d in zip(coords, spec.dims)], v.cast(dtype(spec.dtype).spark).alias("value"))


def beyond_capacity(rows: DataFrame, spec: ArraySpec, index: str = "idx") -> DataFrame:
    """The elements that ``cells`` leaves out: what an append would give back as the rest."""
    capacity = ArrayPlan(spec).capacity
    return rows.where(F.lit(False)) if capacity is None else rows.where(F.col(index) >= capacity)


def index_of(spec: ArraySpec) -> Column:
    """The flat index of a cell."""
    return flat(spec.names, [d.size for d in spec.dims])


def epoch(spec: ArraySpec) -> Column:
    """The flat index of a cell's chunk along the append dimensions."""
    counts = [d.chunk_count for d in spec.append]
    return flat([idiv(d.name, d.n) for d in spec.append], counts)


def inside(frame: DataFrame, spec: ArraySpec, level: int = 0) -> DataFrame:
    """Cells within the extents of a level."""
    tests = [F.col(e.name) < e.size for e in ArrayPlan(spec).extents(level) if e.size]
    return frame.where(reduce(lambda a, b: a & b, tests)) if tests else frame


def box(frame: DataFrame, low: dict[str, int], high: dict[str, int]) -> DataFrame:
    """Cells of a box, ends exclusive; a store that the cells are read from prunes its chunks by these filters."""
    for name, at in low.items():
        frame = frame.where(F.col(name) >= at)
    for name, at in high.items():
        frame = frame.where(F.col(name) < at)
    return frame


def checked(frame: DataFrame, of: str) -> DataFrame:
    """The cells; running them fails on a value that the element type does not hold, or on a null."""
    bounds = dtype(of).bounds
    wrong = F.col("value").isNull()
    if bounds:
        wrong = wrong | (F.col("value") < bounds[0]) | (F.col("value") > bounds[1])
    return frame.withColumn("value", F.when(wrong, F.raise_error(F.concat(F.lit(f"not a {of}: "), F.coalesce(F.col("value").cast("string"), F.lit("null")))).cast(frame.schema["value"].dataType)).otherwise(F.col("value")))


def array_cells(frame: DataFrame, specs: dict[str, ArraySpec], index: str = "idx", value: str = "value") -> DataFrame:
    """Cells of several arrays from one look at (array_id, index, value): array_id, the dimensions of all of them, value.

    A dimension that an array does not have is null.  Elements beyond an array's capacity, and of unknown arrays, are left
    out.  The value has the least type that holds all element types.
    """
    if not specs:
        raise SpecError("no arrays")
    own = {name: F.col("array_id") == name for name in sorted(specs)}
    fits = {}
    for name, spec in specs.items():
        capacity = ArrayPlan(spec).capacity
        fits[name] = own[name] if capacity is None else own[name] & (F.col(index) >= 0) & (F.col(index) < capacity)
    rows = frame.where(reduce(lambda a, b: a | b, fits.values()))
    coords: dict[str, Column] = {}
    for name, spec in sorted(specs.items()):
        for column, d in zip(unravel(F.col(index), [d.size for d in spec.dims], bounded=bool(spec.dims[0].size)), spec.dims):
            before = coords.get(d.name)
            coords[d.name] = F.when(own[name], column) if before is None else before.when(own[name], column)
    values = F.coalesce(*[F.when(own[name], F.col(value).cast(dtype(spec.dtype).spark)) for name, spec in sorted(specs.items())])
    return rows.select("array_id", *[c.alias(n) for n, c in coords.items()], values.alias("value"))


def per_array(frame: DataFrame, specs: dict[str, ArraySpec], make) -> DataFrame:
    """Apply ``make(rows, spec)`` to the rows of every array_id and put the results together.

    Arrays are told apart by a column, so elements of several may come in any order.  ``make`` may be anything, so the
    source is read for every array: ``array_cells`` makes cells from one look at it.
    """
    if not specs:
        raise SpecError("no arrays")
    parts = [make(frame.where(F.col("array_id") == name), spec).withColumn("array_id", F.lit(name)) for name, spec in sorted(specs.items())]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
