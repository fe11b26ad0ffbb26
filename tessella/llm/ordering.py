"""Rows in ascending doc_id order over many partitions, with one shuffle and nothing unbounded on the driver.

Splitters are ids that occur, found by a quantile sketch over the id column; ``part`` is the number of splitters that
are not above the id.  The first row of a part is therefore known by its id alone, which lets the part before it get a
copy without a second look at the table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows per part, about, until there are MOST_PARTS parts, which then grow.  Parts are read as streams.
PART_ROWS, MOST_PARTS = 1_000, 20_000


def splitters(ids: DataFrame, rows: int = PART_ROWS) -> list[int]:
    """Ascending ids (column doc_id) that cut the table into parts of about ``rows`` rows; none for a small table."""
    n = ids.count()
    parts = min(MOST_PARTS, -(-n // rows))
    if parts < 2:
        return []
    wanted = [k / parts for k in range(1, parts)]
    found = ids.agg(F.expr(f"approx_percentile(doc_id, array({','.join(map(repr, wanted))}), {10 * parts})").alias("q")).first()["q"]
    return sorted(set(found or []))


def part_of(bounds: list[int]):
    """Column function: the part of a doc_id; null ids come before all others."""
    cuts = np.array(bounds, np.int64)

    @F.pandas_udf("int")
    def part(ids: pd.Series) -> pd.Series:
        known = ids.notna().to_numpy()
        out = np.zeros(len(ids), np.int32)
        out[known] = np.searchsorted(cuts, ids[known].to_numpy().astype(np.int64), side="right")
        return pd.Series(out)

    return part if len(bounds) else lambda c: F.lit(0)

