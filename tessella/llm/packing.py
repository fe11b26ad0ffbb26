"""Best-fit packing into bins of several permitted lengths.

Documents longer than the longest bin are cut: every full piece is a bin of its own, the rest is packed.  Items are
dealt into groups of about ``GROUP_TOKENS`` tokens, or ``GROUP_ROWS`` rows if these are fewer, by a hash of their row, so that rows with equal ids and lengths spread
too, and each group is packed on its own, longest item first: an item goes to the open bin with the least room that holds it.  Where none does, a bin opens, of the length with the
least cost per token that it can expect to hold.  At the end each bin shrinks to the least permitted length that holds
its contents.  A bin's cost is a fixed part, its length, and a part that grows with the square of the length.

Defined results: a null or negative length counts as 0; an item of length 0 needs no bin and has the bin_id null;
repeated rows are items of their own; a null doc_id is packed like any other.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, runs, stored

LENGTHS = (512, 1024, 2048, 4096, 8192)
GROUP_TOKENS, GROUP_ROWS = 4_000_000, 200_000
#: A bin's cost besides its length: a fixed part, and the length's square over SQUARE times the longest length.
FIXED, SQUARE = 64, 16


def costs(lengths: Sequence[int]) -> dict[int, float]:
    return {c: FIXED + c + c * c / (SQUARE * max(lengths)) for c in lengths}


class Bins:
    """Best fit over open bins, which are kept by the room left in them; a bit set tells which rooms occur."""

    def __init__(self, lengths: Sequence[int]):
        self.lengths, self.cost = sorted(lengths), costs(lengths)
        self.by_room: list[list[int]] = [[] for _ in range(self.lengths[-1] + 1)]
        self.rooms = 0
        self.capacity: list[int] = []
        self.used: list[int] = []

    def _open(self, size: int, rest: int) -> int:
        """A new bin for an item, when ``rest`` tokens of items no longer than it are still to come."""
        best = min((c for c in self.lengths if c >= size), key=lambda c: (self.cost[c] / min(c, size + rest), c))
        self.capacity.append(best)
        self.used.append(0)
        return len(self.used) - 1

    def put(self, size: int, rest: int) -> tuple[int, int]:
        """Place an item; returns its bin and its offset there."""
        fits = self.rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            bin_ = self.by_room[room].pop()
            if not self.by_room[room]:
                self.rooms &= ~(1 << room)
        else:
            bin_ = self._open(size, rest)
        offset = self.used[bin_]
        self.used[bin_] += size
        room = self.capacity[bin_] - self.used[bin_]
        if room:
            self.by_room[room].append(bin_)
            self.rooms |= 1 << room
        return bin_, offset

    def shrink(self) -> None:
        self.capacity = [next(c for c in self.lengths if c >= u) for u in self.used]


_OUT = "doc_id long, piece long, piece_start long, n_tokens long, bin_id long, bin_offset long, bin_length long, bin_used long"


def pack_sizes(sizes: list[int], lengths: Sequence[int] = LENGTHS) -> tuple[list[tuple[int, int]], Bins]:
    """Pack sizes that come in descending order; returns (bin, offset) of each and the bins."""
    bins, rest, out = Bins(lengths), sum(sizes), []
    for size in sizes:
        rest -= size
        out.append(bins.put(size, rest))
    bins.shrink()
    return out, bins


def _packed(lengths: Sequence[int]):
    longest = max(lengths)
    names = [x.split()[0] for x in _OUT.split(", ")]

    def rows(ids: list, sizes: list[int], base: int):
        """Rows of a group, whose documents come with the longest rest first."""
        whole = [n // longest for n in sizes]
        rests = [n - w * longest for n, w in zip(sizes, whole)]
        places, bins = pack_sizes([r for r in rests if r], lengths)
        number = len(bins.used)
        for doc, n, full, rest, (bin_, offset) in zip(ids, sizes, whole, rests, [*places, *[(0, 0)] * rests.count(0)]):
            for piece in range(full):
                yield doc, piece, piece * longest, longest, base + number, 0, longest, longest
                number += 1
            if rest:
                yield doc, full, full * longest, rest, base + bin_, offset, bins.capacity[bin_], bins.used[bin_]
            elif not n:
                yield doc, 0, 0, 0, None, None, None, None

    def run(batches):
        for table in runs(batches, ["group"]):
            base = table.column("group")[0].as_py() << 32
            found = rows(table.column("doc_id").to_pylist(), table.column("n").to_pylist(), base)
            while part := list(islice(found, 50_000)):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*part)], names=names)

    return run


def pack(docs: DataFrame, lengths: Sequence[int] = LENGTHS, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """One row per piece of a document of (doc_id, n_tokens): where in the document it starts, its bin and place there.

    A document of at most the longest length is one piece; one whose length is a multiple of it has no rest.  Every bin
    has a bin_id of its own: the group in the leading bits, then a number within it.
    """
    longest = max(lengths)
    counted = docs.select("doc_id", F.greatest(F.coalesce(F.col("n_tokens").cast("long"), F.lit(0)), F.lit(0)).alias("n"))
    # Written once, with a number for every row: lengths are not computed again, and a task that runs again finds the same.
    items = stored(counted.withColumn("row", F.monotonically_increasing_id()), "lengths")
    total, n_rows = items.agg(F.sum("n"), F.count("*")).first()
    groups = max(1, -(-(total or 0) // group_tokens), -(-n_rows // GROUP_ROWS))
    dealt = (
        items.withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups)))
        .withColumn("rest", F.expr(f"n % {longest}"))
        .repartition("group")
        .sortWithinPartitions("group", F.desc("rest"), "doc_id", "n", "row")
    )
    return map_arrow(dealt.select("group", "doc_id", "n"), _packed(lengths), _OUT)


def word_counts(docs: DataFrame) -> DataFrame:
    """doc_id and the number of white-space separated words as n_tokens; null texts have none."""
    # Every word becomes one letter, then the spaces go.
    letters = F.translate(F.regexp_replace(F.coalesce("text", F.lit("")), "[^ \\n\\r\\t\\x0b\\x0c]+", "x"), " \n\r\t\x0b\x0c", "")
    return docs.select("doc_id", F.length(letters).cast("long").alias("n_tokens"))
