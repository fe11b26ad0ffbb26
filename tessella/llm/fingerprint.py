"""Document fingerprints: invertible Bloom lookup tables over paragraph digests.

A paragraph is a line, or a piece of one: a line is cut after every word whose digest is divisible by ``CUT``, so long
lines have pieces of some words whose borders depend on the words there alone.  The k-th copy of a paragraph counts as
a paragraph of its own.  A paragraph's 64-bit digest goes to three cells, one in each third of the table; a cell
holds count, sum of digests and sum of check values, all modulo 2**n.  Two tables of one size subtract cell by cell;
cells with a single digest left are peeled until nothing is left, which gives the digests that differ.  If peeling
gets stuck, both tables are built again with ``GROWTH`` times the cells and other places for the digests.

likeness = shared paragraphs / all paragraphs of both, from the counts and the recovered digests; 1.0 for two texts
without a paragraph.  The published fingerprint is the table of ``CELLS`` cells in hexadecimal, led by the count.
Null texts are empty.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, steps
from .ordering import part_of, splitters
from .words import Words, mix

CELLS, GROWTH, CUT = 12, 4, 6


def paragraphs(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Digests of the paragraphs of all texts, and where those of each text begin."""
    raws = [t.encode("utf-8", "surrogatepass") for t in texts]
    words = Words(raws)
    joined = np.frombuffer(b" ".join(raws) + b" ", np.uint8)
    n = len(words.hashes)
    offsets = np.zeros(len(texts) + 1, np.int64)
    if not n:
        return np.zeros(0, np.uint64), offsets
    # What stands between a word and the next belongs to the word, so that punctuation counts.
    starts, nexts = words.start, np.append(words.start[1:], len(joined))
    with np.errstate(over="ignore"):
        weight = joined.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(weight, dtype=np.uint64)])
    last_of_text = np.zeros(n, bool)
    ends = words.first[1:][words.first[1:] > words.first[:-1]] - 1
    last_of_text[ends] = True
    text_end = np.append(words.at[1:] - 1, len(joined) - 1)
    owner = np.searchsorted(words.first, np.arange(n), side="right") - 1
    nexts = np.minimum(nexts, text_end[owner])
    newline = np.concatenate([[0], np.cumsum(joined == 10)])
    with np.errstate(over="ignore"):
        unit = mix(words.hashes + (sums[nexts] - sums[words.end]) * np.uint64(3) + np.uint64(1))
    cut = last_of_text | (newline[nexts] > newline[words.end]) | (words.hashes % np.uint64(CUT) == 0)
    first = np.concatenate([[0], np.flatnonzero(cut)[:-1] + 1])
    with np.errstate(over="ignore"):
        place = (np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))).astype(np.uint64)
        digests = mix(np.add.reduceat(mix(unit + place * np.uint64(0xD6E8FEB86659FD93)), first))
    text = owner[first]
    # The k-th copy within a text gets k mixed in.
    order = np.lexsort((digests, text))
    same = np.zeros(len(digests), bool)
    same[1:] = (digests[order][1:] == digests[order][:-1]) & (text[order][1:] == text[order][:-1])
    group = np.flatnonzero(~same)
    copy = np.arange(len(digests)) - np.repeat(group, np.diff(np.append(group, len(digests))))
    with np.errstate(over="ignore"):
        digests[order] = mix(digests[order] + copy.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    np.cumsum(np.bincount(text, minlength=len(texts)), out=offsets[1:])
    return digests, offsets


def _check(digests: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(digests ^ np.uint64(0x5851F42D4C957F2D))


def _cells(digests: np.ndarray, size: int) -> list[np.ndarray]:
    third = np.uint64(size // 3)
    with np.errstate(over="ignore"):
        return [(mix(digests + np.uint64((i + size) * 0x632BE59BD9B4E019 % (1 << 64))) % third + np.uint64(i) * third).astype(np.int64) for i in range(3)]


class Sketches:
    """Tables of several texts, ``size`` cells each (a multiple of three)."""

    def __init__(self, texts: int, size: int):
        self.size = size
        self.count = np.zeros(texts * size, np.int64)
        self.total = np.zeros(texts * size, np.uint64)
        self.check = np.zeros(texts * size, np.uint64)

    def add(self, text: np.ndarray, digests: np.ndarray, sign: np.ndarray | int = 1) -> Sketches:
        sign = np.broadcast_to(np.asarray(sign, np.int64), digests.shape)
        one = sign.view(np.uint64) if sign.flags.c_contiguous else sign.astype(np.uint64)
        with np.errstate(over="ignore"):
            total, check = digests * one, _check(digests) * one
            for cell in _cells(digests, self.size):
                at = text * self.size + cell
                np.add.at(self.count, at, sign)
                np.add.at(self.total, at, total)
                np.add.at(self.check, at, check)
        return self

    def minus(self, a: np.ndarray, other: Sketches, b: np.ndarray) -> Sketches:
        """The tables a of this minus the tables b of the other."""
        out = Sketches(0, self.size)
        with np.errstate(over="ignore"):
            for name in ("count", "total", "check"):
                x, y = getattr(self, name).reshape(-1, self.size), getattr(other, name).reshape(-1, self.size)
                setattr(out, name, (x[a] - y[b]).ravel())
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Recovered (table, digest, sign), and for each table whether nothing is left in it."""
        found_t, found_d, found_s = [], [], []
        tables = len(self.count) // self.size
        live = np.flatnonzero(np.abs(self.count) == 1)
        while len(live):
            sign = self.count[live]
            with np.errstate(over="ignore"):
                digest = self.total[live] * sign.astype(np.uint64)
                pure = (np.abs(sign) == 1) & (_check(digest) * sign.astype(np.uint64) == self.check[live])
            text, digest, sign = live[pure] // self.size, digest[pure], sign[pure]
            if not len(text):
                break
            order = np.lexsort((digest, text))
            text, digest, sign = text[order], digest[order], sign[order]
            new = np.ones(len(text), bool)
            new[1:] = (text[1:] != text[:-1]) | (digest[1:] != digest[:-1])
            text, digest, sign = text[new], digest[new], sign[new]
            self.add(text, digest, -sign)
            found_t.append(text)
            found_d.append(digest)
            found_s.append(sign)
            touched = np.unique(np.concatenate([text * self.size + c for c in _cells(digest, self.size)]))
            live = touched[np.abs(self.count[touched]) == 1]
        clear = ~((self.count != 0) | (self.total != 0) | (self.check != 0)).reshape(tables, self.size).any(axis=1) if tables else np.zeros(0, bool)
        empty = np.zeros(0, np.int64)
        return np.concatenate(found_t or [empty]), np.concatenate(found_d or [empty.astype(np.uint64)]), np.concatenate(found_s or [empty]), clear


def _select(digests: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Digests of some texts, each with the place of its text in ``rows``."""
    n = np.diff(offsets)[rows]
    where = np.arange(n.sum()) + np.repeat(offsets[rows] - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
    return np.repeat(np.arange(len(rows)), n), digests[where]


def differences(digests: np.ndarray, offsets: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each pair of texts: paragraphs only a has, only b has, and the cells that sufficed."""
    only = np.zeros((2, len(a)), np.int64)
    cells = np.zeros(len(a), np.int64)
    todo, size = np.arange(len(a)), CELLS
    while len(todo):
        stuck = []
        step = max(1, 600_000 // size)
        for lo in range(0, len(todo), step):
            part = todo[lo : lo + step]
            rows, where = np.unique(np.concatenate([a[part], b[part]]), return_inverse=True)
            tables = Sketches(len(rows), size).add(*_select(digests, offsets, rows))
            pair, _, sign, clear = tables.minus(where[: len(part)], tables, where[len(part) :]).peel()
            got = np.stack([np.bincount(pair[sign == s], minlength=len(part)) for s in (1, -1)])
            only[:, part[clear]], cells[part[clear]] = got[:, clear], size
            stuck.append(part[~clear])
        todo, size = np.concatenate(stuck), size * GROWTH
    return only[0], only[1], cells


def likeness(offsets: np.ndarray, a: np.ndarray, b: np.ndarray, only_a: np.ndarray, only_b: np.ndarray) -> np.ndarray:
    n = np.diff(offsets)
    shared = (n[a] + n[b] - only_a - only_b) / 2
    every = shared + only_a + only_b
    return np.where(every > 0, shared / np.maximum(every, 1), 1.0)


def published(digests: np.ndarray, offsets: np.ndarray) -> list[str]:
    """The fingerprint of each text: paragraph count and the smallest table, in hexadecimal."""
    texts = len(offsets) - 1
    s = Sketches(texts, CELLS).add(np.repeat(np.arange(texts), np.diff(offsets)), digests)
    cells = np.empty((texts, CELLS), dtype=[("count", ">u4"), ("total", ">u8"), ("check", ">u4")])
    for name in ("count", "total", "check"):
        cells[name] = getattr(s, name).reshape(texts, CELLS).astype(cells.dtype[name])
    return [f"{n:08x}" + row.tobytes().hex() for n, row in zip(np.diff(offsets), cells)]


def edited(text: str, following: str) -> str:
    """The text with its last floor(n / 2) code points replaced by the first as many (or all) of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_paragraphs long, cells_edited long, cells_next long"


def compare(ids: list, texts: list[str], following: list[str]) -> pa.RecordBatch:
    """Rows of the result for texts and the texts that follow them."""
    n = len(texts)
    changed = [edited(t, f) for t, f in zip(texts, following)]
    digests, offsets = paragraphs([*texts, *changed, *following])
    own = np.arange(n)
    a, b = np.concatenate([own, own]), np.concatenate([own + n, own + 2 * n])
    only_a, only_b, cells = differences(digests, offsets, a, b)
    near = likeness(offsets, a, b, only_a, only_b)
    prints = published(digests[: offsets[2 * n]], offsets[: 2 * n + 1])
    columns = [
        pa.array(ids, pa.int64()),
        pa.array([len(t) for t in texts], pa.int64()),
        pa.array([sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed]),
        pa.array(prints[:n]),
        pa.array(prints[n:]),
        pa.array(near[:n]),
        pa.array(near[n:]),
        pa.array(np.diff(offsets)[:n]),
        pa.array(cells[:n]),
        pa.array(cells[n:]),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _OUT.split(", ")])


def _ordered(batches):
    """Rows sorted by part, doc_id, text; a part ends with one row that is only there to be looked at."""
    last: tuple | None = None
    ids, texts, following = [], [], []
    size, ended = 0, None
    for batch in batches:
        for sliced, own in steps(batch, "text"):
            parts, docs, extra = (sliced.column(sliced.schema.get_field_index(c)).to_pylist() for c in ("part", "doc_id", "ahead"))
            for part, doc, ahead, text in zip(parts, docs, extra, own):
                if part == ended:
                    continue
                if last is not None and last[0] == part:
                    ids.append(last[1])
                    texts.append(last[2])
                    following.append(text)
                    size += len(last[2]) + len(text)
                last, ended = (None, part) if ahead else ((part, doc, text), None)
            if size >= 1_000_000:
                yield compare(ids, texts, following)
                ids, texts, following, size = [], [], [], 0
    if ids:
        yield compare(ids, texts, following)


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint every text, its edited version and the likeness to the next text, by ascending doc_id.

    Ties in doc_id are ordered by text, null ids come first, the last document is followed by the first.  An empty
    table gives no rows; the only row of a table follows itself.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ids = docs.select("doc_id")
    bounds = splitters(ids.where("doc_id is not null"))
    low = ids.agg(F.min("doc_id").alias("low"), F.count(F.when(F.col("doc_id").isNull(), 1)).alias("nulls")).first()
    placed = docs.withColumn("part", part_of(bounds)("doc_id"))
    # A splitter's rows are the first of their part; the row that leads the whole order also ends the last part.
    # The splitters, at most ``ordering.MOST_PARTS`` numbers, are looked up in a broadcast table.
    cuts = docs.sparkSession.createDataFrame([(b,) for b in bounds], "bound long")
    placed = placed.join(F.broadcast(cuts), F.col("doc_id") == F.col("bound"), "left")
    is_first = F.col("bound").isNotNull()
    leads = F.col("doc_id").isNull() if low["nulls"] else F.col("doc_id") == low["low"]
    copies = F.array_compact(
        F.array(
            F.struct("part", F.lit(False).alias("ahead")),
            F.when(is_first & (F.col("part") > 0), F.struct((F.col("part") - 1).alias("part"), F.lit(True).alias("ahead"))),
            F.when(leads, F.struct(F.lit(len(bounds)).alias("part"), F.lit(True).alias("ahead"))),
        )
    )
    spread = placed.withColumn("to", F.explode(copies)).select("to.part", "to.ahead", "doc_id", "text")
    ordered = spread.repartition("part").sortWithinPartitions("part", "ahead", "doc_id", "text")
    return map_arrow(ordered, _ordered, _OUT)
