"""Substring dedup by collinear chaining of shared k-mer seeds.

1. Seeds: winnowed word 5-grams, at least one in every run of ``WINDOW + K - 1`` words.
2. Every seed value has one owner, the first document (and place) that has it.  A later document's seeds are matched to
   their owners, not to each other, so a passage that many documents share costs a match for each of its places.
3. The matches of a document are joined to diagonal segments and the segments are chained per owner: the best chain
   that ends in a segment is found in a Fenwick tree over the owner's positions, with a cost for every word skipped.
4. Chains are aligned word by word: along diagonals, by edit distance in the gaps, by extension at the ends.  The
   parts of at least ``MIN_WORDS`` words whose share of equal words is at least ``IDENTITY`` are the passages.
5. A passage's seeds may all be owned by documents that hold parts of it only.  So every run of ``MIN_WORDS`` words whose
   seeds all have earlier owners, and that is in no exact passage found so far, has an owner too and joins it.  The first
   document with such a run is in no such passage, so every later one finds it, whoever owns its seeds.

Exchanges carry columns of numbers, packed per bucket of seeds or of documents.  A task packs up to ``CHUNK`` places at a
time.  Where ``HOT`` or more of them have one seed, only those of the first document there go on, and the other documents
are matched to it: a seed that a third of all documents have costs one place per chunk, not one per document.  (Which earlier
document such a passage is matched to thus depends on how the table is split, but never whether it is found.)  Words go
to the bucket that compares them, once for each bucket, so a document that many others repeat is spread over them.

Words are as in ``words``, compared without ASCII case.  Null texts are empty.  Rows with a null doc_id and passages
that repeat within one doc_id only are not reported.  Where a doc_id has several texts, each is looked at for itself;
repeated rows count once.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, release, runs, steps, stored, unused
from .words import Words, mix, ngrams

K, WINDOW = 5, 12
MIN_WORDS, IDENTITY = 50, 0.8
#: Score of an unequal word, an equal one having 1: parts with IDENTITY equal words or more have a score of 0 or more.
BAD = -round(IDENTITY / (1 - IDENTITY), 9)
#: Words on each side of a chain that the alignment may reach into.
MARGIN = 64
#: Score lost for every word skipped in either text between two segments; longer skips than MAX_GAP end a chain.
GAP_COST, MAX_GAP = 0.1, 40
#: Places that a task packs at a time, and how many of one seed among them make it a hot one.
CHUNK, HOT = 2_000_000, 64
#: Text bytes per bucket of seeds or documents; beyond MANY buckets they grow up to the second figure.
BUCKET_BYTES, MANY = (8_000_000, 160_000_000), 20_000
#: Asking buckets whose requests to one document make one row.
ASKERS = 4_096

_SEED = ("<u8", "<u4", "<i4", "u1")  # key, row, place, hot
_ROW = ("<i8", "<u4")  # doc_id, tag
_MATCH = ("<i8", "<u4", "<i4", "<i8", "<u4", "<i4")  # doc_id, tag, place, and the same of the owner
_SEGMENT = ("<u4", "<i8", "<u4", "<i8", "<u4", "<i4", "<i4", "<i4", "<i4")  # chain, doc_id, tag, owner, its tag, x0, x1, y0, y1
_REGION = ("<i8", "<u4", "<i4", "<i4")  # doc_id, tag, from, to


def pack(*tables: list[np.ndarray]) -> bytes:
    """Tables of columns as compressed bytes; the bytes of a column lie by significance, as they repeat so."""
    parts = []
    for columns in tables:
        n = len(columns[0])
        parts.append(np.uint32(n).tobytes())
        parts += [np.ascontiguousarray(c).view(np.uint8).reshape(n, c.dtype.itemsize).T.tobytes() for c in columns]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(blob: bytes, *types: tuple[str, ...]) -> list[list[np.ndarray]]:
    raw, at, out = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8), 0, []
    for columns in types:
        n = int(raw[at : at + 4].view("<u4")[0])
        at += 4
        table = []
        for t in columns:
            size = np.dtype(t).itemsize
            table.append(np.ascontiguousarray(raw[at : at + n * size].reshape(size, n).T).view(t).ravel())
            at += n * size
        out.append(table)
    return out


def joined(tables: list[list[np.ndarray]]) -> list[np.ndarray]:
    return [np.concatenate(c) for c in zip(*tables)]


def tag_of(text: bytes) -> int:
    """Tells the texts of one doc_id apart."""
    return zlib.crc32(text)


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets by the leading bits: sorted hashes have sorted buckets."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)


def doc_bucket(docs: np.ndarray, buckets: int) -> np.ndarray:
    return bucket_of(mix(docs.astype(np.int64).view(np.uint64)), buckets)


def _extreme(x: np.ndarray, n: int, of) -> np.ndarray:
    """Least (or greatest) of every n consecutive values."""
    width = 1
    while 2 * width <= n:
        x, width = of(x[:-width], x[width:]), 2 * width
    return of(x[: len(x) - (n - width)], x[n - width :]) if n > width else x


def winnowed(values: np.ndarray, owner: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Places of values that are the least of some window of one owner's consecutive values; of all it has, if fewer."""
    n = len(values)
    if not n:
        return np.zeros(0, np.int64)
    chosen = np.zeros(n, bool)
    if n >= window:
        least = np.where(owner[: n - window + 1] == owner[window - 1 :], _extreme(values, window, np.minimum), np.uint64(0))
        none = np.zeros(window - 1, values.dtype)
        chosen = _extreme(np.concatenate([none, least, none]), window, np.maximum) == values
    first = np.flatnonzero(np.diff(owner, prepend=owner[0] - 1))
    count = np.diff(np.append(first, n))
    short = np.repeat(count < window, count)
    if short.any():
        chosen |= short & (values == np.repeat(np.minimum.reduceat(values, first), count))
    return np.flatnonzero(chosen)


def winnow(values: np.ndarray, window: int = WINDOW) -> np.ndarray:
    return winnowed(values, np.zeros(len(values), np.int64), window)


def seeds_of(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Seed, text and place of all texts."""
    text = np.repeat(np.arange(len(words)), np.diff(words.first))
    inside = np.flatnonzero(text[: max(0, len(text) - K + 1)] == text[K - 1 :])
    if not len(inside):
        return np.zeros(0, np.uint64), inside, inside
    grams, text = ngrams(words.hashes, K)[inside], text[inside]
    at = winnowed(grams, text)
    return grams[at], text[at], inside[at] - words.first[text[at]]


_DEALT = pa.schema([("bucket", pa.int32()), ("matched", pa.bool_()), ("blob", pa.binary())])


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def match_blobs(columns: list[np.ndarray], buckets: int) -> list[tuple[int, bool, bytes]]:
    """Matches, packed by the bucket of their document."""
    if not len(columns[0]):
        return []
    to = doc_bucket(columns[0], buckets)
    order = np.lexsort((columns[2], columns[3], columns[1], columns[0], to))
    to, columns = to[order], [c[order] for c in columns]
    cuts = np.append(np.flatnonzero(np.diff(to, prepend=-1)), len(to))
    return [(int(to[a]), True, pack([c[a:b] for c in columns])) for a, b in zip(cuts[:-1], cuts[1:])]


class Places:
    """Places of keys, collected until there are many, then packed by bucket."""

    def __init__(self, buckets: int):
        self.buckets = buckets
        self.clear()

    def clear(self) -> None:
        self.parts: list[tuple] = []
        self.rows: list[tuple] = []
        self.size = self.n_rows = 0

    def add(self, keys: np.ndarray, row: np.ndarray, place: np.ndarray, docs: np.ndarray, tags: np.ndarray) -> None:
        """``row`` numbers the entries of ``docs`` and ``tags``."""
        self.parts.append((keys, (row + self.n_rows).astype(np.uint32), place.astype(np.int32)))
        self.rows.append((docs.astype(np.int64), tags.astype(np.uint32)))
        self.size, self.n_rows = self.size + len(keys), self.n_rows + len(docs)

    def take(self) -> list[tuple[int, bool, bytes]]:
        """(bucket, False, places) by key and (bucket, True, matches) by document, and start anew."""
        if not self.size:
            return []
        keys, row, place = joined(self.parts)
        docs, tags = joined(self.rows)
        self.clear()
        rank = np.empty(len(docs), np.int64)
        rank[np.lexsort((tags, docs))] = np.arange(len(docs))
        order = np.argsort((rank[row] << 32) + place, kind="stable")
        order = order[np.argsort(keys[order], kind="stable")]
        keys, row, place = keys[order], row[order], place[order]
        first = np.flatnonzero(np.diff(keys, prepend=~keys[0]))
        count = np.diff(np.append(first, len(keys)))
        hot = np.repeat(count >= HOT, count)
        out = []
        if hot.any():
            lead = np.repeat(first, count)
            later = hot & (docs[row] > docs[row[lead]])
            own, of = row[later], row[lead[later]]
            out = match_blobs([docs[own], tags[own], place[later], docs[of], tags[of], place[lead[later]]], self.buckets)
            keys, row, place, hot = (c[~later] for c in (keys, row, place, hot))
        bucket = bucket_of(keys, self.buckets)
        cuts = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket))
        for a, b in zip(cuts[:-1], cuts[1:]):
            used, index = np.unique(row[a:b], return_inverse=True)
            out.append((int(bucket[a]), False, pack([keys[a:b], index.astype(np.uint32), place[a:b], hot[a:b].view(np.uint8)], [docs[used], tags[used]])))
        return out


def _seeds(buckets: int):
    def run(batches):
        places = Places(buckets)
        for batch in batches:
            for part, texts in steps(batch, "text"):
                raw = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
                ids = part.column(part.schema.get_field_index("doc_id")).to_numpy()
                places.add(*seeds_of(Words(raw)), ids, np.array([tag_of(t) for t in raw], np.uint32))
                if places.size >= CHUNK:
                    yield _rows(places.take(), _DEALT)
        if rest := places.take():
            yield _rows(rest, _DEALT)

    return run


def _first_places(buckets: int):
    """Matches of the keys of a bucket: every place of a later document, to the first place; and the first places
    themselves where a key was hot, as then not all its matches are to them."""

    def run(batches):
        for group in runs(batches, ["bucket", "matched"]):
            if group.column("matched")[0].as_py():
                yield _rows(list(zip(*(group.column(n).to_pylist() for n in _DEALT.names))), _DEALT)
                continue
            tables = []
            for blob in group.column("blob").to_pylist():
                (keys, row, place, hot), (docs, tags) = unpack(blob, _SEED, _ROW)
                tables.append([keys, docs[row], tags[row], place, hot])
            keys, docs, tags, place, hot = joined(tables)
            order = np.argsort(keys, kind="stable")
            keys, docs, tags, place, hot = (c[order] for c in (keys, docs, tags, place, hot))
            first = np.flatnonzero(np.diff(keys, prepend=~keys[0]))
            count = np.diff(np.append(first, len(keys)))
            wanted = np.repeat((np.minimum.reduceat(docs, first) < np.maximum.reduceat(docs, first)) | (np.maximum.reduceat(hot, first) > 0), count)
            keys, docs, tags, place, hot = (c[wanted] for c in (keys, docs, tags, place, hot))
            if not len(keys):
                continue
            first = np.flatnonzero(np.diff(keys, prepend=~keys[0]))
            count = np.diff(np.append(first, len(keys)))
            owner = np.repeat(np.minimum.reduceat(docs, first), count)
            code = np.where(docs == owner, (tags.astype(np.uint64) << np.uint64(32)) + place.astype(np.uint64), ~np.uint64(0))
            code = np.repeat(np.minimum.reduceat(code, first), count)
            keep = (docs > owner) | (np.repeat(np.maximum.reduceat(hot, first), count) > 0)
            code = code[keep]
            rows = match_blobs([docs[keep], tags[keep], place[keep], owner[keep], (code >> np.uint64(32)).astype(np.uint32), (code & np.uint64(0xFFFFFFFF)).astype(np.int32)], buckets)
            if rows:
                yield _rows(rows, _DEALT)

    return run


def diagonals(doc: tuple[np.ndarray, ...], x: np.ndarray, y: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of matches by pair and diagonal, and the first and last of each run with steps of at most ``gap``.

    ``doc``: columns that are equal within a pair.
    """
    order = np.lexsort((x, x - y, *doc[::-1]))
    new = np.ones(len(x), bool)
    if len(x):
        new[1:] = np.any([np.diff(c[order].astype(np.int64)) != 0 for c in (*doc, x - y)], axis=0) | (np.diff(x[order]) > gap)
    first = np.flatnonzero(new)
    return order, first, np.append(first[1:], len(x))[: len(first)] - 1


def segments(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Matches, joined where neighbours on one diagonal are no further apart than MAX_GAP: rows x0, x1, y0, y1."""
    order, first, last = diagonals((), x, y, MAX_GAP)
    x, y = x[order], y[order]
    out = np.stack([x[first], x[last] + K, y[first], y[last] + K], axis=1)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


class Fenwick:
    """Prefix maxima with their index."""

    def __init__(self, n: int):
        self.best = [(-1e18, -1)] * (n + 1)

    def put(self, i: int, value: float, of: int) -> None:
        i += 1
        while i < len(self.best):
            if value > self.best[i][0]:
                self.best[i] = (value, of)
            i += i & -i

    def get(self, n: int) -> tuple[float, int]:
        top = (-1e18, -1)
        while n > 0:
            if self.best[n][0] > top[0]:
                top = self.best[n]
            n -= n & -n
        return top


def chains(parts: np.ndarray) -> list[list[int]]:
    """Disjoint collinear chains of segments, best score first; every segment is in one."""
    n = len(parts)
    if n == 1:
        return [[0]]
    ends = np.unique(parts[:, 3])
    tree = Fenwick(len(ends))
    put, get = np.searchsorted(ends, parts[:, 3]).tolist(), np.searchsorted(ends, parts[:, 2], side="right").tolist()
    score, back = [0.0] * n, [-1] * n
    by_end = np.argsort(parts[:, 1], kind="stable")
    waiting, rows, by_end = 0, parts.tolist(), by_end.tolist()
    for j, (x0, x1, y0, _) in enumerate(rows):
        while waiting < n and rows[by_end[waiting]][1] <= x0:
            i = by_end[waiting]
            tree.put(put[i], score[i] + GAP_COST * (rows[i][1] + rows[i][3]), i)
            waiting += 1
        top, i = tree.get(get[j])
        score[j] = float(x1 - x0)
        if i >= 0 and top - GAP_COST * (x0 + y0) > 0:
            score[j] += top - GAP_COST * (x0 + y0)
            back[j] = i
    used, out = [False] * n, []
    for j in sorted(range(n), key=lambda k: (-score[k], k)):
        chain = []
        while j >= 0 and not used[j]:
            used[j] = True
            if chain and (rows[chain[-1]][0] - rows[j][1] > MAX_GAP or rows[chain[-1]][2] - rows[j][3] > MAX_GAP):
                out.append(chain[::-1])
                chain = []
            chain.append(j)
            j = back[j]
        if chain:
            out.append(chain[::-1])
    return out


def regions(doc: np.ndarray, tag: np.ndarray, x: np.ndarray) -> list[np.ndarray]:
    """Word ranges around places of matched seeds, sorted by text and place, that have all exact passages in them.

    The seeds of an exact passage are at most WINDOW apart, and its ends less than WINDOW + K words from the outer ones.
    """
    new = np.ones(len(x), bool)
    new[1:] = (np.diff(doc) != 0) | (np.diff(tag.astype(np.int64)) != 0) | (np.diff(x) > WINDOW)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(x))[: len(first)] - 1
    lo, hi = np.maximum(0, x[first] - WINDOW + 1), x[last] + K + WINDOW - 1
    long = hi - lo >= MIN_WORDS
    return [doc[first][long], tag[first][long], lo[long], hi[long]]


def ranges(doc: np.ndarray, tag: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> list[tuple[int, int, list[int], list[int]]]:
    """The unions of the ranges of each text: doc_id, tag, and where they begin and end, in order."""
    if not len(doc):
        return []
    order = np.lexsort((lo, tag, doc))
    doc, tag, lo, hi = doc[order], tag[order], lo[order].astype(np.int64), hi[order].astype(np.int64)
    text = np.cumsum((np.diff(doc, prepend=doc[0]) != 0) | (np.diff(tag.astype(np.int64), prepend=int(tag[0])) != 0)) << 40
    reach = np.maximum.accumulate(text + hi)
    new = np.ones(len(lo), bool)
    new[1:] = (text + lo)[1:] > reach[:-1]
    first = np.flatnonzero(new)
    ends = reach[np.append(first[1:], len(lo)) - 1] - text[first]
    cuts = np.append(np.flatnonzero(np.diff(text[first], prepend=-1)), len(first))
    return [(int(doc[first[a]]), int(tag[first[a]]), lo[first[a:b]].tolist(), ends[a:b].tolist()) for a, b in zip(cuts[:-1], cuts[1:])]


_ASKED = pa.schema([("bucket", pa.int32()), ("chains", pa.binary()), ("doc_id", pa.int64()), ("tag", pa.int64()), ("los", pa.list_(pa.int32())), ("his", pa.list_(pa.int32()))])


def _chained(batches):
    """For each bucket its chains, and the words that it asks for."""
    for group in runs(batches, ["bucket"]):
        bucket = group.column("bucket")[0].as_py()
        doc, tag, x, owner, owner_tag, y = joined([unpack(b, _MATCH)[0] for b in group.column("blob").to_pylist()])
        order = np.lexsort((x, tag, doc))
        around = regions(doc[order], tag[order], x[order])
        later = owner < doc
        doc, tag, x, owner, owner_tag, y = (c[later] for c in (doc, tag, x, owner, owner_tag, y))
        order, first, last = diagonals((doc, tag, owner, owner_tag), x, y, MAX_GAP)
        pair = [c[order][first] for c in (doc, tag, owner, owner_tag)]
        parts = np.stack([x[order][first], x[order][last] + K, y[order][first], y[order][last] + K], axis=1).astype(np.int64)
        order = np.lexsort((parts[:, 2], parts[:, 0], *pair[::-1]))
        pair, parts = [c[order] for c in pair], parts[order]
        new = np.ones(len(parts), bool)
        new[1:] = np.any([np.diff(c.astype(np.int64)) != 0 for c in pair], axis=0)[: len(parts)] if len(parts) else False
        cuts = np.append(np.flatnonzero(new), len(parts))
        chosen, sizes = [], []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if b - a == 1:
                chosen.append(a)
                sizes.append(1)
            else:
                for chain in chains(parts[a:b]):
                    chosen += [a + k for k in chain]
                    sizes.append(len(chain))
        sizes, chosen = np.array(sizes, np.int64), np.array(chosen, np.int64)
        number = np.repeat(np.arange(len(sizes)), sizes)
        pair, parts = [c[chosen] for c in pair], parts[chosen]
        head = np.cumsum(sizes) - sizes
        tail = head + sizes - 1
        yield _rows([(bucket, pack([number.astype(np.uint32), *pair, *parts.astype(np.int32).T], [around[0], around[1], *(c.astype(np.int32) for c in around[2:])]), None, None, None, None)], _ASKED)
        own = [pair[0][head], pair[1][head], np.maximum(0, parts[head, 0] - MARGIN), parts[tail, 1] + MARGIN]
        others = [pair[2][head], pair[3][head], np.maximum(0, parts[head, 2] - MARGIN), parts[tail, 3] + MARGIN]
        if asked := ranges(*map(np.concatenate, zip(own, others, around))):
            yield _rows([(bucket, None, *r) for r in asked], _ASKED)


_SLICES = pa.schema([("bucket", pa.int32()), ("chains", pa.binary()), ("doc_id", pa.int64()), ("tag", pa.int64()), ("los", pa.list_(pa.int32())), ("his", pa.list_(pa.int32())), ("words", pa.binary())])


def _slices(batches):
    """Word hashes, four bytes each, of the ranges that buckets ask a text for."""
    for batch in batches:
        for part, texts in steps(batch, "text"):
            raw = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
            words = Words(raw)
            ids = part.column(part.schema.get_field_index("doc_id")).to_pylist()
            asked = part.column(part.schema.get_field_index("asked")).to_pylist()
            rows = []
            for i, (a, b) in enumerate(zip(words.first[:-1], words.first[1:])):
                short, tag = words.hashes[a:b].astype(np.uint32), tag_of(raw[i])
                for r in asked[i]:
                    if r["tag"] == tag:
                        his = [min(h, len(short)) for h in r["his"]]
                        rows.append((r["bucket"], None, ids[i], tag, r["los"], his, b"".join(short[lo:hi].tobytes() for lo, hi in zip(r["los"], his))))
            if rows:
                yield _rows(rows, _SLICES)


def edits(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, int]:
    """Which words of a stay in a least-cost alignment with b, and how many words of b have no partner there."""
    n, m = len(a), len(b)
    if not n or not m:
        return np.zeros(n, bool), m
    cost = np.zeros((n + 1, m + 1), np.int64)
    cost[:, 0], cost[0] = np.arange(n + 1), np.arange(m + 1)
    step = np.arange(m + 1)
    for i in range(1, n + 1):
        row = np.minimum(cost[i - 1, 1:] + 1, cost[i - 1, :-1] + (b != a[i - 1]))
        cost[i, 1:] = row
        cost[i] = np.minimum.accumulate(cost[i] - step) + step
    stays, lonely, i, j = np.zeros(n, bool), 0, n, m
    while i or j:
        if i and j and cost[i, j] == cost[i - 1, j - 1] + (a[i - 1] != b[j - 1]):
            i, j = i - 1, j - 1
            stays[i] = a[i] == b[j]
        elif i and cost[i, j] == cost[i - 1, j] + 1:
            i -= 1
        else:
            j -= 1
            lonely += 1
    return stays, lonely


def align(a: np.ndarray, b: np.ndarray, parts: np.ndarray) -> tuple[list[tuple[int, int, int, int, int]], list[tuple[int, int]]]:
    """Passages in a (from, to, from and to in b, equal words), and runs of MIN_WORDS words or more that b has as they are.

    parts: the chain's segments in both.
    """
    bad = BAD
    x0, y0, x1, y1 = int(parts[0, 0]), int(parts[0, 2]), int(parts[-1, 1]), int(parts[-1, 3])
    if x1 > len(a) or y1 > len(b):
        return [], []
    left, right = min(x0, y0), min(len(a) - x1, len(b) - y1)
    score, partner = [], []

    def diagonal(x: int, y: int, n: int) -> None:
        score.append(np.where(a[x : x + n] == b[y : y + n], 1.0, bad))
        partner.append(np.arange(y, y + n))

    diagonal(x0 - left, y0 - left, left)
    for k, (u0, u1, v0, v1) in enumerate(parts.tolist()):
        diagonal(u0, v0, u1 - u0)
        if k + 1 < len(parts):
            p, q = int(parts[k + 1, 0]), int(parts[k + 1, 2])
            if p - u1 == q - v1:
                diagonal(u1, v1, p - u1)
            else:
                stays, lonely = edits(a[u1:p], b[v1:q])
                s = np.where(stays, 1.0, bad)
                if len(s):
                    s[-1] += bad * max(0, lonely - (~stays).sum())
                else:
                    score[-1][-1] += bad * lonely
                score.append(s)
                partner.append(np.linspace(v1, q, len(s), endpoint=False).astype(np.int64))
    diagonal(x1, y1, right)
    score, partner, at = np.concatenate(score), np.concatenate(partner), x0 - left
    found = passages(score, partner, at)
    # Only where the words themselves agree on one diagonal: the gaps' partners are approximate.
    return found, exact_runs(a[at : at + len(partner)] == b[np.minimum(partner, len(b) - 1)], partner, at) if found else []


def exact_runs(equal: np.ndarray, partner: np.ndarray, at: int) -> list[tuple[int, int]]:
    edge = np.ones(len(equal) + 1, bool)
    edge[1:-1] = (equal[1:] != equal[:-1]) | (np.diff(partner) != 1)
    cuts = np.flatnonzero(edge)
    return [(at + int(f), at + int(t)) for f, t in zip(cuts[:-1], cuts[1:]) if t - f >= MIN_WORDS and equal[f]]


def align_one(a: np.ndarray, b: np.ndarray, x0: int, x1: int, y0: int, y1: int) -> tuple[list[tuple[int, int, int, int, int]], list[tuple[int, int]]]:
    """``align`` for a chain of one segment, which most chains are."""
    left, right = min(x0, y0), min(len(a) - x1, len(b) - y1)
    if right < 0:
        return [], []
    equal = a[x0 - left : x1 + right] == b[y0 - left : y1 + right]
    n = len(equal)
    same = int(np.count_nonzero(equal))
    if same < IDENTITY * MIN_WORDS:
        return [], []
    if same == n:
        return ([(x0 - left, x1 + right, y0 - left, y1 + right, n)], [(x0 - left, x1 + right)]) if n >= MIN_WORDS else ([], [])
    partner = np.arange(y0 - left, y1 + right)
    found = passages(np.where(equal, 1.0, BAD), partner, x0 - left)
    return found, exact_runs(equal, partner, x0 - left) if found else []


def passages(s: np.ndarray, y: np.ndarray, at: int) -> list[tuple[int, int, int, int, int]]:
    """Parts of an alignment that begin and end with equal words and have at least MIN_WORDS words and IDENTITY of them
    equal: first the one with the best score, of equal scores the longest, then the best on each side of it, and so on.

    s: score of each word of the first text from word ``at`` on; y: its place in the second.
    """
    out, todo = [], [(0, len(s))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < MIN_WORDS:
            continue
        c = np.concatenate([[0.0], np.cumsum(s[lo:hi])])
        begin = np.where(s[lo:hi] == 1, c[:-1], np.inf)[: hi - lo - MIN_WORDS + 1]
        gain = np.where(s[lo + MIN_WORDS - 1 : hi] == 1, c[MIN_WORDS:], -np.inf) - np.minimum.accumulate(begin)
        k = len(gain) - 1 - int(gain[::-1].argmax())
        if not gain[k] >= 0:
            continue
        start, end = int(begin[: k + 1].argmin()), k + MIN_WORDS
        f, t = lo + start, lo + end
        out.append((at + f, at + t, int(y[f]), int(y[t - 1]) + 1, int((s[f:t] == 1).sum())))
        todo += [(lo, f), (t, hi)]
    return sorted(out)


_NUMBERS = ("doc_id", "tag", "other_doc_id", "other_tag", "start_word", "end_word", "other_start_word", "other_end_word", "equal_words")
_FOUND = ", ".join(f"{n} long" for n in _NUMBERS)
_ALIGNED = pa.schema([*((n, pa.int64()) for n in _NUMBERS), *_DEALT])


def _aligned(buckets: int):
    """Passages of the chains of a bucket, and the packed runs of words that are in none."""

    def texts(group: pa.Table) -> dict:
        out = {}
        columns = (group.column(c).to_pylist() for c in ("doc_id", "tag", "los", "his", "words"))
        for doc, tag, los, his, words in zip(*columns):
            if words is not None:
                starts = np.cumsum([0, *(h - lo for lo, h in zip(los, his))]).tolist()
                out[doc, tag] = los, his, starts, np.frombuffer(words, "<u4")
        return out

    def part(text: tuple, lo: int, hi: int) -> np.ndarray:
        """Words from lo, which some range has, to hi or the end of the text."""
        los, his, starts, words = text
        k = bisect_right(los, lo) - 1
        return words[starts[k] + lo - los[k] : starts[k] + max(lo, min(hi, his[k])) - los[k]]

    def run(batches):
        grams = Places(buckets)
        for group in runs(batches, ["bucket"]):
            held, rows, exact = texts(group), [], {}
            blobs = [c for c in group.column("chains").to_pylist() if c is not None]
            for blob in blobs:
                (number, doc, tag, owner, owner_tag, *ends), around = unpack(blob, _SEGMENT, _REGION)
                parts = np.stack(ends, axis=1).astype(np.int64)
                cuts = np.append(np.flatnonzero(np.diff(number.astype(np.int64), prepend=-1)), len(number)).tolist()
                ids = list(zip(*(c[cuts[:-1]].tolist() for c in (doc, tag, owner, owner_tag))))
                outer = parts.tolist()
                for (d, t, o, ot), i, j in zip(ids, cuts[:-1], cuts[1:]):
                    x0, x1, y0, y1 = outer[i][0], outer[j - 1][1], outer[i][2], outer[j - 1][3]
                    lo, owner_lo = max(0, x0 - MARGIN), max(0, y0 - MARGIN)
                    a, b = part(held[d, t], lo, x1 + MARGIN), part(held[o, ot], owner_lo, y1 + MARGIN)
                    if j - i == 1:
                        found, runs_ = align_one(a, b, x0 - lo, x1 - lo, y0 - owner_lo, y1 - owner_lo)
                    else:
                        found, runs_ = align(a, b, parts[i:j] - np.array([lo, lo, owner_lo, owner_lo]))
                    rows += [(d, t, o, ot, f + lo, u + lo, g + owner_lo, v + owner_lo, same) for f, u, g, v, same in found]
                    if runs_:
                        exact.setdefault((d, t), []).extend((f + lo, u + lo) for f, u in runs_)
                for d, t, lo, hi in zip(*(c.tolist() for c in around)):
                    words = part(held[d, t], lo, hi)
                    if len(words) < MIN_WORDS:
                        continue
                    open_ = np.ones(len(words) - MIN_WORDS + 1, bool)
                    for f, u in exact.get((d, t), ()):
                        open_[max(0, f - lo) : max(0, u - lo - MIN_WORDS + 1)] = False
                    at = np.flatnonzero(open_)
                    if len(at):
                        grams.add(ngrams(mix(words.astype(np.uint64)), MIN_WORDS)[at], np.zeros(len(at), np.uint32), at + lo, np.array([d]), np.array([t]))
            if rows:
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in zip(*rows)), *(pa.nulls(len(rows), f.type) for f in _DEALT)], schema=_ALIGNED)
            if grams.size >= CHUNK:
                yield from dealt(grams.take())
        yield from dealt(grams.take())

    def dealt(rows: list[tuple]):
        if rows:
            yield _rows([(*[None] * len(_NUMBERS), *r) for r in rows], _ALIGNED)

    return run


def _exact(batches):
    """Consecutive runs of words with one owner, joined to passages."""
    for group in runs(batches, ["bucket"]):
        columns = joined([unpack(b, _MATCH)[0] for b in group.column("blob").to_pylist()])
        columns = [c[columns[3] < columns[0]] for c in columns]
        doc, tag, x, owner, owner_tag, y = (c.astype(np.int64) for c in columns)
        order, first, last = diagonals((doc, tag, owner, owner_tag), x, y, 1)
        first, last = order[first], order[last]
        n = x[last] + MIN_WORDS - x[first]
        found = (doc[first], tag[first], owner[first], owner_tag[first], x[first], x[first] + n, y[first], y[first] + n, n)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], names=list(_NUMBERS))


def _dealt(df: DataFrame, buckets: int, *order: str) -> DataFrame:
    return df.repartition(min(buckets, MANY), "bucket").sortWithinPartitions("bucket", *order)


def _passages(docs: DataFrame) -> DataFrame:
    """``repeated_passages`` with the tags of both texts."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text").where("doc_id is not null")
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    buckets = int(max(1, min(size // BUCKET_BYTES[0], MANY), size // BUCKET_BYTES[1]))
    dealt = "bucket int, matched boolean, blob binary"
    matches = map_arrow(_dealt(map_arrow(docs, _seeds(buckets), dealt), buckets, "matched"), _first_places(buckets), dealt)
    asked_type = "bucket int, chains binary, doc_id long, tag long, los array<int>, his array<int>"
    found = stored(map_arrow(_dealt(matches.select("bucket", "blob"), buckets), _chained, asked_type), "chains")
    release(spark)
    asked = found.where("chains is null").groupBy("doc_id", F.expr(f"bucket div {ASKERS}")).agg(F.collect_list(F.struct("tag", "bucket", "los", "his")).alias("asked"))
    slices = map_arrow(docs.join(asked.select("doc_id", "asked"), "doc_id"), _slices, asked_type + ", words binary")
    both = found.where("chains is not null").withColumn("words", F.lit(None).cast("binary")).unionByName(slices)
    aligned = stored(map_arrow(_dealt(both, buckets), _aligned(buckets), f"{_FOUND}, {dealt}"), "passages")
    release(spark)
    left = aligned.where("bucket is not null").select("bucket", "matched", "blob")
    again = map_arrow(_dealt(left, buckets, "matched"), _first_places(buckets), dealt)
    exact = map_arrow(_dealt(again.select("bucket", "blob"), buckets), _exact, _FOUND)
    return aligned.where("bucket is null").select(*_NUMBERS).unionByName(exact)


def repeated_passages(docs: DataFrame) -> DataFrame:
    """One row per passage that a document repeats from an earlier one (by doc_id), in word positions.

    Columns: doc_id, other_doc_id (the earlier document), start_word, end_word, other_start_word, other_end_word (ends
    are exclusive), equal_words.  A document may have several, also overlapping ones.  An empty table gives no rows.
    """
    return _passages(docs).drop("tag", "other_tag")


def _removed(spans: str):
    def run(batches):
        for batch in batches:
            for part, texts in steps(batch, "text"):
                cut = part.column(part.schema.get_field_index(spans)).to_pylist()
                out = part.column(part.schema.get_field_index("text")).to_pylist()
                raw = [t.encode("utf-8", "surrogatepass") if c else b"" for t, c in zip(texts, cut)]
                words = Words([t.lower() for t in raw])
                keep = np.ones(len(out), bool)
                for i, (a, b) in enumerate(zip(words.first[:-1], words.first[1:])):
                    own = tag_of(raw[i].lower()) if cut[i] else None
                    taken = sorted((s["start_word"], s["end_word"]) for s in cut[i] or () if s["tag"] == own)
                    if not taken:
                        continue
                    start, end = words.start[a:b] - words.at[i], words.end[a:b] - words.at[i]
                    kept, at = [], 0
                    for lo, hi in taken:
                        hi = min(hi, b - a)
                        if lo >= hi or end[hi - 1] <= at:
                            continue
                        kept.append(raw[i][at : max(at, start[lo])])
                        at = int(end[hi - 1])
                    kept.append(raw[i][at:])
                    out[i] = b"".join(kept).decode("utf-8", "surrogatepass")
                    keep[i] = any(c.isalnum() for c in out[i])
                names = [n for n in part.schema.names if n != spans]
                columns = {n: part.column(part.schema.get_field_index(n)) for n in names}
                columns["text"] = pa.array(out, columns["text"].type)
                if "n_chars" in columns:
                    lengths = [len(t) if c and t is not None else n for t, c, n in zip(out, cut, columns["n_chars"].to_pylist())]
                    columns["n_chars"] = pa.array(lengths, columns["n_chars"].type)
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=names).filter(pa.array(keep))

    return run


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents without the passages that they repeat from earlier ones; n_chars, if there, follows the text.

    Each text of a doc_id loses the passages found in it alone.  Documents of which no letter or digit is left are
    dropped, if a passage was taken out of them.  Nulls and all other columns, whatever their names, are kept.
    """
    own, key = unused(docs, "spans"), unused(docs, "of")
    spans = _passages(docs).groupBy(F.col("doc_id").alias(key)).agg(F.collect_set(F.struct("tag", "start_word", "end_word")).alias(own))
    out = docs.join(spans, F.col("doc_id") == F.col(key), "left").select(*docs.columns, own)
    return out.mapInArrow(_removed(own), docs.schema)
