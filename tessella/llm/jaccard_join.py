"""N-gram Jaccard join with Bayesian candidate pruning.

Texts that share one shingle set form a class; only one representative of a class goes further.  Representatives
that agree in a MinHash band are joined into candidate clusters.  A cluster is compared as a whole or, where that takes
fewer rows (as in long chains of texts that are hardly similar), band bucket by band bucket; a pair then counts in the
first bucket that it shares.  Clusters and buckets are cut into blocks of bounded size.  A task holds two blocks: it compares the MinHash values of its pairs a few at a time, drops a pair as soon as
the posterior probability of reaching the threshold falls below the tolerance, and verifies what is left on the exact
shingle sets.  No pair becomes a row: a task returns link counts and one edge to a root for each linked set.

Definitions.  A text is lower-cased; a word is as in ``words``; a shingle is ``n`` consecutive words, or all words of
a text that has fewer.  Null texts are empty.  Texts without a word have no shingle and no link, not even to each other.
Rows that repeat a document are documents of their own and count as links of each other.  A null doc_id gives a row
without a class and with 0 links.  The class is the least doc_id of a connected component of links.
"""

from __future__ import annotations

from functools import lru_cache
from hashlib import blake2b
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_values, components, map_arrow, runs, steps, stored, unused
from .words import Words, mix, ngrams

N, THRESHOLD = 5, 0.8
BANDS, ROWS = 32, 4
#: A pair is dropped when the posterior probability of reaching the threshold is below this.
TOLERANCE = 1e-7
#: MinHash values compared between two looks at the posterior.
LOOK = 16
#: Shingles and sets that one block of a cluster holds at most, on average; a task gets two blocks.
BLOCK_SHINGLES, BLOCK_SETS = 500_000, 2_000

_K = BANDS * ROWS
_rng = np.random.default_rng(20240501)
_A = (_rng.integers(1, 2**32, _K, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_B = _rng.integers(0, 2**32, _K, dtype=np.uint64).astype(np.uint32)


def shingle_sets(texts: list[str], n: int = N) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    words = Words([t.lower().encode("utf-8", "surrogatepass") for t in texts])
    return [np.unique(ngrams(words.hashes[a:b], n)) for a, b in zip(words.first[:-1], words.first[1:])]


def signatures(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """MinHash values, a row for each set; sets must not be empty."""
    x = (values ^ (values >> np.uint64(32))).astype(np.uint32)
    out = np.empty((len(offsets) - 1, _K), np.uint32)
    with np.errstate(over="ignore"):
        for k in range(_K):
            h = x * _A[k] + _B[k]
            h ^= h >> np.uint32(15)
            out[:, k] = np.minimum.reduceat(h, offsets[:-1])
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), (len(sig), BANDS)).copy()
        for r in range(ROWS):
            keys = mix(keys ^ sig[:, r::ROWS].astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
    return keys.view(np.int64)


def digest(shingles: np.ndarray) -> bytes:
    return blake2b(shingles.tobytes(), digest_size=16).digest()


@lru_cache(maxsize=64)
def least_matches(seen: int, threshold: float, tolerance: float) -> int:
    """Fewest matches among ``seen`` MinHash values that keep a pair.

    With a uniform prior the similarity has the posterior Beta(m + 1, seen - m + 1), whose mass above t is the
    probability of at most m successes in seen + 1 trials with chance t.
    """
    mass = 0.0
    for m in range(seen + 1):
        mass += comb(seen + 1, m) * threshold**m * (1 - threshold) ** (seen + 1 - m)
        if mass >= tolerance:
            return m
    return seen


def survivors(left: np.ndarray, right: np.ndarray, threshold: float, tolerance: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that no look at the posterior has dropped; with ``same`` only i < j."""
    rows, cols = [], []
    for lo in range(0, len(left), 256):
        part = left[lo : lo + 256]
        matches = np.zeros((len(part), len(right)), np.uint8)
        for k in range(LOOK):
            matches += part[:, k, None] == right[None, :, k]
        i, j = np.nonzero(matches >= least_matches(LOOK, threshold, tolerance))
        if same:
            i, j = i[i + lo < j], j[i + lo < j]
        m = matches[i, j].astype(np.int64)
        for k in range(LOOK, _K, LOOK):
            m = m + (part[i, k : k + LOOK] == right[j, k : k + LOOK]).sum(axis=1)
            keep = m >= least_matches(k + LOOK, threshold, tolerance)
            i, j, m = i[keep], j[keep], m[keep]
        rows.append(i + lo)
        cols.append(j)
    return np.concatenate(rows or [np.zeros(0, np.int64)]), np.concatenate(cols or [np.zeros(0, np.int64)])


def exact_links(values: np.ndarray, offsets: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the pairs of sets have an exact Jaccard similarity of at least the threshold."""
    sizes = np.diff(offsets)
    _, ids = np.unique(values, return_inverse=True)
    mark = np.zeros(ids.max(initial=-1) + 1, bool)
    out = np.zeros(len(i), bool)
    order = np.argsort(i, kind="stable")
    cuts = np.flatnonzero(np.diff(i[order], prepend=-1))
    for a, b in zip(cuts, [*cuts[1:], len(order)]):
        own = i[order[a]]
        mark[ids[offsets[own] : offsets[own + 1]]] = True
        for lo in range(a, b, 512):
            part = order[lo : min(b, lo + 512)]
            other = j[part]
            n = sizes[other]
            starts = np.concatenate([[0], np.cumsum(n)[:-1]])
            where = np.arange(n.sum()) + np.repeat(offsets[other] - starts, n)
            shared = np.add.reduceat(mark[ids[where]].astype(np.int64), starts)
            out[part] = shared >= threshold * (sizes[own] + n - shared) - 1e-9
        mark[ids[offsets[own] : offsets[own + 1]]] = False
    return out


def _features(n: int):
    def run(batches):
        for batch in batches:
            for part, texts in steps(batch, "text"):
                sets = shingle_sets(texts, n)
                full = [k for k, s in enumerate(sets) if len(s)]
                keys: list = [None] * len(sets)
                if full:
                    offsets = np.concatenate([[0], np.cumsum([len(sets[k]) for k in full])])
                    for k, row in zip(full, band_keys(signatures(np.concatenate([sets[k] for k in full]), offsets))):
                        keys[k] = row
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(part.schema.get_field_index("doc_id")),
                        pa.array([digest(s) if len(s) else None for s in sets], pa.binary()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(keys, pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "set_id", "n_shingles", "bands"],
                )

    return run


def _with_shingles(n: int):
    """The stored rows again with their shingles, where the text has the digest that its cluster row names."""

    def run(batches):
        for batch in batches:
            for part, texts in steps(batch, "text"):
                sets = shingle_sets(texts, n)
                wanted = part.column(part.schema.get_field_index("set_id")).to_pylist()
                keep = [k for k, s in enumerate(sets) if len(s) and digest(s) == wanted[k]]
                rest = [part.column(part.schema.get_field_index(c)).take(pa.array(keep, pa.int64())) for c in ("units", "set_id", "copies")]
                yield pa.RecordBatch.from_arrays([*rest, pa.array([sets[k].tobytes() for k in keep], pa.binary())], names=["units", "set_id", "copies", "shingles"])

    return run


def _links(threshold: float, tolerance: float):
    def task(group: pa.Table) -> tuple[list, list, list]:
        ids, first = np.unique(np.array([x.hex() for x in group.column("set_id").to_pylist()]), return_index=True)
        group = group.take(pa.array(first))
        m = len(ids)
        values, offsets = binary_values(group.column("shingles"), "<u8")
        copies = group.column("copies").to_numpy()
        block, p, q = group.column("block").to_numpy(), group.column("p")[0].as_py(), group.column("q")[0].as_py()
        if m < 2:
            return [], [], []
        sig = signatures(values, offsets)
        if p == q:
            i, j = survivors(sig, sig, threshold, tolerance, True)
        else:
            left, right = np.flatnonzero(block == p), np.flatnonzero(block == q)
            i, j = survivors(sig[left], sig[right], threshold, tolerance, False)
            i, j = left[i], right[j]
        linked = exact_links(values, offsets, i, j, threshold)
        i, j = i[linked], j[linked]
        if group.column("key")[0].is_valid:
            keys = band_keys(sig)
            same = keys[i] == keys[j]
            here = keys[i, same.argmax(axis=1)] == group.column("key")[0].as_py()
            i, j = i[here], j[here]
        count = np.bincount(i, copies[j], m) + np.bincount(j, copies[i], m)
        root = np.arange(m)
        while True:
            low = np.minimum(root[i], root[j])
            after = root.copy()
            np.minimum.at(after, i, low)
            np.minimum.at(after, j, low)
            after = after[after]
            if (after == root).all():
                break
            root = after
        touched = np.flatnonzero(count > 0)
        names = group.column("set_id").to_pylist()
        return [names[k] for k in touched], [names[root[k]] for k in touched], count[touched].astype(np.int64).tolist()

    def run(batches):
        a, b, c = [], [], []
        for group in runs(batches, ["cluster", "key", "p", "q"]):
            for into, got in zip((a, b, c), task(group)):
                into += got
            if len(a) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(c, pa.int64())], names=["set_id", "root", "links"])
                a, b, c = [], [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(c, pa.int64())], names=["set_id", "root", "links"])

    return run


def _blocks(shingles: str, sets: str):
    return F.greatest(F.ceil(F.col(shingles) / BLOCK_SHINGLES), F.ceil(F.col(sets) / BLOCK_SETS)).cast("long")


def jaccard_classes(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, by_bucket: float = 1.0) -> DataFrame:
    """One row per document: doc_id, class_id, n_links (documents that it is linked to), n_shingles.

    ``by_bucket``: weight of a row of a band bucket against one of a whole cluster; the result does not depend on it.
    ``docs`` needs doc_id and text; other columns, whatever their names, are ignored.  Empty tables give no rows.
    """
    return _labelled(docs, n, threshold, tolerance, by_bucket).select("doc_id", "class_id", "n_links", "n_shingles")


def _labelled(docs: DataFrame, n: int, threshold: float, tolerance: float, by_bucket: float = 1.0) -> DataFrame:
    """``jaccard_classes`` with the set_id of every row and the label of its class, null where there are no words."""
    docs = docs.select("doc_id", "text")
    features = stored(map_arrow(docs, _features(n), "doc_id long, set_id binary, n_shingles long, bands array<long>"), "shingle-bands")
    known = features.where("set_id is not null and doc_id is not null")
    sets = stored(
        known.groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.max("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"))
    )
    keys = sets.select("set_id", "n_shingles", F.explode("bands").alias("key"))
    shared = stored(
        keys.groupBy("key").agg(F.min("set_id").alias("least"), F.count("*").alias("sets"), F.sum("n_shingles").alias("shingles")).where("sets > 1").withColumn("blocks", _blocks("shingles", "sets")),
        "buckets",
    )
    edges = keys.join(shared.select("key", "least"), "key").where("set_id <> least").select(F.col("set_id").alias("a"), F.col("least").alias("b"))
    clusters = components(edges)

    members = stored(clusters.join(sets.select(F.col("set_id").alias("node"), "rep", "copies", "n_shingles", "bands"), "node").withColumnsRenamed({"node": "set_id", "label": "cluster"}))
    # What a cluster costs as a whole and by its buckets: rows, that is sets times the blocks they meet.
    whole = members.groupBy("cluster").agg(F.sum("n_shingles").alias("shingles"), F.count("*").alias("sets")).withColumn("blocks", _blocks("shingles", "sets"))
    apart = shared.join(clusters.withColumnRenamed("node", "least"), "least").groupBy(F.col("label").alias("cluster")).agg(F.sum(F.col("sets") * F.col("blocks")).alias("rows"))
    # Its own table, so that the join below deals both sides anew and a large cluster's rows can be split.
    plans = stored(whole.join(apart, "cluster").select("cluster", "blocks", (F.col("rows") * by_bucket < F.col("sets") * F.col("blocks")).alias("by_bucket")))
    planned = members.join(plans, "cluster").select("rep", "set_id", "copies", "cluster", "blocks", "by_bucket", "bands")
    unit = F.struct("cluster", F.lit(None).cast("long").alias("key"), "blocks")
    one = planned.where("not by_bucket").select("rep", "set_id", "copies", F.array(unit).alias("units"))
    spread = planned.where("by_bucket").select("rep", "set_id", "copies", "cluster", F.explode("bands").alias("key")).join(shared.select("key", "blocks"), "key")
    # At most one unit for every band.
    several = spread.groupBy("rep", "set_id", "copies").agg(F.collect_list(F.struct("cluster", "key", "blocks")).alias("units"))
    loaded = map_arrow(
        docs.join(one.unionByName(several).withColumnRenamed("rep", "doc_id"), "doc_id").select("text", "units", "set_id", "copies"),
        _with_shingles(n),
        "units array<struct<cluster:binary,key:bigint,blocks:bigint>>, set_id binary, copies long, shingles binary",
    )
    pairs = (
        loaded.select(F.explode("units").alias("unit"), "set_id", "copies", "shingles")
        .select("unit.*", "set_id", "copies", "shingles")
        .withColumn("block", F.pmod(F.xxhash64("set_id"), F.col("blocks")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select("cluster", "key", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "set_id", "copies", "shingles")
        .repartition("cluster", "key", "p", "q")
        .sortWithinPartitions("cluster", "key", "p", "q")
    )
    links = stored(map_arrow(pairs, _links(threshold, tolerance), "set_id binary, root binary, links long"))
    linked = components(links.where("set_id <> root").select(F.col("set_id").alias("a"), F.col("root").alias("b")))
    counts = links.groupBy("set_id").agg(F.sum("links").alias("links"))
    labelled = (
        sets.select("set_id", "rep", "copies")
        .join(linked.withColumnRenamed("node", "set_id"), "set_id", "left")
        .join(counts, "set_id", "left")
        .withColumn("label", F.coalesce("label", "set_id"))
    )
    classes = labelled.groupBy("label").agg(F.min("rep").alias("class_id"))
    named = labelled.join(classes, "label").select("set_id", "label", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return features.select("doc_id", "set_id", "n_shingles").join(named, "set_id", "left").select(
        "doc_id",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
        "n_shingles",
        "set_id",
        "label",
    )


def _of_sets(n: int, sets_: str, set_: str):
    """The rows whose set is among ``sets_``, or that have no words, with the set as ``set_``."""

    def run(batches):
        for batch in batches:
            for part, texts in steps(batch, "text"):
                digests = [digest(s) if len(s) else None for s in shingle_sets(texts, n)]
                wanted = part.column(part.schema.get_field_index(sets_)).to_pylist()
                keep = pa.array([k for k, d in enumerate(digests) if d is None or d in (wanted[k] or [])], pa.int64())
                names = [c for c in part.schema.names if c != sets_]
                columns = [part.column(part.schema.get_field_index(c)).take(keep) for c in names]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(digests, pa.binary()).take(keep)], names=[*names, set_])

    return run


def without_near_copies(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, one of each class: a row with the class's least doc_id, of several such rows the first by set and text.

    Where a doc_id has several rows, each goes by the class of its own text.  Rows without words stay, but for copies
    within one doc_id.  Rows whose doc_id is null stay.  All columns, whatever their names, are kept as they are.
    """
    from pyspark.sql import Window
    from pyspark.sql.types import BinaryType, StructField, StructType

    key, several, sets_, set_, row = (unused(docs, x) for x in ("of", "several", "sets", "set", "row"))
    rows = _labelled(docs, n, threshold, TOLERANCE).where("doc_id is not null")
    chosen = rows.where("label is not null and doc_id = class_id").groupBy("label").agg(F.min("set_id").alias("set_id"), F.min("doc_id").alias("doc_id"))
    chosen = chosen.groupBy("doc_id").agg(F.collect_list("set_id").alias(sets_))
    ids = rows.groupBy("doc_id").agg((F.count("*") > 1).alias(several), (F.count("*") > F.count("set_id")).alias("blank"))
    kept = ids.join(chosen, "doc_id", "left").where(F.col(sets_).isNotNull() | F.col("blank")).select(F.col("doc_id").alias(key), several, sets_)
    joined = docs.join(kept, F.col("doc_id") == F.col(key)).select(*docs.columns, several, sets_)
    schema = StructType([*docs.schema.fields, StructField(set_, BinaryType())])
    own = joined.where(F.col(several)).drop(several).mapInArrow(_of_sets(n, sets_, set_), schema)
    order = Window.partitionBy("doc_id", set_, F.when(F.col(set_).isNull(), F.col("text"))).orderBy(F.xxhash64("text"), "text")
    own = own.withColumn(row, F.row_number().over(order)).where(F.col(row) == 1).drop(row, set_)
    return joined.where(~F.col(several)).drop(several, sets_).unionByName(own).unionByName(docs.where("doc_id is null"))
