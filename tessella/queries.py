"""Queries of the array operators over the driver's tables, and the same in SQL.

``orders`` is an array (t, y = 20, x = 25) of prices without cents, indexed by the order key; ``events`` is an append
stream in epochs of 100; ``embeddings`` is (vec, 64); ``lineitem`` gives volume, in a deterministic row order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import index as ix
from tessella.operators import cells as ce
from tessella.operators import codec as co
from tessella.operators import shard as sh
from tessella.operators.fold import all_levels, emits, fold, fold_level
from tessella.operators.packed import packed_levels
from tessella.operators.pyramid import pyramid, reduce_level
from tessella.operators.tile import placed, tile, untile
from tessella.plans.geometry import ArrayPlan, inverse_permutation, strides
from tessella.plans.spec import FOLDERS, REDUCERS, ArraySpec, Codec, Dim, align_up, ceil_log2, ceildiv, dtype, next_pow2
from tessella.sources import metadata, synthetic
from tessella.sources.shared import new_folder

Y, X = 20, 25
#: Chunk counts (4, 5) and shards of 2 x 2 chunks: the second dimension ends in a shard that is not full.
T = Dim("t", 0, 2, 2, axis="time", scale=0.5)
YD = Dim("y", Y, 5, 2, downsample=True, unit="micrometer", scale=0.25)
XD = Dim("x", X, 5, 2, downsample=True, unit="micrometer")


def orders_spec(reduce: str = "mean", append: str | None = None, dims: tuple[Dim, ...] | None = None, **more) -> ArraySpec:
    ds = dims or (T, YD, XD)
    if append:
        ds = (Dim("t", 0, 2, 2, downsample=True, axis="time", scale=0.5), *ds[1:])
    return ArraySpec(ds, dtype="i32", reduce=reduce, append_reduce=append or "mean", **more)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def orders(spark: SparkSession, sf_dir: str, spec: ArraySpec | None = None) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("idx"), F.col("o_totalprice").cast("bigint").alias("value"))
    return ce.cells(rows, spec or orders_spec())


_CELLS = f"""c AS (SELECT o_orderkey AS idx, o_orderkey // {Y * X} AS t, o_orderkey // {X} % {Y} AS y, o_orderkey % {X} AS x,
CAST(trunc(o_totalprice) AS BIGINT) AS v FROM orders)"""
_REDUCE = {
    "mean": "sum(v) // count(*)",
    "min": "min(v)",
    "max": "max(v)",
    "median": "list_sort(list(v))[count(*) // 2 + 1]",
    "max_sup": "coalesce(list_reverse_sort(list(v))[2], max(v))",
    "min_sup": "coalesce(list_sort(list(v))[2], min(v))",
}


def _l1(method: str) -> str:
    return f"WITH {_CELLS} SELECT t, y // 2 AS y, x // 2 AS x, CAST({_REDUCE[method]} AS INTEGER) AS value FROM c GROUP BY ALL"


def _levels(method: str, levels: int = 4) -> str:
    """Cells of all levels as common table expressions l0, l1, ..."""
    parts = [_CELLS, "l0 AS (SELECT t, y, x, v FROM c)"]
    for i in range(1, levels):
        parts.append(f"l{i} AS (SELECT t, y // 2 AS y, x // 2 AS x, CAST({_REDUCE[method]} AS BIGINT) AS v FROM l{i - 1} GROUP BY ALL)")
    return "WITH " + ", ".join(parts)


_FOLD = {"mean": "sum(v) // count(*)", "min": "min(v)", "max": "max(v)"}
_LEVELS = ArrayPlan(orders_spec()).levels
_Q: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        _Q[name or f.__name__] = (f, sql)
        return f

    return add


# Index algebra.


@query(f"WITH {_CELLS} SELECT idx, t, y, x FROM c")
def idx_unravel(spark, sf_dir):
    rows = read(spark, sf_dir, "orders")
    t, y, x = ix.unravel("o_orderkey", [1, Y, X], bounded=False)
    return rows.select(F.col("o_orderkey").alias("idx"), t.alias("t"), y.alias("y"), x.alias("x"))


@query(f"SELECT o_orderkey AS idx, o_orderkey % {X} AS a, o_orderkey // {X} % {Y} AS b, o_orderkey // {X * Y} % 1000000 AS c FROM orders")
def idx_unravel_first_fastest(spark, sf_dir):
    a, b, c = ix.unravel_first_fastest("o_orderkey", [X, Y, 1_000_000])
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("idx"), a.alias("a"), b.alias("b"), c.alias("c"))


@query(f"WITH {_CELLS} SELECT idx, t * {Y * X} + x * {Y} + y AS off FROM c")
def idx_transposed_offset(spark, sf_dir):
    off = ix.offset_of("o_orderkey", [1 << 40, Y, X], [Y * X, 1, Y])
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("idx"), off.alias("off"))


@query(f"WITH {_CELLS} SELECT idx, (t * {Y} + y) * {X} + x AS flat FROM c")
def idx_ravel(spark, sf_dir):
    return orders(spark, sf_dir).select(ce.index_of(orders_spec()).alias("idx"), ix.flat(["t", "y", "x"], [0, Y, X]).alias("flat"))


_KEY = " | ".join(f"(((y >> {b}) & 1) << {2 * b}) | (((x >> {b}) & 1) << {2 * b + 1})" for b in range(5))


@query(f"WITH {_CELLS} SELECT t, y, x, row_number() OVER (PARTITION BY t ORDER BY {_KEY}) - 1 AS rank FROM c")
def idx_morton_rank(spark, sf_dir):
    w = Window.partitionBy("t").orderBy(ix.morton_key(["y", "x"], 5))
    return orders(spark, sf_dir).select("t", "y", "x", (F.row_number().over(w) - 1).cast("bigint").alias("rank"))


@query(f"WITH {_CELLS} SELECT idx, x AS p0, t AS p1, y AS p2, greatest(t, y, x) AS most FROM c")
def idx_permute(spark, sf_dir):
    own = F.array("t", "y", "x")
    p = ix.permuted(own, [2, 0, 1])
    return orders(spark, sf_dir).select(ce.index_of(orders_spec()).alias("idx"), p[0].alias("p0"), p[1].alias("p1"), p[2].alias("p2"), F.array_max(own).alias("most"))


@query(f"WITH {_CELLS} SELECT idx, ((t & 7) << 6) | ((y & 7) << 3) | (x & 7) AS code FROM c")
def idx_voxel_code(spark, sf_dir):
    return orders(spark, sf_dir).select(ce.index_of(orders_spec()).alias("idx"), ix.voxel_code(["t", "y", "x"]).alias("code"))


# Projection and filters.

_BOUNDED = orders_spec(dims=(Dim("t", 2, 2, 1), YD, XD))


@query(f"WITH {_CELLS} SELECT t, y, x, CAST(v AS INTEGER) AS value FROM c WHERE idx < {2 * Y * X}")
def prj_capacity(spark, sf_dir):
    return orders(spark, sf_dir, _BOUNDED)


@query(f"WITH {_CELLS} SELECT idx, v AS value FROM c WHERE idx >= {2 * Y * X}")
def prj_beyond_capacity(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("idx"), F.col("o_totalprice").cast("bigint").alias("value"))
    return ce.beyond_capacity(rows, _BOUNDED)


@query("SELECT e.epoch, l.level FROM (SELECT DISTINCT event_id // 100 AS epoch FROM events) e, (VALUES (CAST(0 AS INTEGER)), (1), (2), (3)) l(level) WHERE (e.epoch + 1) % (1 << l.level) = 0")
def prj_active_levels(spark, sf_dir):
    epochs = read(spark, sf_dir, "events").select(ix.idiv("event_id", 100).alias("epoch")).distinct()
    active = F.array_compact(F.array(*[F.when(emits(F.col("epoch"), level), F.lit(level)) for level in range(4)]))
    return epochs.select("epoch", F.explode(active).alias("level"))


@query(f"WITH {_CELLS} SELECT t, y, x, CAST(v AS INTEGER) AS value FROM c WHERE t >= 1 AND t < 3 AND y >= 4 AND y < 9 AND x < 20")
def prj_box(spark, sf_dir):
    return ce.box(orders(spark, sf_dir), {"t": 1, "y": 4}, {"t": 3, "y": 9, "x": 20})


# Tiling.


@query(f"WITH {_CELLS} SELECT idx, t // 2 AS c0, y // 5 AS c1, x // 5 AS c2, (t % 2) * 25 + (y % 5) * 5 + x % 5 AS pos FROM c")
def til_placement(spark, sf_dir):
    p = placed(orders(spark, sf_dir), ArrayPlan(orders_spec()))
    return p.select(ce.index_of(orders_spec()).alias("idx"), F.col("chunk")[0].alias("c0"), F.col("chunk")[1].alias("c1"), F.col("chunk")[2].alias("c2"), "pos")


_TRANSPOSED = orders_spec(dims=(T, Dim("y", Y, 5, 2, position=2), Dim("x", X, 5, 2, position=1)))


@query(f"WITH {_CELLS} SELECT idx, t // 2 AS c0, x // 5 AS c1, y // 5 AS c2, (t % 2) * 25 + (x % 5) * 5 + y % 5 AS pos FROM c")
def til_storage_order(spark, sf_dir):
    p = placed(orders(spark, sf_dir, _TRANSPOSED), ArrayPlan(_TRANSPOSED))
    return p.select(ce.index_of(_TRANSPOSED).alias("idx"), F.col("chunk")[0].alias("c0"), F.col("chunk")[1].alias("c1"), F.col("chunk")[2].alias("c2"), "pos")


_RAGGED = orders_spec(dims=(T, Dim("y", Y, 8, 2), Dim("x", X, 8, 2)), fill=-1.0)


@query(f"WITH {_CELLS} SELECT t // 2 AS c0, y // 8 AS c1, x // 8 AS c2, count(*) AS cells, CAST(512 AS INTEGER) AS nbytes FROM c GROUP BY ALL")
def til_chunks(spark, sf_dir):
    chunks = tile(orders(spark, sf_dir, _RAGGED), ArrayPlan(_RAGGED))
    return chunks.select(F.col("chunk")[0].alias("c0"), F.col("chunk")[1].alias("c1"), F.col("chunk")[2].alias("c2"), "cells", F.octet_length("payload").alias("nbytes"))


@query(
    f"""WITH {_CELLS}, k AS (SELECT t // 2 AS c0, y // 8 AS c1, x // 8 AS c2 FROM c GROUP BY ALL), f AS (
SELECT c0 * 2 + a.a AS t, c1 * 8 + b.b AS y, c2 * 8 + d.d AS x FROM k, range(2) a(a), range(8) b(b), range(8) d(d))
SELECT f.t, f.y, f.x, CAST(coalesce(c.v, -1) AS INTEGER) AS value FROM f LEFT JOIN c USING (t, y, x)"""
)
def til_round_trip_padded(spark, sf_dir):
    plan = ArrayPlan(_RAGGED)
    return untile(tile(orders(spark, sf_dir, _RAGGED), plan), plan)


# Reduction.


def _lod(method):
    def run(spark, sf_dir):
        spec = orders_spec(method)
        return reduce_level(orders(spark, sf_dir, spec), ArrayPlan(spec))

    return run


for _m in REDUCERS:
    query(_l1(_m), f"lod_{_m}")(_lod(_m))


def _pyr(method):
    def run(spark, sf_dir):
        spec = orders_spec(method)
        return pyramid(orders(spark, sf_dir, spec), ArrayPlan(spec))

    return run


for _m in REDUCERS:
    query(
        _levels(_m, _LEVELS) + " " + " UNION ALL ".join(f"SELECT CAST({i} AS INTEGER) AS level, t, y, x, CAST(v AS INTEGER) AS value FROM l{i}" for i in range(_LEVELS)),
        f"lod_pyramid_{_m}",
    )(_pyr(_m))

_EVEN = orders_spec("max_sup", dims=(T, Dim("y", Y, 4, 2, downsample=True), Dim("x", X, 4, 2, downsample=True)))


@query(_levels("max_sup", 4) + " " + " UNION ALL ".join(f"SELECT CAST({i} AS INTEGER) AS level, t, y, x, CAST(v AS INTEGER) AS value FROM l{i}" for i in range(ArrayPlan(_EVEN).levels)))
def lod_packed_pyramid(spark, sf_dir):
    plan = ArrayPlan(_EVEN)
    source = orders(spark, sf_dir, _EVEN)
    frames = read(spark, sf_dir, "orders").count() // (Y * X)
    chunks, out = packed_levels(tile(source, plan), plan, frames).persist(StorageLevel.DISK_ONLY), None
    for level in range(plan.levels):
        own = ce.inside(untile(chunks.where(F.col("level") == level).drop("level"), plan), _EVEN, level).where(F.col("t") < frames).select(F.lit(level).alias("level"), "t", "y", "x", "value")
        out = own if out is None else out.unionByName(own)
    return out


@query(f"WITH {_CELLS} SELECT t, y // 2 AS y, x // 2 AS x, CAST(sum(v) // count(*) AS INTEGER) AS value FROM c GROUP BY ALL")
def snk_packed(spark, sf_dir):
    """A store written from whole chunks, its first level read back."""
    from tessella.sources.store import read_array, write_packed

    dims = (T, Dim("y", Y, 4, 2, downsample=True), Dim("x", X, 4, 2, downsample=True))
    spec, path = orders_spec(dims=dims, codec=Codec("zstd", 1), name="p"), new_folder(spark, "packed")
    source = orders(spark, sf_dir, spec)
    frames = source.agg(F.max("t")).first()[0] + 1
    write_packed(tile(source, ArrayPlan(spec)), spec, path, frames)
    back = read_array(spark, path, "p/1")
    return back.join(source.select("t", ix.idiv("y", 2).alias("y"), ix.idiv("x", 2).alias("x")).distinct(), ["t", "y", "x"]).select("t", "y", "x", "value")


@query("""WITH e AS (SELECT vec_id AS v, unnest(range(64)) AS k, unnest(embedding) AS z FROM embeddings)
SELECT v // 2 AS vec, k // 2 AS k, round(avg(CAST(z AS DOUBLE)), 4) + 0.0 AS value FROM e GROUP BY ALL""")
def lod_float_mean(spark, sf_dir):
    spec = ArraySpec((Dim("f", 0, 1, 1), Dim("vec", 1 << 40, 64, 1, downsample=True), Dim("k", 64, 16, 1, downsample=True)), dtype="f64")
    rows = read(spark, sf_dir, "embeddings").select(F.lit(0).cast("bigint").alias("f"), F.col("vec_id").alias("vec"), F.posexplode("embedding").alias("k", "value"))
    rows = rows.withColumn("value", F.col("value").cast("double"))
    return reduce_level(rows, ArrayPlan(spec)).select("vec", "k", (F.round("value", 4) + F.lit(0.0)).alias("value"))


# Folding.


def _fold(method):
    def run(spark, sf_dir):
        spec = orders_spec("mean", method)
        return fold(pyramid(orders(spark, sf_dir, spec), ArrayPlan(spec)), ArrayPlan(spec))

    return run


_FOLDED = "(((t // 2) >> {i}) * 2 + t % 2)"
for _m in FOLDERS:
    if _m == "mean_fold":
        _agg = "list_reduce(list(v ORDER BY t), lambda a, b: (a + b) >> {i})"
    else:
        _agg = _FOLD[_m]
    query(
        _levels("mean", _LEVELS)
        + " SELECT CAST(0 AS INTEGER) AS level, t, y, x, CAST(v AS INTEGER) AS value FROM l0"
        + "".join(f" UNION ALL SELECT {i}, {_FOLDED.format(i=i)} AS t, y, x, CAST({_agg.format(i=i)} AS INTEGER) AS value FROM l{i} GROUP BY {_FOLDED.format(i=i)}, y, x" for i in range(1, _LEVELS)),
        f"fld_{_m}",
    )(_fold(_m))


@query("SELECT event_id // 100 >> 2 AS epoch, count(DISTINCT event_id // 100) AS epochs, count(DISTINCT event_id // 100) = 4 AS complete FROM events GROUP BY ALL")
def fld_complete(spark, sf_dir):
    """Which folds of four epochs are complete, and which the end of the stream drains."""
    spec = ArraySpec((Dim("e", 0, 100, 1, downsample=True), Dim("k", 1, 1, 1, downsample=True)), dtype="f64", append_reduce="max")
    rows = read(spark, sf_dir, "events").select(F.col("event_id").alias("idx"), F.lit(0.0).alias("value"))
    got = fold_level(ce.cells(rows, spec), ArrayPlan(spec), 2, counted=True)
    return got.groupBy(ix.idiv("e", 100).alias("epoch")).agg(F.max("epochs").alias("epochs")).select("epoch", "epochs", (F.col("epochs") == 4).alias("complete"))


# Codecs.


def _codec(codec):
    def run(spark, sf_dir):
        plan = ArrayPlan(orders_spec(codec=codec))
        coded = co.encode(tile(orders(spark, sf_dir), plan), codec, 4)
        return untile(co.decode(coded, codec, plan.chunk_bytes), plan).where("value <> 0")

    return run


for _c in (Codec(), Codec("lz4", 5), Codec("zstd", 3)):
    query(f"WITH {_CELLS} SELECT t, y, x, CAST(v AS INTEGER) AS value FROM c WHERE v <> 0", f"cmp_{_c.name}")(_codec(_c))

# Shards.

_SIZE = "(16 + (c0 * 31 + c1 * 17 + c2 * 7) % 50)"
_CHUNKS = f"{_CELLS}, k AS (SELECT t // 2 AS c0, y // 5 AS c1, x // 5 AS c2 FROM c GROUP BY ALL), s AS (SELECT *, {_SIZE} AS nbytes, c0 // 2 AS s0, c1 // 2 AS s1, c2 // 2 AS s2, ((c0 % 2) * 2 + c1 % 2) * 2 + c2 % 2 AS slot FROM k)"


def _sized(spark, sf_dir):
    """Chunks with a size that their place gives, so that SQL can say it too."""
    plan = ArrayPlan(orders_spec())
    chunks = placed(orders(spark, sf_dir), plan).select("chunk").distinct()
    c = [F.col("chunk")[i] for i in range(3)]
    return plan, chunks.withColumn("nbytes", 16 + (c[0] * 31 + c[1] * 17 + c[2] * 7) % 50)


def _flat3(frame, array, names):
    return frame.select(*[F.col(array)[i].alias(n) for i, n in enumerate(names)], *[c for c in frame.columns if c != array])


@query(f"WITH {_CHUNKS} SELECT c0, c1, c2, s0, s1, s2, slot, (s0 * 2 + s1) * 3 + s2 AS shard_number, concat_ws('/', 'c', s0, s1, s2) AS key FROM s")
def agg_slots(spark, sf_dir):
    plan, chunks = _sized(spark, sf_dir)
    got = sh.with_slots(chunks, plan).withColumn("shard_number", sh.shard_number(plan)).withColumn("key", sh.shard_key())
    return got.select(*[F.col("chunk")[i].alias(f"c{i}") for i in range(3)], *[F.col("shard")[i].alias(f"s{i}") for i in range(3)], "slot", "shard_number", "key")


@query(f"WITH {_CHUNKS} SELECT s0, s1, s2, slot, nbytes, CAST(coalesce(sum(nbytes) OVER (PARTITION BY s0, s1, s2 ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset FROM s")
def agg_offsets(spark, sf_dir):
    plan, chunks = _sized(spark, sf_dir)
    return _flat3(sh.with_offsets(sh.with_slots(chunks, plan)).select("shard", "slot", "nbytes", "offset"), "shard", ["s0", "s1", "s2"])


@query(f"WITH {_CHUNKS} SELECT s0, s1, s2, CAST(sum(nbytes) AS BIGINT) AS total, CAST((512 - sum(nbytes) % 512) % 512 AS BIGINT) AS padding FROM s GROUP BY ALL")
def agg_page_padding(spark, sf_dir):
    plan, chunks = _sized(spark, sf_dir)
    got = sh.with_offsets(sh.with_slots(chunks, plan), alignment=512)
    return _flat3(got.groupBy("shard").agg(F.sum("nbytes").alias("total"), F.sum("padding").alias("padding")), "shard", ["s0", "s1", "s2"])


@query(
    f"""WITH {_CHUNKS}, o AS (SELECT s0, s1, s2, slot, nbytes, coalesce(sum(nbytes) OVER (PARTITION BY s0, s1, s2 ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM s),
e AS (SELECT * FROM (SELECT DISTINCT s0, s1, s2 FROM s), range(8) r(slot))
SELECT e.s0, e.s1, e.s2, e.slot, CAST(coalesce(o.off, -1) AS BIGINT) AS offset, coalesce(o.nbytes, -1) AS nbytes FROM e LEFT JOIN o USING (s0, s1, s2, slot)"""
)
def shd_index(spark, sf_dir):
    plan, chunks = _sized(spark, sf_dir)
    return _flat3(sh.shard_index(sh.with_slots(chunks, plan), plan), "shard", ["s0", "s1", "s2"])


@query(f"WITH {_CHUNKS}, n AS (SELECT s0, s1, s2, count(*) AS chunks FROM s GROUP BY ALL) SELECT concat_ws('/', 'c', s0, s1, s2) AS key, CAST(chunks * 200 + 8 * 16 + 4 AS INTEGER) AS nbytes FROM n")
def shd_objects(spark, sf_dir):
    """Whole shards of uncompressed chunks (200 bytes each), with index and checksum."""
    plan = ArrayPlan(orders_spec())
    shards = sh.assemble(co.encode(tile(orders(spark, sf_dir), plan), Codec()), plan)
    return shards.select("key", F.octet_length("object").alias("nbytes"))


# Planning.


def _geometry_sql() -> str:
    """Extents by halving, chunk and shard counts by rounding up, all in SQL."""
    return """WITH RECURSIVE d(dim, name, size, chunk, per, lod) AS (VALUES (0, 't', 30, 2, 2, 0), (1, 'y', 20, 5, 2, 1), (2, 'x', 25, 5, 2, 1)),
l AS (SELECT 0 AS level, 20 AS y, 25 AS x UNION ALL SELECT level + 1, (y + 1) // 2, (x + 1) // 2 FROM l WHERE y > 5 OR x > 5),
e AS (SELECT l.level, d.dim, d.name, CASE d.name WHEN 'y' THEN l.y WHEN 'x' THEN l.x ELSE d.size END AS size, d.chunk, d.per FROM l, d),
k AS (SELECT *, (size + chunk - 1) // chunk AS n FROM e)
SELECT CAST(level AS INTEGER) AS level, CAST(dim AS INTEGER) AS dim, name, CAST(size AS BIGINT) AS size, CAST(chunk AS BIGINT) AS chunk_size, CAST(n AS BIGINT) AS chunk_count,
CAST(least(per, n) AS BIGINT) AS chunks_per_shard, CAST((n + least(per, n) - 1) // least(per, n) AS BIGINT) AS shard_count FROM k"""


@query(_geometry_sql())
def pln_geometry(spark, sf_dir):
    return ArrayPlan(orders_spec(dims=(Dim("t", 30, 2, 2), YD, XD))).to_df(spark)


@query(
    """WITH RECURSIVE l AS (SELECT 0 AS level, 20 AS y, 25 AS x UNION ALL SELECT level + 1, (y + 1) // 2, (x + 1) // 2 FROM l WHERE y > 5 OR x > 5),
e AS (SELECT level, 0 AS dim, 't' AS name, 0.5 AS p, 1.0 AS f FROM l UNION ALL SELECT level, 1, 'y', 0.25, 20.0 / y FROM l UNION ALL SELECT level, 2, 'x', 1.0, 25.0 / x FROM l)
SELECT CAST(level AS INTEGER) AS level, CAST(dim AS INTEGER) AS dim, name, round(CAST(p * f AS DOUBLE), 6) AS scale, round(CAST(0.5 * p * (f - 1) AS DOUBLE), 6) AS translation FROM e"""
)
def snk_transforms(spark, sf_dir):
    plan = ArrayPlan(orders_spec(dims=(Dim("t", 30, 2, 2, scale=0.5), YD, XD)))
    return metadata.transforms_df(spark, plan).select("level", "dim", "name", F.round("scale", 6).alias("scale"), F.round("translation", 6).alias("translation"))


# Sources.

_XOR = ArraySpec((Dim("t", 8, 2), Dim("y", 16, 4), Dim("x", 32, 8)), dtype="u16")


@query("SELECT i AS idx, xor(xor(i // 512, i // 32 % 16), i % 32) AS value FROM range(4096) r(i)")
def src_xor(spark, sf_dir):
    return synthetic.xor(spark, _XOR, 4096)


@query("SELECT i AS idx, CAST(0 AS BIGINT) AS value FROM range(1000) r(i)")
def src_zeros(spark, sf_dir):
    return synthetic.zeros(spark, 1000)


@query("SELECT i AS idx, i & 65535 AS value FROM range(100000) r(i)")
def src_ramp(spark, sf_dir):
    return synthetic.ramp(spark, 100_000)


_BIG = 1 << 64


def _mixed(shift: int, factor: int) -> str:
    return f"CAST(CAST(xor(z, z >> {shift}) AS UHUGEINT) * {factor} % {_BIG} AS UBIGINT)"


@query(
    f"""WITH s AS (SELECT i, CAST((CAST({0xDEADBEEFCAFEBABE} AS UHUGEINT) + (CAST(i % 7000 AS UHUGEINT) + 1) * CAST({0x9E3779B97F4A7C15} AS UHUGEINT)) % CAST({_BIG} AS UHUGEINT) AS UBIGINT) AS z FROM range(10000) t(i)),
a AS (SELECT i, {_mixed(30, 0xBF58476D1CE4E5B9)} AS z FROM s), b AS (SELECT i, {_mixed(27, 0x94D049BB133111EB)} AS z FROM a)
SELECT i AS idx, CAST(xor(z, z >> 31) & 4095 AS BIGINT) AS value FROM b"""
)
def src_noise(spark, sf_dir):
    return synthetic.noise(spark, 10_000, period=7_000)


@query("SELECT 'e' AS array_id, event_id // 50 AS a, event_id % 50 AS b, CAST(event_id % 1000 AS INTEGER) AS value FROM events UNION ALL SELECT 'o', o_orderkey // 20, o_orderkey % 20, CAST(o_orderkey % 777 AS INTEGER) FROM orders")
def src_multi_array(spark, sf_dir):
    """Elements of two arrays in one table, told apart by array_id."""
    e = read(spark, sf_dir, "events").select(F.lit("e").alias("array_id"), F.col("event_id").alias("idx"), (F.col("event_id") % 1000).alias("value"))
    o = read(spark, sf_dir, "orders").select(F.lit("o").alias("array_id"), F.col("o_orderkey").alias("idx"), (F.col("o_orderkey") % 777).alias("value"))
    specs = {"e": ArraySpec((Dim("a", 0, 10, 1), Dim("b", 50, 10)), dtype="i32"), "o": ArraySpec((Dim("a", 0, 10, 1), Dim("b", 20, 10)), dtype="i32")}
    return ce.array_cells(e.unionByName(o), specs).select("array_id", "a", "b", "value")


# Stores.


@query(
    _levels("mean", _LEVELS) + " " + " UNION ALL ".join(f"SELECT CAST({i} AS INTEGER) AS level, t, y, x, CAST(v AS INTEGER) AS value FROM l{i}" for i in range(_LEVELS))
)
def snk_store_round_trip(spark, sf_dir):
    """Write all levels as a store, read every level back."""
    from tessella.sources.store import read_array, write_array

    path = new_folder(spark, "store")
    spec = orders_spec(codec=Codec("zstd", 1))
    plan = write_array(orders(spark, sf_dir, spec), spec, path)
    out = None
    for level in range(plan.levels):
        own = read_array(spark, path, f"0/{level}").select(F.lit(level).alias("level"), "t", "y", "x", "value")
        out = own if out is None else out.unionByName(own)
    return out


@query(f"WITH {_CELLS} SELECT t, y, x, CAST(v AS INTEGER) AS value FROM c WHERE t >= 1 AND t < 2 AND y = 7 AND x < 12")
def snk_store_box(spark, sf_dir):
    """Read a box: shards and chunks outside it are not opened."""
    from tessella.sources.store import read_array, write_array

    path = new_folder(spark, "store")
    spec = orders_spec(codec=Codec("lz4", 3))
    write_array(orders(spark, sf_dir, spec), spec, path)
    return read_array(spark, path, "0/0").where("t >= 1 AND t < 2 AND y = 7 AND x < 12").select("t", "y", "x", "value")


@query("SELECT event_id // 100 AS epoch, count(*) AS elements FROM events GROUP BY ALL HAVING count(*) = 100")
def str_complete_epochs(spark, sf_dir):
    from tessella.streaming.append import complete_epochs

    return complete_epochs(read(spark, sf_dir, "events").select(F.col("event_id").alias("idx"), F.col("value")), ArraySpec((Dim("e", 0, 100, 1),), dtype="f64"))


def _streamed(spark: SparkSession, parts: list[DataFrame], folder: str, make) -> None:
    """Feed parts, one after the other, to a stream that starts anew for each with what its state folder has."""
    for k, part in enumerate(parts):
        part.coalesce(1).write.parquet(f"{folder}/in/{k}")
        rows = spark.readStream.schema(part.schema).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
        make().start(rows, f"{folder}/checkpoint").awaitTermination()


@query(f"WITH {_CELLS} SELECT t, y, x, CAST(v AS INTEGER) AS value FROM c")
def str_append(spark, sf_dir):
    """Append orders to a store from a stream that starts anew and sends many rows again; finish it, read it back."""
    from tessella.sources.store import read_array
    from tessella.streaming.append import AppendStream

    spec, path = orders_spec(codec=Codec("zstd", 1)), new_folder(spark, "stream")
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("idx"), F.col("o_totalprice").cast("bigint").alias("value"))
    _streamed(spark, [rows.where("idx % 3 <> 0"), rows.where("idx % 3 = 0 OR idx % 5 = 0")], path, lambda: AppendStream(spark, spec, f"{path}/store", f"{path}/state"))
    AppendStream(spark, spec, f"{path}/store", f"{path}/state").finish()
    return read_array(spark, f"{path}/store", "0/0").select("t", "y", "x", "value")


@query(
    """SELECT CAST(1 AS BIGINT) AS array_id, event_id // 50 AS a, event_id % 50 AS b, CAST(event_id % 1000 AS INTEGER) AS value FROM events
UNION ALL SELECT 2, o_orderkey // 20, o_orderkey % 20, CAST(o_orderkey % 777 AS INTEGER) FROM orders"""
)
def str_multi_array(spark, sf_dir):
    """Two arrays in one stream, each finished in its own store."""
    from tessella.sources.store import read_array
    from tessella.streaming.append import MultiAppendStream

    path = new_folder(spark, "multi")
    e = read(spark, sf_dir, "events").select(F.lit(1).cast("bigint").alias("array_id"), F.col("event_id").alias("idx"), (F.col("event_id") % 1000).alias("value"))
    o = read(spark, sf_dir, "orders").select(F.lit(2).cast("bigint").alias("array_id"), F.col("o_orderkey").alias("idx"), (F.col("o_orderkey") % 777).alias("value"))
    specs = {1: ArraySpec((Dim("a", 0, 10, 4), Dim("b", 50, 10, 5)), dtype="i32", fill=-1, name="x"), 2: ArraySpec((Dim("a", 0, 10, 4), Dim("b", 20, 10, 2)), dtype="i32", fill=-1, name="x")}
    rows = e.unionByName(o)
    _streamed(spark, [rows.where("idx % 2 = 0"), rows.where("idx % 2 = 1")], path, lambda: MultiAppendStream(spark, specs, f"{path}/store", f"{path}/state"))
    MultiAppendStream(spark, specs, f"{path}/store", f"{path}/state").finish()
    parts = [read_array(spark, f"{path}/store/{i}", "x/0").where("value >= 0").select(F.lit(i).cast("bigint").alias("array_id"), "a", "b", "value") for i in specs]
    return parts[0].unionByName(parts[1])


@query("SELECT w.w AS writer, i AS idx, CAST(xor(i // 40, i % 40) AS INTEGER) AS value FROM range(4000) t(i), (VALUES (0), (1)) w(w)")
def src_interleaved(spark, sf_dir):
    """Two streams pumped in turns into two stores."""
    from tessella.sources.store import read_array
    from tessella.streaming.append import AppendStream

    path, spec = new_folder(spark, "two"), ArraySpec((Dim("t", 0, 10, 2), Dim("x", 40, 20, 2)), dtype="i32", name="a")
    rows, streams = synthetic.xor(spark, spec, 4_000), [AppendStream(spark, spec, f"{path}/{w}", f"{path}/state-{w}") for w in (0, 1)]
    for k in range(2):
        for stream in streams:
            stream.batch(rows.where(ix.idiv("idx", 2_000) == k), k)
    for stream in streams:
        stream.finish()
    parts = [read_array(spark, f"{path}/{w}", "a/0").select(F.lit(w).alias("writer"), (F.col("t") * 40 + F.col("x")).alias("idx"), "value") for w in (0, 1)]
    return parts[0].unionByName(parts[1])


@query("SELECT t, x, CAST(max(v) AS INTEGER) AS value FROM (SELECT o_orderkey // 50 // 2 AS t, o_orderkey % 50 AS x, CAST(trunc(o_totalprice) AS BIGINT) AS v FROM orders) GROUP BY ALL HAVING count(*) = 2")
def str_fold(spark, sf_dir):
    """Epochs of a stream folded in pairs; a pair comes out once both of its epochs are there."""
    from tessella.streaming.append import complete_folds

    spec, path = ArraySpec((Dim("t", 0, 1, 1, True), Dim("x", 50, 25, downsample=True)), dtype="i32", append_reduce="max"), new_folder(spark, "fold")
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("idx"), F.col("o_totalprice").cast("bigint").alias("value"))
    for k in range(2):
        ce.cells(rows, spec).where(F.col("t") % 2 == k).coalesce(1).write.parquet(f"{path}/in/{k}")
    schema = spark.read.parquet(f"{path}/in/0").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{path}/in")
    done = complete_folds(stream, spec, 1)
    done.writeStream.outputMode("update").foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{path}/out/{n}")).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(done.schema).option("recursiveFileLookup", "true").parquet(f"{path}/out").select("t", "x", "value")


@query(f"WITH {_CELLS} SELECT t, y, x, CAST(v AS INTEGER) AS value FROM c WHERE t < 12")
def snk_stream(spark, sf_dir):
    """Shards written by the streaming sink, then read as an array."""
    from tessella.sources.store import FORMAT, encoded_levels, objects, read_array, register, write_metadata

    register(spark)
    plan, path = ArrayPlan(orders_spec(codec=Codec("zstd", 1), name="s")), new_folder(spark, "sink")
    made = objects(encoded_levels(orders(spark, sf_dir).where("t < 12").select(F.lit(0).alias("level"), "*"), plan), plan, 12)
    made.write.parquet(f"{path}/in")
    stream = spark.readStream.schema(made.schema).parquet(f"{path}/in")
    stream.writeStream.format(FORMAT).option("path", f"{path}/store").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    write_metadata(f"{path}/store", plan, 12)
    return read_array(spark, f"{path}/store", "s/0", missing="skip").join(orders(spark, sf_dir).select("t", "y", "x"), ["t", "y", "x"]).select("t", "y", "x", "value")


# Element types, folds of wide types, empty chunks, checksums and plans.

_HELD = {"u8": ("SMALLINT", 251), "i8": ("TINYINT", 127), "u16": ("INTEGER", 60_000), "i16": ("SMALLINT", 32_000), "u32": ("BIGINT", 4_000_000_000), "i64": ("BIGINT", 1 << 50), "u64": ("BIGINT", 1 << 60), "f32": ("FLOAT", 1_000), "f64": ("DOUBLE", 1 << 40)}


def _typed(of: str):
    kind, top = _HELD[of]
    mean = "sum(v) / count(*)" if of[0] == "f" else "sum(v) // count(*)"

    def run(spark, sf_dir):
        spec = orders_spec(dims=(Dim("t", 0, 2, 2), YD, XD))
        spec = ArraySpec(spec.dims, dtype=of, reduce="mean")
        value = F.expr(f"CAST((o_orderkey * 7919L) % {top}L AS {'decimal(20,0)' if of == 'u64' else 'double' if of[0] == 'f' else 'bigint'})")
        out = reduce_level(ce.cells(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("idx"), value.alias("value")), spec), ArrayPlan(spec))
        return out.withColumn("value", F.col("value").cast("bigint")) if of == "u64" else out

    source = f"(o_orderkey * 7919) % {top}"
    query(
        f"""WITH c AS (SELECT o_orderkey // {Y * X} AS t, o_orderkey // {X} % {Y} // 2 AS y, o_orderkey % {X} // 2 AS x, CAST({source} AS {'DOUBLE' if of[0] == 'f' else 'HUGEINT'}) AS v FROM orders)
SELECT t, y, x, CAST({mean} AS {kind}) AS value FROM c GROUP BY ALL""",
        f"lod_mean_{of}",
    )(run)


for _of in _HELD:
    _typed(_of)


def _folded(of: str, kind: str, mean: str):
    def run(spark, sf_dir):
        spec = ArraySpec((Dim("t", 0, 2, 2, downsample=True), Dim("y", Y, 5, 2), XD), dtype=of, append_reduce="mean")
        rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("idx"), F.col("o_totalprice").cast("bigint").cast("double" if of[0] == "f" else "bigint").alias("value"))
        return fold_level(ce.cells(rows, spec), ArrayPlan(spec), 1)

    query(f"WITH {_CELLS} SELECT t // 4 * 2 + t % 2 AS t, y, x, CAST({mean} AS {kind}) AS value FROM c GROUP BY t // 4 * 2 + t % 2, y, x", f"fld_mean_{of}")(run)


_folded("f64", "DOUBLE", "sum(v) / count(*)")
_folded("i64", "BIGINT", "sum(v) // count(*)")


@query("SELECT o_custkey % 40 AS shard, o_orderkey AS slot, n AS nbytes, CAST(sum(n) OVER (PARTITION BY o_custkey % 40 ORDER BY o_orderkey) - n AS BIGINT) AS at FROM (SELECT *, o_orderkey % 5 * 100 AS n FROM orders) WHERE n > 0")
def prj_empty_chunks(spark, sf_dir):
    """Chunks of no bytes take no place in a shard."""
    rows = read(spark, sf_dir, "orders").select((F.col("o_custkey") % 40).alias("shard"), F.col("o_orderkey").alias("slot"), (F.col("o_orderkey") % 5 * 100).alias("nbytes"))
    return sh.with_offsets(rows).select("shard", "slot", "nbytes", F.col("offset").alias("at"))


#: Published check values of CRC-32C.
_CRC = {"313233343536373839": 0xE3069283, "00" * 32: 0x8A9136AA, "ff" * 32: 0x62A8AB43, bytes(range(32)).hex(): 0x46DD794E, bytes(range(31, -1, -1)).hex(): 0x113FDB5C, "": 0}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', CAST({v} AS BIGINT))" for k, v in _CRC.items()) + ") v(bytes, crc)")
def shd_crc32c(spark, sf_dir):
    return spark.createDataFrame([(k, sh.crc32c(bytes.fromhex(k))) for k in _CRC], "bytes string, crc bigint")


@query("SELECT a, b, (a + b - 1) // b AS ceildiv, (a + b - 1) // b * b AS aligned, CAST(ceil(log2(a)) AS BIGINT) AS log2, CAST(2 ** ceil(log2(a)) AS BIGINT) AS pow2 FROM range(1, 200) t(a), (VALUES (1), (3), (16), (100)) u(b)")
def pln_rounding(spark, sf_dir):
    rows = [(a, b, ceildiv(a, b), align_up(a, b), ceil_log2(a), next_pow2(a)) for a in range(1, 200) for b in (1, 3, 16, 100)]
    return spark.createDataFrame(rows, "a bigint, b int, ceildiv bigint, aligned bigint, log2 bigint, pow2 bigint")


_SHAPES = ((4, 5, 6), (7, 1, 3), (2, 2, 2), (10, 20, 30))


@query("SELECT a, b, c, b * c AS s0, c AS s1, CAST(1 AS BIGINT) AS s2 FROM (VALUES " + ", ".join(str(x) for x in _SHAPES) + ") v(a, b, c)")
def pln_strides(spark, sf_dir):
    return spark.createDataFrame([(*x, *strides(list(x))) for x in _SHAPES], "a int, b int, c int, s0 int, s1 int, s2 bigint")


@query("WITH p AS (SELECT a, b, c FROM range(3) x(a), range(3) y(b), range(3) z(c) WHERE a <> b AND b <> c AND a <> c) SELECT a, b, c, list_position([a, b, c], 0) - 1 AS i0, list_position([a, b, c], 1) - 1 AS i1, list_position([a, b, c], 2) - 1 AS i2 FROM p")
def pln_inverse_permutation(spark, sf_dir):
    from itertools import permutations

    return spark.createDataFrame([(*p, *inverse_permutation(list(p))) for p in permutations(range(3))], "a bigint, b bigint, c bigint, i0 int, i1 int, i2 int")


@query(
    """WITH d AS (SELECT * FROM (VALUES ('t', 0, 2), ('y', 20, 5), ('x', 25, 5)) v(name, size, chunk)), l AS (SELECT CAST(range AS BIGINT) AS frames FROM range(0, 40))
SELECT frames, name, CASE WHEN name = 't' THEN frames ELSE size END AS size, (CASE WHEN name = 't' THEN frames ELSE size END + chunk - 1) // chunk AS chunks, ((CASE WHEN name = 't' THEN frames ELSE size END + chunk - 1) // chunk + 1) // 2 AS shards FROM d, l WHERE frames > 0"""
)
def pln_extents(spark, sf_dir):
    """Extents, chunks and shards of an array as it grows."""
    plan = ArrayPlan(orders_spec())
    rows = [(n, e.name, e.size, e.chunk_count, e.shard_count) for n in range(1, 40) for e in plan.extents(0, n)]
    return spark.createDataFrame(rows, "frames bigint, name string, size bigint, chunks bigint, shards bigint")


@query("SELECT n AS elements, n // 500 AS frames, n // 1000 * 2 AS whole FROM range(0, 20000, 37) t(n)")
def pln_append_sizes(spark, sf_dir):
    """Extent of the append dimension at the end of a stream, and after its whole chunks."""
    plan = ArrayPlan(orders_spec())
    rows = [(n, plan.append_sizes_final(n)[0], plan.append_sizes_midway(n // 1000)[0]) for n in range(0, 20000, 37)]
    return spark.createDataFrame(rows, "elements bigint, frames bigint, whole bigint")


@query("SELECT name, nbytes, integral, least, most FROM (VALUES ('u8', 1, true, 0, 255), ('u16', 2, true, 0, 65535), ('i8', 1, true, -128, 127), ('i16', 2, true, -32768, 32767), ('i32', 4, true, -2147483648, 2147483647), ('u32', 4, true, 0, 4294967295)) v(name, nbytes, integral, least, most)")
def pln_types(spark, sf_dir):
    names = ("u8", "u16", "i8", "i16", "i32", "u32")
    rows = [(d.name, d.nbytes, d.integral, *d.bounds) for d in map(dtype, names)]
    return spark.createDataFrame(rows, "name string, nbytes int, integral boolean, least bigint, most bigint")


@query(
    """SELECT * FROM (VALUES ('zarr.json', 'group', ''), ('plate/zarr.json', 'group', ''), ('plate/w/zarr.json', 'group', ''),
('plate/w/0/zarr.json', 'array', '6, 20, 25'), ('plate/w/1/zarr.json', 'array', '6, 10, 13'), ('plate/w/2/zarr.json', 'array', '6, 5, 7'), ('plate/w/3/zarr.json', 'array', '6, 3, 4')) v(path, kind, shape)"""
)
def snk_documents(spark, sf_dir):
    """Groups and arrays of a store, as its metadata documents tell them."""
    from tessella.sources.store import write_metadata

    path, plan = new_folder(spark, "documents"), ArrayPlan(orders_spec(name="plate/w"))
    names = write_metadata(path, plan, 6)
    files = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").text(path).select(F.col("value"), F.input_file_name().alias("file"))
    doc = F.from_json("value", "node_type string, shape array<int>")
    assert len(names) == plan.levels + 3
    base = F.regexp_replace("file", "^.*?documents-[0-9a-f]+/", "")
    return files.select(base.alias("path"), doc["node_type"].alias("kind"), F.coalesce(F.array_join(doc["shape"].cast("array<string>"), ", "), F.lit("")).alias("shape"))


# Volume.


@query(
    """WITH c AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS i, CAST(l_quantity AS BIGINT) AS v FROM lineitem)
SELECT i // 10000 AS t, i // 100 % 100 // 2 AS y, i % 100 // 2 AS x, CAST(sum(v) // count(*) AS INTEGER) AS value FROM c GROUP BY ALL"""
)
def lod_lineitem_mean(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem")
    spec = ArraySpec((Dim("t", 0, 1, 4), Dim("y", 100, 50, downsample=True), Dim("x", 100, 50, downsample=True)), dtype="i32")
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    return reduce_level(ce.cells(ranked(rows, keys).select("idx", F.col("l_quantity").cast("bigint").alias("value")), spec), ArrayPlan(spec))


def ranked(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``idx``, the place in the order of the keys: counts below each value of the first key, then ranks within it.

    Counts are summed in two steps, within and over groups of buckets of the first key.  The only window without a partition
    runs over the groups, which are one for every 1024 * 4096 values of that key.
    """
    bucket = ix.idiv(keys[0], 1024)
    sums = rows.groupBy(bucket.alias("__b")).agg(F.count("*").alias("n")).withColumn("__g", ix.idiv("__b", 4096))
    groups = sums.groupBy("__g").agg(F.sum("n").alias("n")).select("__g", (F.sum("n").over(Window.orderBy("__g")) - F.col("n")).alias("__before"))
    inside = sums.withColumn("__inside", F.sum("n").over(Window.partitionBy("__g").orderBy("__b")) - F.col("n"))
    below = inside.join(groups, "__g").select("__b", (F.col("__before") + F.col("__inside")).alias("__below"))
    within = rows.withColumn("__b", bucket).withColumn("__r", F.row_number().over(Window.partitionBy("__b").orderBy(*keys)))
    return within.join(below, "__b").withColumn("idx", F.col("__below") + F.col("__r") - 1).drop("__b", "__r", "__below")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = orders_spec("mean", "mean")
    return all_levels(orders(spark, sf_dir, spec), ArrayPlan(spec))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in _Q.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _Q.items() if sql}
