import random
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F
from oracle import cells_of, fold as fold_oracle, halve

from tessella.functions import index as ix
from tessella.operators.cells import array_cells, beyond_capacity, cells, checked, epoch, index_of, inside, per_array
from tessella.operators.codec import available, compress, decode, decompress, encode, require, worst_size
from tessella.operators.fold import fold_level
from tessella.operators.metrics import discard, metered, timed
from tessella.operators.packed import next_level, packed_levels, packed_pyramid, reduce_block
from tessella.operators.pyramid import pyramid
from tessella.operators.shard import assemble, crc32c, key_from_number, pack_shard, parse_index, parse_shard
from tessella.operators.tile import tile, untile
from tessella.plans.geometry import ArrayPlan
from tessella.plans.spec import DTYPES, REDUCERS, ArraySpec, Codec, Dim, SpecError
from tessella.sources import synthetic


def frame(spark, a, names):
    rows = cells_of(a, names)
    kind = "double" if a.dtype.kind == "f" else "bigint"
    return spark.createDataFrame(rows, ", ".join([*(f"{n} bigint" for n in names), f"value {kind}"]))


def dense(rows, names, shape, dtype):
    out = np.zeros(shape, dtype)
    for r in rows.collect():
        out[tuple(r[n] for n in names)] = r["value"]
    return out


@pytest.mark.parametrize("method", REDUCERS)
def test_pyramid_against_numpy(spark, method):
    rng = np.random.default_rng(1)
    for shape, axes in (((3, 5, 6), (1, 2)), ((2, 7, 3, 5), (1, 3))):
        a = rng.integers(-50, 50, shape).astype(np.int64)
        ds = tuple(Dim(n, s, 2 if i in axes else 1, downsample=i in axes) for i, (n, s) in enumerate(zip("abcd", shape)))
        plan = ArrayPlan(ArraySpec(ds, dtype="i64", reduce=method))
        names = plan.spec.names
        got = pyramid(frame(spark, a, names), plan)
        assert plan.levels > 2
        for level in range(plan.levels):
            assert (dense(got.where(f"level = {level}"), names, a.shape, np.int64) == a).all(), (method, level)
            a = halve(a, axes, method)


def test_one_exchange_for_all_levels(spark):
    plan = ArrayPlan(ArraySpec((Dim("t", 4, 1), Dim("y", 32, 4, downsample=True), Dim("x", 32, 4, downsample=True))))
    top = pyramid(cells(synthetic.ramp(spark, 4096), plan.spec), plan).where("level = 3")
    assert top._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("dtype", [d for d in DTYPES if d not in ("f16",)])
def test_element_types(spark, dtype):
    d = DTYPES[dtype]
    plan = ArrayPlan(ArraySpec((Dim("t", 2, 1), Dim("x", 5, 2, downsample=True)), dtype=dtype, reduce="mean"))
    high = min(100, (d.bounds or (0, 100))[1])
    a = (np.arange(10).reshape(2, 5) * 7 % high).astype(d.numpy)
    got = pyramid(cells(spark.createDataFrame([(i, int(v)) for i, v in enumerate(a.ravel())], "idx bigint, value bigint"), plan.spec), plan)
    assert dict(got.dtypes)["value"] == d.spark
    want = halve(a, (1,), "mean")
    assert np.allclose(dense(got.where("level = 1"), ["t", "x"], want.shape, np.float64), want.astype(float))
    back = untile(tile(got.where("level = 0").drop("level"), plan), plan)
    assert dict(back.dtypes)["value"] == d.spark
    assert np.allclose(dense(inside(back, plan.spec), ["t", "x"], a.shape, np.float64), a.astype(float))


@pytest.mark.parametrize("method, level, want", [("mean_fold", 1, 100), ("mean_fold", 2, 34), ("mean_fold", 3, 14), ("mean", 3, 100)])
def test_fold_of_a_constant(spark, method, level, want):
    spec = ArraySpec((Dim("t", 0, 1, 1, True), Dim("x", 2, 1, downsample=True)), dtype="i32", append_reduce=method)
    got = fold_level(cells(synthetic.constant(spark, 16, 100), spec), ArrayPlan(spec), level).select("value").distinct().collect()
    assert [r[0] for r in got] == [want]


@pytest.mark.parametrize("method", ["mean", "mean_fold", "min", "max"])
def test_fold_against_numpy(spark, method):
    a = np.random.default_rng(2).integers(0, 500, (13, 3)).astype(np.int64)
    spec = ArraySpec((Dim("t", 0, 2, 1, True), Dim("x", 3, 1, downsample=True)), dtype="i32", append_reduce=method)
    for level in (1, 2):
        want = {(t, x): v for t, row in fold_oracle(a, 2, level, method).items() for x, v in enumerate(row)}
        got = {(r["t"], r["x"]): r["value"] for r in fold_level(frame(spark, a, ["t", "x"]), ArrayPlan(spec), level).collect()}
        assert got == want


def test_fold_of_two_append_dims_restarts(spark):
    spec = ArraySpec((Dim("t", 0, 1, 1), Dim("z", 3, 1, downsample=True), Dim("y", 2, 1, downsample=True)), dtype="i32", append_reduce="max")
    got = {(r["t"], r["z"]): r["value"] for r in fold_level(cells(synthetic.ramp(spark, 12), spec), ArrayPlan(spec), 1).where("y = 1").collect()}
    assert got == {(0, 0): 3, (0, 1): 5, (1, 0): 9, (1, 1): 11}


@pytest.mark.parametrize("seed", range(4))
def test_tile_round_trip(spark, seed):
    rng = random.Random(seed)
    shape = [rng.randint(1, 7) for _ in range(3)]
    inner = [1, 2]
    rng.shuffle(inner)
    ds = tuple(Dim(n, s, rng.randint(1, 4) + (i == 0), rng.randint(1, 3), position=p) for i, (n, s, p) in enumerate(zip("tyx", shape, [0, *inner])))
    plan = ArrayPlan(ArraySpec(ds, dtype="i32", fill=-7))
    source = cells(synthetic.noise(spark, int(np.prod(shape)), seed=seed), plan.spec)
    chunks = tile(source, plan)
    back = untile(chunks, plan)
    assert back.count() == chunks.count() * plan.chunk_elements
    assert {tuple(r) for r in inside(back, plan.spec).collect()} == {tuple(r) for r in source.collect()}
    assert all(r["value"] == -7 for r in back.exceptAll(source).collect())


def test_empty_input(spark):
    plan = ArrayPlan(ArraySpec((Dim("t", 4, 2), Dim("x", 4, 2, downsample=True)), dtype="i32"))
    none = cells(synthetic.zeros(spark, 0), plan.spec)
    assert pyramid(none, plan).count() == 0 and tile(none, plan).count() == 0 and assemble(encode(tile(none, plan), Codec()), plan).count() == 0


def test_capacity_epochs_and_checks(spark):
    spec = ArraySpec((Dim("t", 6, 1, 6), Dim("z", 4, 1, 4), Dim("x", 8, 4)), dtype="u8")
    rows = synthetic.ramp(spark, 193, 0xFF)
    assert cells(rows, spec).count() == 192 and beyond_capacity(rows, spec).count() == 1
    got = cells(rows, spec).select(epoch(spec).alias("e"), index_of(spec).alias("i")).collect()
    assert all(r["e"] == r["i"] // 8 for r in got)
    assert checked(cells(rows, spec), "u8").count() == 192
    with pytest.raises(Exception, match="not a u8"):
        checked(cells(synthetic.constant(spark, 4, 300), spec), "u8").collect()


def test_morton():
    want = [[0, 2, 6, 8, 12], [1, 3, 7, 9, 13], [4, 5, 10, 11, 14]]
    assert [[ix.morton_rank([3, 5], [y, x]) for x in range(5)] for y in range(3)] == want
    shape = (3, 4, 5)
    assert sorted(ix.morton_rank(shape, c) for c in product(*map(range, shape))) == list(range(60))


def test_division_truncates(spark):
    r = spark.range(1).select(ix.idiv(ix.F.lit(-7), 2).alias("a"), ix.ceil_div(ix.F.lit(7), 2).alias("b")).first()
    assert (r["a"], r["b"]) == (-3, 4)


@pytest.mark.parametrize("codec", [Codec(), Codec("lz4", 1), Codec("lz4", 12), Codec("zstd"), Codec("zstd", 9)])
def test_codecs(spark, codec):
    for data in (b"", b"a" * 1000, bytes(range(256)) * 9):
        packed = compress(data, codec)
        assert decompress(packed, codec, len(data)) == data and len(packed) <= worst_size(codec, len(data))
    plan = ArrayPlan(ArraySpec((Dim("x", 10, 4),), dtype="i32", codec=codec))
    chunks = tile(cells(synthetic.ramp(spark, 10), plan.spec), plan)
    back = decode(encode(chunks, codec), codec, plan.chunk_bytes)
    assert {(*r["chunk"], bytes(r["payload"])) for r in back.collect()} == {(*r["chunk"], bytes(r["payload"])) for r in chunks.collect()}


def test_missing_codec_is_an_error():
    codec = Codec("blosc-lz4", 5)
    assert codec.is_blosc and not codec.has_device_form
    if not available(codec):
        with pytest.raises(SpecError, match="not available"):
            require(codec)


def test_shard_bytes():
    assert crc32c(b"123456789") == 0xE3069283
    data = pack_shard([(2, b"cc"), (0, b"aaa")], 4)
    assert parse_shard(data, 4) == {0: b"aaa", 2: b"cc"} and len(data) == 5 + 64 + 4
    assert parse_index(data, 4).tolist() == [[0, 3], [2**64 - 1] * 2, [3, 2], [2**64 - 1] * 2]
    padded = pack_shard([(0, b"aaa")], 1, 512)
    assert len(padded) == 512 + 16 + 4 and parse_shard(padded, 1) == {0: b"aaa"}
    with pytest.raises(ValueError):
        parse_index(data[:-1] + b"x", 4)
    assert key_from_number(7, [0, 2, 3]) == "c/1/0/1"


def test_uneven_shards_follow_the_chunk_grid(spark):
    plan = ArrayPlan(ArraySpec((Dim("y", 4, 2, 2), Dim("x", 6, 2, 2)), dtype="i32"))
    shards = {r["key"]: parse_shard(bytes(r["object"]), 4) for r in assemble(encode(tile(cells(synthetic.ramp(spark, 24), plan.spec), plan), Codec()), plan).collect()}
    assert sorted(shards) == ["c/0/0", "c/0/1"]
    assert sorted(shards["c/0/0"]) == [0, 1, 2, 3] and sorted(shards["c/0/1"]) == [0, 2]
    assert np.frombuffer(shards["c/0/0"][2], "<i4").tolist() == [12, 13, 18, 19]


@pytest.mark.parametrize("method", REDUCERS)
@pytest.mark.parametrize("kind", ["<u2", "<i4", "<i8", "<f8"])
def test_packed_blocks(method, kind):
    rng = np.random.default_rng(3)
    for shape in ((3, 5), (4, 4), (1, 7), (2, 3, 5)):
        a = rng.integers(0 if "u" in kind else -40, 40, shape).astype(kind)
        assert np.allclose(reduce_block(a, [0, 1], method).astype(float), halve(a, (0, 1), method).astype(float))


def test_packed_pyramid_equals_cells(spark):
    spec = ArraySpec((Dim("t", 3, 2), Dim("y", 9, 4, downsample=True), Dim("x", 11, 4, downsample=True)), dtype="i32", reduce="median", fill=5)
    plan = ArrayPlan(spec)
    source = cells(synthetic.noise(spark, 3 * 99), spec)
    levels = pyramid(source, plan)
    for level, chunks in enumerate(packed_pyramid(tile(source, plan), plan)):
        want = tile(levels.where(f"level = {level}"), plan)
        assert {(*r["chunk"], bytes(r["payload"])) for r in chunks.collect()} == {(*r["chunk"], bytes(r["payload"])) for r in want.collect()}
    odd = ArrayPlan(ArraySpec((Dim("t", 3), Dim("y", 9, 3, downsample=True))))
    with pytest.raises(SpecError):
        next_level(source, odd, 0)


@pytest.mark.parametrize("method, kind", [("mean", "i16"), ("mean", "u16"), ("max_sup", "i32"), ("mean", "f64")])
@pytest.mark.parametrize("edge", [4, 6, 8])
def test_all_packed_levels_equal_cells(spark, method, kind, edge):
    spec = ArraySpec((Dim("t", 3, 2), Dim("y", 21, edge, downsample=True, position=2), Dim("x", 13, edge, downsample=True, position=1)), dtype=kind, reduce=method, fill=5)
    plan = ArrayPlan(spec)
    source = cells(synthetic.noise(spark, 3 * 21 * 13).withColumn("value", F.expr("value - 2048 * cast(%s as int)" % (kind[0] != "u"))), spec)
    want = {(r["level"], *r["chunk"], bytes(r["payload"])) for r in tile(pyramid(source, plan), plan, by=("level",)).collect()}
    assert {(r["level"], *r["chunk"], bytes(r["payload"])) for r in packed_levels(tile(source, plan), plan).collect()} == want


def test_several_arrays(spark):
    specs = {"a": ArraySpec((Dim("i", 4), Dim("x", 4)), dtype="i32"), "b": ArraySpec((Dim("i", 0, 1, 1), Dim("x", 3)), dtype="i32")}
    rows = spark.createDataFrame([("a", i, i) for i in range(20)] + [("b", i, 100 + i) for i in range(7)], "array_id string, idx bigint, value bigint")
    got = per_array(rows, specs, cells)
    assert got.where("array_id = 'a'").count() == 16
    assert {(r["i"], r["x"], r["value"]) for r in got.where("array_id = 'b'").collect()} == {(k // 3, k % 3, 100 + k) for k in range(7)}


def test_cells_of_several_arrays(spark):
    specs = {"a": ArraySpec((Dim("i", 4), Dim("x", 4)), dtype="i16"), "b": ArraySpec((Dim("i", 0, 1, 1), Dim("y", 3)), dtype="i32")}
    rows = spark.createDataFrame([("a", i, i) for i in range(20)] + [("b", i, 100 + i) for i in range(7)] + [("c", 0, 0), (None, 1, 1)], "array_id string, idx bigint, value bigint")
    got = array_cells(rows, specs)
    assert got.columns == ["array_id", "i", "x", "y", "value"] and dict(got.dtypes)["value"] == "int"
    assert {tuple(r) for r in got.collect()} == {("a", k // 4, k % 4, None, k) for k in range(16)} | {("b", k // 3, None, k % 3, 100 + k) for k in range(7)}
    with pytest.raises(SpecError):
        array_cells(rows, {})


def test_times_of_stages(spark):
    with timed(spark) as took:
        discard(spark.range(1000, numPartitions=3).groupBy((F.col("id") % 7).alias("k")).count())
    assert took.seconds > 0 and len(took.stages) >= 2 and took.stages[0].tasks == 3 and took.total("shuffle_written") > 0
    assert all(s.seconds <= took.seconds + 1 for s in took.stages)


def test_sweep(spark, tmp_path, capsys):
    import sweep

    argv = ["--mib", "8", "--codecs", "none,zstd:1", "--sides", "32", "--fills", "zeros", "--out", f"{tmp_path}/r.jsonl"]
    first = sweep.main(argv, spark)
    assert [r["codec"] for r in first] == ["none", "zstd:1"] and first[1]["ratio"] > 10 and all(r["stages"] and r["mib_s"] > 0 for r in first)
    assert sweep.main(argv, spark) == first and capsys.readouterr().out.count("zstd:1") == 2
    with pytest.raises(SpecError):
        sweep.settings(sweep.arguments(["--fills", "red"]))


def test_metrics(spark):
    plan = ArrayPlan(ArraySpec((Dim("x", 10, 4),), dtype="i32"))
    chunks, seen = metered(tile(cells(synthetic.ramp(spark, 10), plan.spec), plan), "chunks", "payload")
    discard(chunks)
    assert seen.get == {"rows": 3, "bytes": 48}
