import pytest

from tessella.plans.geometry import ArrayPlan, advise_chunks, inverse_permutation, level_count, lifted_strides, strides
from tessella.plans.spec import (
    ArraySpec,
    Codec,
    Dim,
    SpecError,
    append_count,
    align_up,
    ceil_log2,
    ceildiv,
    dims,
    dtype,
    next_pow2,
    with_chunk_budget,
    with_chunk_bytes,
    with_chunks,
    with_downsample,
    with_shard_counts,
    with_storage_order,
)


def spec(*ds, **more):
    return ArraySpec(tuple(Dim(n, *x) for n, x in zip("tczyx"[-len(ds) :] if len(ds) < 5 else "tczyx", ds)), **more)


def test_layout_numbers():
    p = ArrayPlan(spec((4, 2), (4, 2), (6, 3)))
    assert (p.chunk_elements, p.chunks_per_epoch(), p.epoch_elements) == (12, 4, 48)
    p = ArrayPlan(ArraySpec((Dim("t", 0, 1, 2), Dim("z", 4, 1, 4), Dim("y", 64, 32, 2), Dim("x", 64, 32, 2))))
    assert (p.chunks_per_epoch(), p.chunk_elements, p.epoch_elements, p.bounded_append_chunks, p.spec.n_append) == (4, 1024, 4096, 4, 2)
    p = ArrayPlan(ArraySpec((Dim("t", 0, 1, 1), Dim("z", 5, 1), Dim("y", 128, 64), Dim("x", 96, 32))))
    assert (p.chunks_per_epoch(), p.chunk_elements, p.epoch_elements) == (6, 2048, 12288)


@pytest.mark.parametrize("n, ratios, want", [(2**19, [1, 0, 2, 2], [16, 1, 128, 256]), (2**12, [1, 1, 1], [16, 16, 16])])
def test_chunk_budget(n, ratios, want):
    ds = dims("abcd"[: len(ratios)], [1000] * len(ratios))
    assert [d.n for d in with_chunk_budget(ds, n, ratios)] == want
    assert [d.n for d in with_chunk_bytes(ds, 2 * n, "u16", ratios)] == want
    assert with_chunk_budget(ds, 0, ratios) == ds and with_chunk_budget(ds, n, [0] * len(ratios)) == ds


def test_shard_counts():
    ds = with_chunks(dims("tcyx", [1000, 2, 2048, 2304]), [16, 1, 128, 256])
    assert [d.chunks_per_shard for d in with_shard_counts(ds, [1, 1, 4, 4])] == [63, 2, 4, 3]


def test_append_extents():
    p = ArrayPlan(ArraySpec((Dim("t", 0, 5, 1), Dim("y", 4), Dim("x", 4))))
    assert p.append_sizes_final(12 * 16) == [12]
    assert p.append_sizes_midway(3) == [15]
    p = ArrayPlan(ArraySpec((Dim("t", 0, 1, 1, True), Dim("y", 64, 8, downsample=True), Dim("x", 4))))
    assert [p.append_sizes_final(12 * 256, level)[0] for level in range(4)] == [12, 6, 3, 2]
    assert p.append_sizes_final(11 * 256, 1) == [6]


def test_levels_stop_when_all_fit():
    assert level_count([20, 25], [5, 5]) == 4
    assert level_count([5, 5], [5, 5]) == 1
    assert level_count([1000, 4], [4, 4], 3) == 3
    p = ArrayPlan(spec((8, 2), (20, 5, 0, True), (25, 5, 0, True)))
    assert [p.shape(level) for level in range(p.levels)] == [[8, 20, 25], [8, 10, 13], [8, 5, 7], [8, 3, 4]]
    assert ArrayPlan(spec((8, 2), (20, 5))).levels == 1


def test_shards_never_exceed_chunks():
    p = ArrayPlan(spec((8, 2, 3), (20, 5, 9, True), (25, 5, 2, True)))
    assert [e.chunks_per_shard for e in p.extents()] == [3, 4, 2]
    assert [e.shard_count for e in p.extents()] == [2, 1, 3]
    assert [e.chunks_per_shard for e in p.extents(3)] == [3, 1, 1]


def test_helpers():
    assert strides([2, 3, 4]) == [12, 4, 1]
    assert inverse_permutation([2, 0, 1]) == [1, 2, 0]
    assert lifted_strides([4, 6], [2, 3], [0, 1]) == [(12, 3), (6, 1)]
    assert lifted_strides([4, 6], [2, 3], [1, 0]) == [(6, 1), (12, 2)]
    assert (ceildiv(7, 2), align_up(7, 4), ceil_log2(5), ceil_log2(1), next_pow2(5)) == (4, 8, 3, 0, 8)
    assert [d.position for d in with_storage_order(dims("tyx", [1, 2, 3]), "txy")] == [0, 2, 1]
    assert [d.downsample for d in with_downsample(dims("tyx", [1, 2, 3]), "yx")] == [False, True, True]
    assert append_count([Dim("t", 0, 1), Dim("z", 4, 1, downsample=True), Dim("c", 4, 1), Dim("y", 8, 4)]) == 2


def test_dtypes():
    assert (dtype("u8").accumulator_bytes, dtype("u16").accumulator_bytes, dtype("u32").accumulator_bytes, dtype("f16").accumulator_bytes) == (4, 4, 8, 4)
    assert dtype("uint16").name == "u16" and dtype("i8").bounds == (-128, 127) and dtype("f32").bounds is None


@pytest.mark.parametrize(
    "make",
    [
        lambda: ArraySpec((Dim("t", 0, 2), Dim("x", 4, 2))),
        lambda: ArraySpec((Dim("t", 4, 2), Dim("x", 0, 2, 1))),
        lambda: ArraySpec((Dim("t", 4, 0),)),
        lambda: ArraySpec((Dim("t", 4, 2, position=1), Dim("x", 4, 2, position=0))),
        lambda: ArraySpec((Dim("t", 4, 2), Dim("x", 4, 2, position=2), Dim("y", 4, 2, position=2))),
        lambda: ArraySpec((Dim("t", 4, 2), Dim("t", 4, 2))),
        lambda: ArraySpec((Dim("t", 4, 2, downsample=True), Dim("x", 4, 2))),
        lambda: ArraySpec((Dim("t", 4, 2, downsample=True), Dim("x", 4, 2, downsample=True)), append_reduce="median"),
        lambda: ArraySpec((Dim("t", 4, 2),), codec=Codec("lz4", 0)),
        lambda: ArraySpec((Dim("t", 4, 2),), codec=Codec("blosc-zstd", 10)),
        lambda: ArraySpec((Dim("t", 4, 2),), reduce="mode"),
        lambda: ArraySpec((Dim("t", 4, 2),), max_levels=33),
        lambda: ArraySpec(()),
        lambda: with_storage_order(dims("tyx", [1, 2, 3]), "tyy"),
        lambda: ArrayPlan(ArraySpec((Dim("t", 1 << 20, 1 << 10), Dim("x", 1 << 20, 1 << 10)))).check_shards(),
    ],
)
def test_what_cannot_be(make):
    with pytest.raises(SpecError):
        make()


def test_batches_and_memory():
    p = ArrayPlan(ArraySpec((Dim("t", 0, 1, 1), Dim("y", 64, 8), Dim("x", 64, 8))))
    assert p.epochs_per_batch == 16
    assert ArrayPlan(ArraySpec((Dim("t", 0, 1, 1), Dim("x", 8, 8)))).epochs_per_batch == 128
    assert p.memory_bytes(2)["chunks"] == 2 * 64 * 64 * 2
    got = advise_chunks(p.spec, 1 << 13, [0, 1, 1], 3 << 20)
    assert sum(ArrayPlan(got).memory_bytes().values()) <= 3 << 20
    with pytest.raises(SpecError):
        advise_chunks(p.spec, 1 << 13, [0, 1, 1], 10)


def test_table(spark):
    p = ArrayPlan(spec((8, 2), (20, 5, 0, True), (25, 5, 0, True)))
    assert p.to_df(spark).count() == 12
    assert len(str(p).splitlines()) == 13
