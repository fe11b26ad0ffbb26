"""Classifiers, media, tokens, packing, mixing and chats."""

import json
import random
import zlib
from hashlib import md5, sha256

import numpy as np
import pytest

from tessella.llm import flac
from tessella.llm.chat import canonical, format_chats, violations
from tessella.llm.common import held_out
from tessella.llm.flac import flac_column, media_digests, pcm_blocks
from tessella.llm.language_id import LanguageModel, fit_language_model, identified, predict_language, shares, trainable
from tessella.llm.mixing import RIDGE, SOFT, ascend, fit_domains, fit_rates, mix, mixed, posteriors
from tessella.llm.packing import LENGTHS, costs, pack, pack_sizes, word_counts
from tessella.llm.quality import WIDTH, ByteNet, fit_quality, score_quality

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = {
    "en": "the of and that with from have this which their would there about".split(),
    "de": "der die und nicht mit von haben dieser welche ihre würde über schön".split(),
    "fr": "le la et que avec pour dans cette leur serait où très être".split(),
    "es": "el la y que con para por esta sería año muy señor está".split(),
}


def frame(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def sample(n, seed=0):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(list(WORDS))
        out.append((i, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randint(4, 60))).capitalize(), lang, "s", 0))
    return out


#: Rows without a letter, though some have characters that are word characters.
SIGNS = [(9101, "½ ² ① 12", "de", "s", 1), (9102, "_ _ ٣", "fr", "s", 1)]
ODD = [(9001, None, "en", None, None), (9002, "", None, "s", 0), (9003, "123 !!! ---", "de", "s", 1), (9004, "the and " * 20_000, None, None, 1), (None, "le et la que", None, None, None), (5, "the of and", None, None, None)]


def test_samples_from_an_offset():
    rng = np.random.default_rng(3)
    pcm = bytes(rng.integers(60, 200, 5 * flac.BLOCK + 64).astype(np.uint8))
    stream = flac.encode([pcm])[0]
    for a, b in [(0, 1), (0, len(pcm)), (flac.BLOCK - 1, flac.BLOCK + 1), (1500, 4000), (len(pcm) - 3, len(pcm) + 9), (-5, 3), (70, 70), (10**6, 10**7)]:
        assert flac.read_samples(stream, a, b) == pcm[max(0, a) : b]
    # A damaged frame is not read where other samples are wanted.
    frames, _, _ = flac.index(stream)
    broken = bytearray(stream)
    broken[frames[4].byte + frames[4].size // 2] ^= 1
    assert flac.read_samples(bytes(broken), 0, 2000) == pcm[:2000]
    with pytest.raises(ValueError):
        flac.read_samples(bytes(broken), 4 * flac.BLOCK, 4 * flac.BLOCK + 5)


def test_held_out(spark):
    got = {r["doc_id"]: r["h"] for r in spark.range(50).withColumnRenamed("id", "doc_id").select("doc_id", held_out().alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in range(50)}


def test_language(spark):
    docs = frame(spark, sample(400) + ODD).selectExpr("*", "1 as score", "'x' as lang_pred")
    model = fit_language_model(trainable(docs), 60)
    assert model.families == ["germanic", "romance"] and model.pairs == [("de", "en"), ("es", "fr")]
    got = predict_language(docs, model).collect()
    assert len(got) == 406 and all(0 <= r["score"] <= 1 for r in got)
    true = {i: lang for i, _, lang, _, _ in sample(400)}
    assert np.mean([true[r["doc_id"]] == r["lang_pred"] for r in got if (r["doc_id"] or 9999) < 400 and r["doc_id"] != 5]) > 0.97
    assert {r["doc_id"]: r["lang_pred"] for r in got if (r["doc_id"] or 0) > 9000} == {9001: "und", 9002: "und", 9003: "und", 9004: "en"}
    kept = identified(docs, model)
    assert kept.columns == docs.columns and kept.count() == 403
    assert [(r["lang_pred"], r["score"]) for r in predict_language(frame(spark, SIGNS), model).collect()] == [("und", 0.0)] * 2
    assert identified(frame(spark, SIGNS), model).count() == 0
    none = fit_language_model(trainable(frame(spark, [])))
    assert predict_language(docs, none).where("lang_pred <> 'und'").count() == 0
    assert predict_language(frame(spark, []), model).count() == 0


def test_lookup_equals_dense_machine():
    rows = sample(120, 3)
    x = np.stack([shares(t) for _, t, *_ in rows])
    model = LanguageModel.fit(x, [r[2] for r in rows])
    for vector, (_, t, *_) in zip(x[:20], rows):
        k = int((vector @ model.weights[:, : len(model.families)] + model.bias[: len(model.families)]).argmax())
        pred, _ = model.predict(t)
        assert pred in {"germanic": ("de", "en"), "romance": ("es", "fr")}[model.families[k]]
    single = LanguageModel.fit(x[:5], ["xx"] * 5)
    assert single.predict("any words")[0] == "xx"


def test_net_gradient_and_chunks():
    net, rng = ByteNet.new(3), np.random.default_rng(0)
    for n in (0, 1, 127, 128, 129, 1000):
        raw = rng.integers(0, 256, n).astype(np.uint8)
        padded = np.concatenate([raw, np.zeros(WIDTH, np.uint8)])
        conv = np.stack([sum(net.tables[w][padded[i + w]] for w in range(WIDTH)) for i in range(len(padded) - WIDTH + 1)])
        blocks = [conv[i : i + 128].max(0) for i in range(0, len(conv), 128)]
        chunk = np.array([np.maximum(a, b) for a, b in zip(blocks, blocks[1:])] or blocks)
        act = np.maximum(chunk + net.bias, 0)
        want = np.concatenate([act.mean(0), act.max(0), act.min(0)])
        assert np.allclose(net.vector(raw), want, atol=1e-4) and np.allclose(net.pooled(raw)[0], want, atol=1e-4)


def test_quality(spark):
    rows = sample(400, 5)
    bad = {i for i in range(400) if i % 3 == 0}
    rows = [(i, t.upper().replace(" ", "!! ") if i in bad else t, *r) for i, t, *r in rows] + ODD
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(i, int(i not in bad), 0) for i in range(400)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    net = fit_quality(docs, labels, 80)
    got = score_quality(docs, net).join(labels.where("doc_id is not null and quality is not null"), "doc_id").select("*", held_out().alias("h")).where("h").collect()
    assert np.mean([(r["score"] >= 0.5) == r["quality"] for r in got]) > 0.95
    assert score_quality(docs, net).count() == len(rows) and score_quality(docs, net).where("score is null or score < 0 or score > 1").count() == 0
    assert fit_quality(docs, labels.where("quality = 1")) == 1.0 and fit_quality(docs, labels.limit(0)) == 0.5
    assert score_quality(frame(spark, []), 0.5).count() == 0


def test_flac_columns(spark):
    rows = sample(40, 6) + ODD + [(7001, "x" * 5000, None, None, None), (7002, "".join(map(chr, range(32, 3000))), None, None, None), (7002, "", None, None, None)]
    docs = frame(spark, rows).selectExpr("doc_id", "text", "doc_id as media", "n_chars as n_bytes")
    media = flac_column(docs)
    got = sorted(media_digests(media).collect(), key=str)
    assert len(got) == len(rows)
    want = sorted((i, *flac.payload(t)) for i, t, *_ in rows if i is not None)
    found = sorted(((r["doc_id"], r["payload_bytes"], r["payload_sha256"], r["n_bytes"], r["tail_crc32"]) for r in got if r["doc_id"] is not None))
    assert found == sorted((i, len(p), sha256(p).hexdigest(), n, zlib.crc32(p[-64:])) for i, p, n in want)
    blocks = pcm_blocks(media.where("doc_id = 9004")).orderBy("sample_offset").collect()
    pcm = b"".join(bytes(b["pcm"]) for b in blocks)
    assert pcm.rstrip(b"\0").decode() == "the and " * 20_000 and [b["sample_offset"] for b in blocks] == list(range(0, len(pcm), flac.BLOCK))
    stream = bytes(media.where("doc_id = 9004").first()["media"])
    assert all(stream[b["byte_offset"] : b["byte_offset"] + 2] == b"\xff\xf8" for b in blocks)
    assert media_digests(flac_column(frame(spark, []))).count() == 0


def test_flac_damage_is_seen():
    data = random.Random(1).randbytes(4096)
    (stream,) = flac.encode([data])
    assert b"".join(b for _, b in flac.decode([stream])[0]) == data
    frames, total, digest = flac.index(stream)
    assert total == 4096 and digest == md5(bytes(x ^ 128 for x in data)).digest() and len(frames) == 4
    for at in (frames[1].byte + 3, frames[2].byte + 100, 30):
        with pytest.raises(ValueError):
            flac.decode([stream[:at] + bytes([stream[at] ^ 1]) + stream[at + 1 :]])


def _bits(*fields):
    n = "".join(format(v & ((1 << w) - 1), f"0{w}b") for v, w in fields)
    n += "0" * (-len(n) % 8)
    return bytes(int(n[i : i + 8], 2) for i in range(0, len(n), 8))


def _rice(values, k):
    out = []
    for v in values:
        u = 2 * v if v >= 0 else -2 * v - 1
        out += [(0, 1)] * (u >> k) + [(1, 1)] + ([(u & ((1 << k) - 1), k)] if k else [])
    return out


def test_flac_decodes_what_the_encoder_does_not_write():
    """Partitioned residuals, escaped partitions, five-bit parameters, high fixed orders, long unary runs."""
    x = [int(40 * np.sin(i / 5)) + i % 7 for i in range(32)]

    def stream(sub):
        head = flac._frame_header(0, 32)
        frame = head + sub
        crc = flac.crc16(np.frombuffer(frame, np.uint8), np.array([0]), np.array([len(frame)]))[0]
        frame += int(crc).to_bytes(2, "big")
        info = (1024).to_bytes(2, "big") * 2 + bytes(6) + (8000 << 44 | 7 << 36 | 32).to_bytes(8, "big") + md5(bytes(v & 255 for v in x)).digest()
        seek = bytes(16) + (32).to_bytes(2, "big")
        return b"fLaC\x00" + (34).to_bytes(3, "big") + info + b"\x83" + (18).to_bytes(3, "big") + seek + frame

    d = np.array(x)
    for order in range(5):
        e = np.diff(d, order).tolist()
        warm = [(v, 8) for v in x[:order]]
        split = 16 - order
        plain = [(8 | order, 7), (0, 1), *warm, (0, 2), (1, 4), (0, 4), *_rice(e[:split], 0), (3, 4), *_rice(e[split:], 3)]
        escaped = [(8 | order, 7), (0, 1), *warm, (1, 2), (1, 4), (31, 5), (11, 5), *[(v, 11) for v in e[:split]], (4, 5), *_rice(e[split:], 4)]
        for fields in (plain, escaped):
            (blocks,) = flac.decode([stream(_bits(*fields))])
            assert [b - 128 for b in blocks[0][1]] == x


def brute_cost(sizes, bins):
    return sum(costs(LENGTHS)[c] for c in bins.capacity)


def test_packing(spark):
    rng = random.Random(12)
    sizes = sorted((min(8192, int(rng.lognormvariate(6, 1.2)) + 1) for _ in range(5000)), reverse=True)
    places, bins = pack_sizes(sizes)
    spans = {}
    for (b, o), n in zip(places, sizes):
        spans.setdefault(b, []).append((o, n))
    for b, own in spans.items():
        own.sort()
        assert own[0][0] == 0 and all(o + n == p for (o, n), (p, _) in zip(own, own[1:])) and sum(own[-1]) == bins.used[b] <= bins.capacity[b]
        assert bins.capacity[b] == next(c for c in LENGTHS if c >= bins.used[b])
    assert sum(sizes) / sum(bins.capacity) > 0.98
    one = [pack_sizes(sizes, (8192,))[1], pack_sizes(sizes, (8192, 4096))[1]]
    assert brute_cost(sizes, bins) <= min(brute_cost(sizes, b) for b in one)
    rows = [(i, rng.choice([0, 1, 500, 8192, 8193, 30_000, None, -3])) for i in range(300)] + [(None, 10), (7, 700), (7, 700)]
    docs = spark.createDataFrame(rows, "doc_id long, n_tokens long").selectExpr("*", "doc_id as group", "doc_id as n", "1 as piece")
    got = pack(docs, group_tokens=50_000).collect()
    assert sum(r["n_tokens"] for r in got) == sum(max(0, n or 0) for _, n in rows)
    totals = {}
    for r in got:
        if r["bin_id"] is None:
            assert r["n_tokens"] == 0
        else:
            totals.setdefault((r["bin_id"], r["bin_length"], r["bin_used"]), []).append((r["bin_offset"], r["n_tokens"]))
    assert len({k[0] for k in totals}) == len(totals)
    for (_, length, used), own in totals.items():
        assert sum(n for _, n in own) == used <= length in LENGTHS
        assert all(o + n == p for (o, n), (p, _) in zip(sorted(own), sorted(own)[1:]))
    same = spark.createDataFrame([(1, 8192), (1, 8192), (None, 10)] + [(None, 8193)] * 50, "doc_id long, n_tokens long")
    full = [r["bin_id"] for r in pack(same, group_tokens=60_000).collect() if r["n_tokens"] == 8192]
    assert len(full) == len(set(full)) == 52
    pieces = sorted((r["piece_start"], r["n_tokens"]) for r in got if r["doc_id"] == next(i for i, n in rows if n == 30_000))
    assert pieces == [(0, 8192), (8192, 8192), (16384, 8192), (24576, 5424)]
    assert pack(docs.limit(0)).count() == 0
    words = frame(spark, [(1, " a\tb\n\nc  ", None, None, None), (2, None, None, None, None), (3, "", None, None, None)])
    assert sorted((r[0], r[1]) for r in word_counts(words).collect()) == [(1, 3), (2, 0), (3, 0)]


def partitions(items):
    """All ways to put items into bins, as lists of lists."""
    if not items:
        yield []
        return
    for rest in partitions(items[1:]):
        yield [[items[0]], *rest]
        for k in range(len(rest)):
            yield [*rest[:k], [items[0], *rest[k]], *rest[k + 1 :]]


def test_packing_against_the_optimum():
    """Small cases: within a few per cent of the least cost over all ways to pack."""
    rng = random.Random(33)
    lengths, cost = (8, 16, 32), costs((8, 16, 32))
    ratio = []
    for _ in range(25):
        sizes = sorted((rng.randint(1, 32) for _ in range(rng.randint(1, 7))), reverse=True)
        best = min(sum(cost[next(c for c in lengths if c >= sum(b))] for b in bins) for bins in partitions(sizes) if all(sum(b) <= 32 for b in bins))
        got = sum(cost[c] for c in pack_sizes(sizes, lengths)[1].capacity)
        assert got >= best - 1e-9
        ratio.append(got / best)
    assert np.mean(ratio) < 1.1 and max(ratio) < 1.6


def project(p, n, t, rounds=20_000):
    """Plain projected gradient on the documents themselves, in the same metric."""
    g = np.linalg.inv((p * n[:, None]).T @ p / n.sum() + 1e-9 * np.eye(p.shape[1]))
    r = np.ones(len(n))
    for _ in range(rounds):
        r = np.maximum(0, r - p @ (g @ ((p * (n * r)[:, None]).sum(0) - t)) / n.sum())
    return r


def members_of(spark, seed):
    rng = np.random.default_rng(seed)
    p = rng.dirichlet([0.4, 0.3, 0.2], 200)
    n = rng.integers(1, 500, 200).astype(float)
    return p, n, spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(n, p)], "n_tokens long, p array<double>").coalesce(1)


@pytest.mark.parametrize("shares_", [(0.6, 0.3, 0.1), (0.85, 0.1, 0.05), (0.0, 0.5, 0.5), (1.0, 0.0, 0.0)])
def test_rates_against_brute_force(spark, shares_):
    p, n, members = members_of(spark, 13)
    target = n.sum() * np.array(shares_)
    rates = fit_rates(members, list(shares_))
    got = np.array([x["r"] for x in members.select(rates.column().alias("r")).collect()])
    want = project(p, n, target)
    assert got.min() >= 0 and np.allclose((p * (n * got)[:, None]).sum(0), rates.reached, rtol=1e-6) and np.allclose(rates.wanted, target)
    # Several sets of rates may reach the nearest totals; where all targets can be met, these are nearest to 1.
    miss = np.abs(np.array(rates.reached) - target).max() / n.sum()
    assert miss <= np.abs((p * (n * want)[:, None]).sum(0) - target).max() / n.sum() + 2e-3
    if shares_[0] == 0.6:
        assert miss < 1e-6 and (n * (got - 1) ** 2).sum() <= (n * (want - 1) ** 2).sum() * (1 + 1e-6)


def test_steps_end_whatever_the_targets():
    """Few steps, also where the targets cannot be met or all documents are alike."""
    rng = np.random.default_rng(0)
    for trial in range(200):
        k, m = rng.integers(2, 6), rng.choice([1, 3, 20, 300])
        p = rng.dirichlet(rng.choice([0.05, 0.3, 2, 50]) * np.ones(k), m)
        n = rng.integers(1, 1000, m).astype(float)
        share = rng.dirichlet(np.ones(k) * rng.choice([0.1, 1]))
        for most, ridge in ((np.inf, RIDGE), (1.0, SOFT)):
            calls = []

            def at(slopes):
                u = 1 + p @ slopes
                r = np.clip(u, 0, most)
                inside = (u > 0) & (u < most)
                calls.append(1)
                return (p * (n * r)[:, None]).sum(0) / n.sum(), (p[inside] * n[inside][:, None]).T @ p[inside] / n.sum(), (n * (np.maximum(u, 0) * r - r * r / 2)).sum() / n.sum()

            free = np.eye(k) if most > 1 else np.linalg.svd(share[None])[2][1:].T
            slopes, _, _ = ascend(at, list(at(np.zeros(k))), share if most > 1 else np.zeros(k), free, ridge, 1e-7)
            assert len(calls) < 150 and np.isfinite(slopes).all()


def test_rates_of_a_subset(spark):
    p, n, members = members_of(spark, 14)
    rates = fit_rates(members, [0.2, 0.4, 0.4], most=1.0, ridge=1e-6)
    got = np.array([x["r"] for x in members.select(rates.column().alias("r")).collect()])
    tokens = (p * (n * got)[:, None]).sum(0)
    assert 0 <= got.min() and got.max() <= 1 and np.allclose(tokens / tokens.sum(), [0.2, 0.4, 0.4], atol=1e-4)
    # Nearest to keeping all: no direction that keeps the shares and the bounds brings the rates nearer.
    rng = np.random.default_rng(1)
    free = (got > 1e-9) & (got < 1 - 1e-9)
    a = p[free] * n[free][:, None] - n[free][:, None] * np.array([0.2, 0.4, 0.4])
    for _ in range(20):
        v = rng.normal(size=free.sum())
        v -= a @ np.linalg.lstsq(a, v, rcond=None)[0]
        assert abs((n[free] * (got[free] - 1) * v).sum()) < 1e-3 * n.sum()
    assert fit_rates(members.limit(0), [1.0, 1.0], most=1.0).reached == [0.0, 0.0]
    with pytest.raises(ValueError):
        fit_rates(members, [0.0, 0.0, 0.0])


def test_mixed_reaches_its_shares(spark):
    rng = random.Random(31)
    words = {"a": [f"alpha{i}" for i in range(50)], "b": [f"beta{i}" for i in range(50)], "c": [f"gamma{i}" for i in range(50)]}
    rows = [(i, " ".join(rng.choice(words["abc"[i % 3]]) for _ in range(40)), "en", "s", 1) for i in range(1500)]
    docs = frame(spark, rows).withColumnRenamed("lang", "__taken").selectExpr("*", "1 as taken", "2 as rate")
    labelled = spark.createDataFrame([(i, "abc"[i % 3]) for i in range(600)], "doc_id long, domain string")
    kept = [r["doc_id"] % 3 for r in mixed(docs, labelled, {"a": 0.2, "b": 0.4, "c": 0.4}).collect()]
    shares_ = [kept.count(k) / len(kept) for k in range(3)]
    assert np.allclose(shares_, [0.2, 0.4, 0.4], atol=0.025) and len(kept) > 1200 and min(kept.count(1), kept.count(2)) >= 490
    assert mixed(docs, labelled.limit(0), {"a": 0.2, "b": 0.8}).count() == 1500


def test_mixing(spark):
    rows = sample(300, 14) + ODD
    docs = frame(spark, rows).selectExpr("*", "1 as word", "'d' as domain", "2.0 as rate")
    labelled = spark.createDataFrame([(i, "a" if lang in ("en", "de") else "b") for i, _, lang, *_ in rows[:150]] + [(None, "a"), (3, None), (4, "unknown")], "doc_id long, domain string")
    out = mix(docs, labelled, {"a": 3.0, "b": 1.0}).toPandas()
    assert len(out) == len({r[0] for r in rows}) and out.rate.min() >= 0
    tokens = (out.n_tokens * out.rate).sum()
    assert (out.n_tokens * out.rate * out.p_a).sum() / tokens == pytest.approx(0.75, abs=1e-3) and tokens == pytest.approx(out.n_tokens.sum(), rel=1e-3)
    assert np.allclose(out.p_a + out.p_b, 1)
    model = fit_domains(docs, labelled, ["a", "b"])
    right = posteriors(docs, model).toPandas().set_index("doc_id").p
    assert np.mean([(right[i][0] > 0.5) == (lang in ("en", "de")) for i, _, lang, *_ in rows[150:300]]) > 0.97
    kept = mixed(docs, labelled, {"a": 0.9, "b": 0.1})
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert {i for i, p in right.items() if p[0] >= 0.95 and i == i} <= ids and len(ids) < len(right)
    assert mix(docs.limit(0), labelled, {"a": 1.0}).count() == 0
    uniform = mix(docs, labelled.limit(0), {"a": 1.0, "b": 1.0}).first()
    assert uniform["p_a"] == 0.5


CHAT = "conv_id long, turn long, role string, text string"


def call(*calls):
    return json.dumps({"tool_calls": list(calls)})


def test_chats(spark):
    rows = [
        (1, 0, "user", "what is the weather"),
        (1, 1, "assistant", call({"id": "b", "name": "forecast", "arguments": {"at": [1, 2]}, "after": ["a"]}, {"id": "a", "name": "place", "arguments": '{"z": 1, "name": "Rom"}'})),
        (1, 2, "tool", json.dumps({"tool_call_id": "a", "content": {"y": 1, "x": 2.5}})),
        (1, 3, "tool", json.dumps({"tool_call_id": "b", "content": "sun"})),
        (1, 4, "tool", json.dumps({"tool_call_id": "b", "content": "rain"})),
        (1, 5, "tool", "no identifier"),
        (2, 0, "assistant", call({"id": "x", "name": "place", "arguments": {}, "after": ["y"]}, {"id": "y", "name": "place", "arguments": {"name": 1}, "after": ["x", "gone"]}, {"name": "none"})),
        (3, 0, None, None),
        (None, 0, "assistant", call({"id": "a", "name": "place", "arguments": {"name": "n"}})),
        (3, 1, "user", '{"broken'),
        (3, 1, "user", '{"broken'),
    ]
    schemas = {
        "place": {"type": "object", "required": ["name"], "properties": {"name": {"type": "string"}, "z": {"type": "integer"}}},
        "forecast": {"type": "object", "properties": {"at": {"type": "array", "items": {"type": "number"}, "maxItems": 2}}},
    }
    docs = spark.createDataFrame(rows, CHAT).selectExpr("*", "1 as level", "'k' as kind", "2 as payload")
    got = format_chats(docs, schemas, plain=False).collect()
    calls = {(r["conv_id"], r["call_id"]): r for r in got if r["kind"] == "call"}
    assert (calls[1, "a"]["level"], calls[1, "b"]["level"]) == (0, 1)
    assert (calls[1, "b"]["n_results"], calls[1, "b"]["result_turn"], json.loads(calls[1, "b"]["json"])["result"]) == (2, 3, "sun")
    assert calls[1, "a"]["json"] == '{"arguments":{"name":"Rom","z":1},"conv_id":1,"errors":[],"id":"a","name":"place","result":{"x":2.5,"y":1},"turn":1,"type":"call"}'
    assert calls[2, "x"]["level"] == calls[2, "y"]["level"] == -1 and calls[2, "2:0:2"]["level"] == 0
    assert not calls[2, "x"]["valid"] and not calls[2, "y"]["valid"] and calls[2, "2:0:2"]["n_errors"] == 1
    assert calls[None, "a"]["valid"] and calls[None, "a"]["n_results"] == 0
    assert sorted((r["turn"], r["kind"]) for r in got if r["conv_id"] == 3) == [(0, "message"), (1, "message"), (1, "message")]
    assert [r["turn"] for r in got if r["kind"] == "orphan_result"] == [5]
    assert [(r["turn"], r["call_id"], json.loads(r["json"])["result"]) for r in got if r["kind"] == "more_result"] == [(4, "b", "rain")]
    assert format_chats(docs.limit(0)).count() == 0
    plain = format_chats(spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "ho"), (1, 2, "user", ""), (1, 4, "assistant", "alone")], CHAT)).collect()
    assert sorted((r["turn"], r["kind"], r["valid"], r["n_results"]) for r in plain) == [(0, "call", True, 1), (2, "call", False, 0), (4, "orphan_result", None, 0)]


def test_odd_chats(spark):
    lone = '{"tool_calls":[{"id":"a\\ud800","name":"place","arguments":{"p":"\\ud800"}}]}'
    rows = [
        (1, 0, "assistant", lone),
        (2, 0, "assistant", " " * 70 + call({"id": "b", "name": "place", "arguments": {}})),
        (3, 0, "assistant", '{"tool_calls":[{"id":"c","name":"place","arguments":{"x":NaN}}]}'),
        (4, 0, "assistant", '{"tool_calls":[{"id":"d","name":"place","arguments":{"x":1e999}}]}'),
        (5, 0, "tool", '{"tool_call_id":"a","content":"\\udfff"}'),
    ]
    got = {r["conv_id"]: r for r in format_chats(spark.createDataFrame(rows, CHAT), {"place": {}}, plain=False).collect()}
    assert {i: r["kind"] for i, r in got.items()} == {1: "call", 2: "call", 3: "message", 4: "message", 5: "orphan_result"}
    assert json.loads(got[1]["json"])["arguments"] == {"p": "\ud800"} and json.loads(got[5]["json"])["result"] == "\udfff"
    assert got[1]["json"].isascii() and json.loads(got[3]["json"])["text"] == rows[2][3]
    with pytest.raises(ValueError):
        format_chats(spark.createDataFrame(rows, CHAT), {"place": {"properties": {"x": {"type": "colour"}}}})


def test_schemas():
    assert violations({"a": 1}, {"type": "object", "additionalProperties": False}) == ["$.a: not allowed"]
    assert violations([1, "x"], {"type": "array", "items": {"type": "integer", "minimum": 2}}) == ["$[0]: less than 2", "$[1]: not of type integer"]
    assert violations(True, {"type": "integer"}) and not violations(2.0, {"type": "integer"}) and not violations("b", {"enum": ["a", "b"]})
    assert canonical({"b": [1, {"d": None, "c": "é"}], "a": 1.5}) == '{"a":1.5,"b":[1,{"c":"é","d":null}]}'
