"""Near copies, repeated passages and fingerprints against brute force."""

import random
import re
from hashlib import sha256
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from tessella.llm import substring_dedup as s
from tessella.llm.common import components
from tessella.llm.fingerprint import Sketches, compare, differences, edited, fingerprints, paragraphs
from tessella.llm.jaccard_join import jaccard_classes, least_matches, without_near_copies
from tessella.llm.substring_dedup import Fenwick, chains, edits, repeated_passages, segments, winnow, without_repeats
from tessella.llm.words import Words, ngrams

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def text(rng, n, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def changed(rng, t, n):
    words = t.split()
    for i in rng.sample(range(len(words)), n):
        words[i] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None) for i, t in rows], DOCS)


def shingles(t):
    w = re.findall(r"[a-z0-9_\u0080-\U0010ffff]+", (t or "").lower())
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets, links, root = [shingles(t) for _, t in rows], [0] * len(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
            links[i], links[j] = links[i] + 1, links[j] + 1
            root[find(j)] = find(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d, least[find(i)], links[i]) for i, (d, _) in enumerate(rows))


def corpus(seed):
    rng = random.Random(seed)
    rows = [(i, text(rng, rng.choice([1, 3, 5, 30, 120]))) for i in range(60)]
    for k in range(25):
        source = rng.choice(rows[:60])[1]
        rows.append((100 + k, changed(rng, source, min(len(source.split()) - 1, rng.choice([0, 1, 2, 5])))))
    chain = text(rng, 150)
    for k in range(12):
        rows.append((200 + k, chain))
        chain = changed(rng, chain, 2)
    rows += [(300, None), (301, ""), (302, "!!! ..."), (303, "!!! ..."), (304, "Word"), (305, "word!"), (400, text(rng, 20_000)), (7, rows[7][1])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_links_and_classes(spark, seed):
    rows = corpus(seed)
    got = sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard_classes(frame(spark, rows)).collect())
    assert got == brute(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_links_within_band_buckets(spark, seed):
    """As ``test_links_and_classes``, with every cluster taken bucket by bucket."""
    rows = corpus(seed)
    got = sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard_classes(frame(spark, rows), by_bucket=0.0).collect())
    assert got == brute(rows)


def test_chains_of_hardly_similar_texts_are_taken_by_bucket(spark, monkeypatch):
    import tessella.llm.jaccard_join as j

    monkeypatch.setattr(j, "BLOCK_SETS", 4)
    rng = random.Random(6)
    words, rows = text(rng, 60, 10**6).split(), []
    for i in range(250):
        rows.append((i, " ".join(words)))
        words = words[25:] + text(rng, 25, 10**6).split()
    rows += [(1000 + i, changed(rng, rows[5 * i][1], 1)) for i in range(20)]
    got = sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard_classes(frame(spark, rows)).collect())
    assert got == brute(rows)


def test_blocks_of_a_large_cluster(spark, monkeypatch):
    import tessella.llm.jaccard_join as j

    monkeypatch.setattr(j, "BLOCK_SETS", 7)
    rng = random.Random(5)
    base = text(rng, 200)
    rows = [(i, changed(rng, base, rng.choice([1, 3, 6]))) for i in range(60)] + [(100 + i, base) for i in range(30)]
    got = sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard_classes(frame(spark, rows)).collect())
    assert got == brute(rows)


def test_posterior_bound():
    for seen in (16, 64, 128):
        m = least_matches(seen, 0.8, 1e-7)
        assert 0 < m < 0.8 * seen
    assert least_matches(128, 0.8, 1e-7) > least_matches(64, 0.8, 1e-7)


def test_join_defined_cases(spark):
    assert jaccard_classes(frame(spark, [])).count() == 0
    nulls = frame(spark, [(None, "a b c d e f"), (None, "a b c d e f"), (1, "a b c d e f")])
    assert sorted((r["doc_id"] or -1, r["class_id"], r["n_links"]) for r in nulls.transform(jaccard_classes).collect()) == [(-1, None, 0), (-1, None, 0), (1, 1, 0)]
    odd = frame(spark, [(1, "a b c d e f"), (2, "a b c d e f")]).toDF("doc_id", "text", "cluster", "set_id", "label").selectExpr("*", "doc_id as p", "doc_id as node", "1 as copies")
    assert [r["class_id"] for r in jaccard_classes(odd).collect()] == [1, 1]
    kept = without_near_copies(odd)
    assert kept.columns == odd.columns and [r["doc_id"] for r in kept.collect()] == [1]
    assert without_near_copies(nulls).count() == 3
    assert without_near_copies(frame(spark, [(1, "a b c"), (1, "a b c"), (2, "x y z")])).count() == 2


def test_texts_under_one_id_go_by_their_own_class(spark):
    rng = random.Random(24)
    texts = [text(rng, 40) for _ in range(5)]
    rows = [(1, texts[0]), (2, texts[0]), (2, texts[1]), (3, texts[2]), (3, texts[3]), (3, texts[3].upper()), (4, texts[4]), (5, changed(rng, texts[3], 1)), (6, "..."), (6, "!"), (6, "!")]
    docs = frame(spark, rows).selectExpr("*", "1 as __row", "2 as row", "3 as sets", "4 as several", "5 as of")
    assert without_near_copies(docs).columns == docs.columns
    kept = [(r["doc_id"], r["text"].lower()) for r in without_near_copies(docs).collect()]
    assert sorted(kept) == sorted([(1, texts[0]), (2, texts[1]), (3, texts[2]), (3, texts[3]), (4, texts[4]), (6, "..."), (6, "!")])


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(1000, 1100)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    want = {n: find(n) for e in edges if e[0] != e[1] for n in e}
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame([*edges, (None, 3), (5, None)], "a long, b long")).collect()}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_winnow_covers_every_window():
    x = np.random.default_rng(1).integers(0, 2**63, 500).astype(np.uint64)
    at = winnow(x, 16)
    assert np.diff(at).max() <= 16 and at[0] < 16 and at[-1] >= 500 - 16
    assert len(winnow(x[:3], 16)) == 1 and len(winnow(x[:0], 16)) == 0


def test_fuzzy_copies_share_seeds():
    rng = np.random.default_rng(22)
    shared = 0
    for _ in range(2000):
        a = rng.integers(1 << 63, size=60).astype(np.uint64)
        b = a.copy()
        b[rng.choice(60, 12, replace=False)] += np.uint64(1)
        one, two = ngrams(a, 5), ngrams(b, 5)
        shared += bool(set(one[winnow(one)].tolist()) & set(two[winnow(two)].tolist()))
    assert shared > 0.85 * 2000


def test_chaining_and_alignment():
    tree = Fenwick(8)
    for i, v in [(3, 5.0), (1, 7.0), (6, 9.0)]:
        tree.put(i, v, i)
    assert tree.get(1) == (-1e18, -1) and tree.get(3) == (7.0, 1) and tree.get(8) == (9.0, 6)
    x, y = np.array([0, 10, 22, 30, 31]), np.array([100, 110, 120, 5, 128])
    parts = segments(x, y)
    got = sorted(map(len, chains(parts)))
    assert sum(got) == len(parts) and got[-1] >= 2
    stays, lonely = edits(np.array([1, 2, 3, 4]), np.array([1, 9, 9, 3, 4]))
    assert stays.tolist() == [True, False, True, True] and lonely == 1


def passages_of(spark, rows):
    return repeated_passages(frame(spark, rows)).collect()


@pytest.mark.parametrize("seed", [3, 4])
def test_exact_passages_are_all_found(spark, seed):
    rng = random.Random(seed)
    shared = [text(rng, n, 10**6) for n in (50, 60, 90, 200, 49)]
    rows, clean = [], set()
    for i in range(60):
        own = text(rng, rng.randint(10, 300), 10**6)
        if i % 3 == 0:
            clean.add(i)
        else:
            own = f"{own} {shared[i % 5]}. {text(rng, rng.randint(0, 100), 10**6)}"
        rows.append((i, own))
    rows += [(900, None), (901, ""), (902, "short"), (903, text(rng, 20_000, 10**6))]
    words = {i: re.findall(rb"[A-Za-z0-9_\x80-\xff]+", (t or "").encode().lower()) for i, t in rows}
    found = passages_of(spark, rows)
    assert not {r["doc_id"] for r in found} & clean and not {r["other_doc_id"] for r in found} & clean
    seen = {}
    for i in sorted(words):
        for k in range(len(words[i]) - 49):
            g = tuple(words[i][k : k + 50])
            if seen.setdefault(g, i) != i:
                assert any(r["doc_id"] == i and r["start_word"] <= k and r["end_word"] >= k + 50 for r in found)
    for r in found:
        a, b = words[r["doc_id"]][r["start_word"] : r["end_word"]], words[r["other_doc_id"]][r["other_start_word"] : r["other_end_word"]]
        assert a == b and r["equal_words"] == len(a) >= 50 and r["other_doc_id"] < r["doc_id"]


def test_exact_passages_of_stock_sentences(spark):
    """All seeds of a passage are owned by documents that hold a part of it only."""
    rng = random.Random(21)
    rows = []
    for i in range(0, 250, 5):
        one, two = text(rng, 30, 10**6), text(rng, 30, 10**6)
        rows += [(i + k, f"{text(rng, 20, 10**6)} {t} {text(rng, 20, 10**6)}") for k, t in enumerate((one, two, one, f"{one} {two}", f"{one} {two}"))]
    found = {(r["doc_id"], r["other_doc_id"], r["start_word"], r["end_word"], r["other_start_word"], r["equal_words"]) for r in passages_of(spark, rows)}
    assert found == {(i + 4, i + 3, 20, 80, 20, 60) for i in range(0, 250, 5)}


def test_fuzzy_passages(spark):
    rng = random.Random(8)
    rows = []
    for i in range(20):
        p = text(rng, 120, 10**6)
        words = p.split()
        for at in (17, 45, 46, 80, 100):
            words[at] = f"changed{i}{at}"
        del words[60]
        rows += [(2 * i, f"{text(rng, 40, 10**6)} {p}"), (2 * i + 1, f"{' '.join(words)} {text(rng, 60, 10**6)}")]
    found = {(r["doc_id"], r["other_doc_id"]): r for r in passages_of(spark, rows)}
    assert {(2 * i + 1, 2 * i) for i in range(20)} == set(found)
    assert all(r["end_word"] - r["start_word"] > 90 for r in found.values())


def test_fuzzy_passages_of_one_seed_and_edited_tails(spark):
    rng = random.Random(23)
    rows, one, tails = [], set(), set()
    for i in range(0, 120, 2):
        p = text(rng, 65, 10**6).split()
        q = [f"changed{i}n{k}" if k % 5 == 4 and (k > 25 if i < 40 else k != 34) else w for k, w in enumerate(p)]
        docs = [f"{text(rng, 40, 10**6)} {' '.join(w)} {text(rng, 40, 10**6)}" for w in (p, q)]
        grams = [ngrams(Words([t.encode()]).hashes, 5) for t in docs]
        seeds = [set(g[winnow(g)].tolist()) for g in grams]
        if seeds[0] & seeds[1]:
            (tails if i < 40 else one).add(i)
        rows += [(i + k, t) for k, t in enumerate(docs)]
    assert len(tails) == 20 and len(one) > 5
    found = {r["other_doc_id"]: r for r in passages_of(spark, rows)}
    assert set(found) == one | tails and all(r["doc_id"] == i + 1 for i, r in found.items())
    assert all((found[i]["start_word"], found[i]["end_word"], found[i]["equal_words"]) == (40, 104, 57) for i in tails)
    assert all((found[i]["start_word"], found[i]["end_word"], found[i]["equal_words"]) == (40, 104, 53) for i in one)


def test_removal(spark):
    rng = random.Random(9)
    p = text(rng, 70, 10**6)
    rows = [(1, f"Alpha {p} omega."), (2, f"Béta: {p} Ωmega!"), (3, p), (4, None), (5, ""), (6, "...")]
    docs = frame(spark, rows).selectExpr("*", "doc_id as start_word", "'x' as __other")
    out = {r["doc_id"]: r for r in without_repeats(docs).collect()}
    assert without_repeats(docs).columns == docs.columns
    assert sorted(out) == [1, 2, 4, 5, 6] and out[1]["text"] == rows[0][1] and out[4]["text"] is None
    assert out[2]["text"].split() == ["Béta:", "Ωmega!"] and out[2]["n_chars"] == len(out[2]["text"])
    assert repeated_passages(frame(spark, [])).count() == 0 and without_repeats(frame(spark, [])).count() == 0
    twice = frame(spark, [(1, p), (1, p), (None, p)])
    assert repeated_passages(twice).count() == 0


def test_texts_of_one_id_lose_their_own_passages(spark):
    rng = random.Random(26)
    a, c = text(rng, 100, 10**6), text(rng, 100, 10**6)
    docs = frame(spark, [(1, a), (2, f"{a} {text(rng, 5)}"), (2, c), (2, c), (3, f"{c} end")]).selectExpr("*", "1 as __spans", "2 as spans", "3 as of")
    out = [(r["doc_id"], r["text"]) for r in without_repeats(docs).collect()]
    assert without_repeats(docs).columns == docs.columns
    assert [t for i, t in out if i == 1] == [a] and sorted(len(t.split()) for i, t in out if i == 2) == [5, 100, 100]
    assert [t.split() for i, t in out if i == 3] == [["end"]]


def test_pieces_of_several_origins(spark):
    """Two pieces of 45 words, first seen in two documents, then together in two others."""
    rng = random.Random(27)
    rows = []
    for i in range(0, 240, 4):
        one, two = text(rng, 45, 10**6), text(rng, 45, 10**6)
        rows += [(i + k, f"{text(rng, 20, 10**6)} {t} {text(rng, 20, 10**6)}") for k, t in enumerate((one, two, f"{one} {two}", f"{one} {two}"))]
    found = {(r["doc_id"], r["other_doc_id"], r["start_word"], r["end_word"]) for r in passages_of(spark, rows)}
    assert {(i + 3, i + 2, 20, 110) for i in range(0, 240, 4)} <= found


def locally(rows, buckets=3, at_a_time=40):
    """The operator's steps without Spark; ``at_a_time`` rows to a task."""
    docs = pa.table({"doc_id": pa.array([i for i, _ in rows], pa.int64()), "text": pa.array([t for _, t in rows], pa.string())})

    def table(batches, schema=None):
        batches = list(batches)
        return pa.Table.from_batches(batches, None if batches else schema)

    def run(step, t, *keys, schema=s._DEALT):
        return table(step(iter(t.sort_by([(k, "ascending") for k in keys]).to_batches())), schema)

    def matches(dealt):
        return run(s._first_places(buckets), dealt, "bucket", "matched")

    found = run(s._chained, matches(pa.concat_tables([table(s._seeds(buckets)(iter(docs.slice(k, at_a_time).to_batches()))) for k in range(0, len(docs), at_a_time)])), "bucket")
    asked = {}
    for r in found.to_pylist():
        if r["chains"] is None:
            asked.setdefault(r["doc_id"], []).append(r)
    docs = docs.append_column("asked", pa.array([asked.get(i, []) for i in docs["doc_id"].to_pylist()], pa.list_(pa.struct(list(s._ASKED)))))
    chained = found.filter(found["chains"].is_valid())
    both = pa.concat_tables([chained.append_column("words", pa.nulls(len(chained), pa.binary())), table(s._slices(iter(docs.to_batches())))])
    aligned = run(s._aligned(buckets), both, "bucket")
    grams = aligned.filter(aligned["bucket"].is_valid()).select(["bucket", "matched", "blob"])
    exact = run(s._exact, matches(grams), "bucket")
    return aligned.filter(aligned["bucket"].is_null()).to_pylist() + exact.to_pylist()


@pytest.mark.parametrize("hot", [2, 3, 10, 10**6])
def test_hot_seeds_lose_no_passage(monkeypatch, hot):
    monkeypatch.setattr(s, "HOT", hot)
    rng = random.Random(28)
    one, two, three = (text(rng, n, 10**6) for n in (30, 30, 70))
    kinds = [one, two, f"{one} {two}", three, f"{one} {three}", ""]
    rows = [(i, f"{text(rng, rng.randint(5, 60), 10**6)} {rng.choice(kinds)} {text(rng, 20, 10**6)}") for i in range(150)]
    words = {i: t.split() for i, t in rows}
    found, seen = locally(rows), {}
    for i in sorted(words):
        for k in range(len(words[i]) - 49):
            g = tuple(words[i][k : k + 50])
            if seen.setdefault(g, i) != i:
                assert any(r["doc_id"] == i and r["start_word"] <= k and r["end_word"] >= k + 50 for r in found)
    for r in found:
        assert words[r["doc_id"]][r["start_word"] : r["end_word"]] == words[r["other_doc_id"]][r["other_start_word"] : r["other_end_word"]] and r["other_doc_id"] < r["doc_id"]


def test_seeds_of_many_texts_are_those_of_each():
    rng = random.Random(29)
    texts = [text(rng, n).encode() for n in (0, 1, 4, 5, 6, 16, 17, 40, 300, 3, 90)]
    seeds, of, place = s.seeds_of(Words(texts))
    for i, t in enumerate(texts):
        h = Words([t]).hashes
        grams = ngrams(h, 5) if len(h) >= 5 else h[:0]
        at = [k for k in range(len(grams)) if any(min(grams[j : j + 12]) == grams[k] for j in range(max(0, k - 11), max(1, min(k + 1, len(grams) - 11))))]
        assert place[of == i].tolist() == at and seeds[of == i].tolist() == grams[at].tolist()


def test_fingerprints(spark):
    rng = random.Random(10)
    rows = [(i, "\n".join(text(rng, rng.randint(1, 40)) for _ in range(rng.randint(1, 30)))) for i in range(40)]
    rows += [(50, None), (51, ""), (52, "x"), (53, "é" * 5001), (20, rows[20][1]), (54, text(rng, 15_000)), (55, rows[3][1])]
    docs = frame(spark, rows).selectExpr("doc_id", "text", "doc_id as part", "n_chars", "true as ahead")
    got = fingerprints(docs).collect()
    order = sorted(rows, key=lambda r: (r[0], r[1] or ""))
    want = {}
    for k, (i, t) in enumerate(order):
        t, f = t or "", order[(k + 1) % len(order)][1] or ""
        want.setdefault(i, []).append((len(t), sha256(edited(t, f).encode()).hexdigest(), t, edited(t, f), f))
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_chars"], r["edited_sha256"]) in [w[:2] for w in want[r["doc_id"]]]
    by_text = {}
    for r in got:
        _, _, t, e, f = next(w for w in want[r["doc_id"]] if w[1] == r["edited_sha256"])
        assert by_text.setdefault(t, r["fingerprint"]) == r["fingerprint"] and by_text.setdefault(e, r["edited_fingerprint"]) == r["edited_fingerprint"]
        digests, offsets = paragraphs([t, e, f])
        sets = [set(digests[a:b].tolist()) for a, b in zip(offsets[:-1], offsets[1:])]
        like = [len(sets[0] & s) / len(sets[0] | s) if sets[0] | s else 1.0 for s in sets[1:]]
        assert [r["near_edited"], r["near_next"]] == pytest.approx(like)
    assert len({v for v in by_text.values()}) > 60
    assert fingerprints(frame(spark, [])).count() == 0
    only = fingerprints(frame(spark, [(None, "only one")])).collect()
    assert len(only) == 1 and only[0]["near_next"] == 1.0


def test_parts_do_not_change_the_order(spark, monkeypatch):
    import tessella.llm.ordering as o

    rng = random.Random(11)
    rows = [(i * 7 % 501, text(rng, 12)) for i in range(300)] + [(None, "first"), (None, "before")]
    whole = sorted(map(tuple, fingerprints(frame(spark, rows)).collect()), key=str)
    monkeypatch.setattr(o, "PART_ROWS", 13)
    monkeypatch.setattr("tessella.llm.fingerprint.splitters", lambda ids: o.splitters(ids, 13))
    assert sorted(map(tuple, fingerprints(frame(spark, rows)).collect()), key=str) == whole


def test_tables_subtract_and_peel():
    rng = np.random.default_rng(4)
    a = rng.integers(0, 2**63, 300).astype(np.uint64)
    b = np.concatenate([a[20:], rng.integers(0, 2**63, 15).astype(np.uint64)])
    one, two = Sketches(1, 96).add(np.zeros(300, int), a), Sketches(1, 96).add(np.zeros(len(b), int), b)
    _, digests, sign, clear = one.minus(np.array([0]), two, np.array([0])).peel()
    assert clear.all() and set(digests[sign == 1].tolist()) == set(a[:20].tolist()) and set(digests[sign == -1].tolist()) == set(b[280:].tolist())
    only_a, only_b, cells = differences(np.concatenate([a, b]), np.array([0, 300, 300 + len(b)]), np.array([0]), np.array([1]))
    assert (only_a[0], only_b[0]) == (20, 15) and cells[0] > 12
    assert compare([1], [""], [""]).to_pylist()[0]["near_edited"] == 1.0
