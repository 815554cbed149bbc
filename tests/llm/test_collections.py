import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import components, knn, mixture, neardup, packing, tokens


def test_golay_keys():
    g = neardup.Golay()
    rng = np.random.default_rng(0)
    w = rng.integers(0, 1 << 23, 300)
    code = g.decode(w)
    keys, new = g.keys(w)
    assert set(new.sum(axis=1)) <= {1, 6}
    assert ((code[:, None] == keys) & new).any(axis=1).all()
    for a, b in itertools.combinations(range(23), 2):
        other, _ = g.keys(w[:20] ^ (1 << a) ^ (1 << b))
        assert all(set(x) & set(y) for x, y in zip(keys[:20].tolist(), other.tolist(), strict=True))


def _jaccard(a, b):
    s, t = ({tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in (a, b))
    return len(s & t) / len(s | t)


@pytest.fixture(scope="module")
def pages(spark):
    rng = np.random.default_rng(1)
    rows, words = [], {}
    for k in range(40):
        base = [f"w{x}" for x in rng.integers(0, 5000, 120)]
        for v in range(4):
            w = list(base)
            for _ in range(v * 4):
                w[int(rng.integers(len(w)))] = f"e{rng.integers(10**6)}"
            i = k * 10 + v
            words[i] = ["t", *w]
            rows.append((i, "T", " ".join(w), "x"))
        rows.append((k * 10 + 9, "t", " ".join(w).upper() + " !", "x"))
        words[k * 10 + 9] = words[k * 10 + 3]
    rows += [rows[0], (9000, None, "short text", "x"), (9001, None, None, "x"), (9002, "t", "", "x")]
    return spark.createDataFrame(rows, "page_id long, title string, text string, key string"), words


def test_near_duplicates(pages, spark):
    df, words = pages
    want = {(a, b) for a, b in itertools.combinations(sorted(words), 2) if a // 10 == b // 10 and _jaccard(words[a], words[b]) >= 0.6}
    n = neardup.NearDuplicates(df)
    rows = [tuple(r) for r in n.pairs().collect()]
    assert len(rows) == len(set(rows)) and set(rows) <= want and len(rows) >= 0.97 * len(want)
    groups = {r.page_id: r.group_id for r in n.groups().collect()}
    assert all(groups[a] == groups[b] for a, b in rows) and all(g == k // 10 * 10 for k, g in groups.items() if g % 10 == 0)
    assert neardup.NearDuplicates(df.limit(0)).pairs().count() == 0


def test_hot_keys_are_split(pages):
    df, _ = pages
    before = {tuple(r) for r in neardup.NearDuplicates(df).pairs().collect()}
    old = neardup.HOT_KEY, neardup.split_hot.__defaults__
    try:
        neardup.split_hot.__defaults__ = (2,)
        n = neardup.NearDuplicates(df)
        assert len({tuple(r) for r in n.pairs().collect()} & before) >= 0.97 * len(before)
    finally:
        neardup.split_hot.__defaults__ = old[1]


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30) if i != 14] + [(50, 40), (60, 60)], "a long, b long")
    got = {r.page_id: r.group_id for r in components.components(edges).collect()}
    assert got == {**{i: 0 for i in range(15)}, **{i: 15 for i in range(15, 31)}, 40: 40, 50: 40}


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(60, 64))
    x = np.concatenate([c + 0.25 * rng.normal(size=(10, 64)) for c in centers])
    rows = [(f"v{i:04d}", 1, r.tolist()) for i, r in enumerate(x)]
    rows += [("v0000", 0, [1.0] * 64), ("v0001", 1, x[1].tolist()), ("null", 1, None), ("zero", 1, [0.0] * 64), ("short", 1, [1.0]), (None, 1, [1.0] * 64), ("hole", 1, [None] + [1.0] * 63)]
    rows += [(f"c{i}", 1, (2 * x[5]).tolist()) for i in range(9)]
    df = spark.createDataFrame(rows, "id string, seq long, vector array<float>")
    got = {(r.id_a, r.id_b) for r in knn.similar_pairs(df).collect()}
    ids = [r[0] for r in rows[:600]] + [f"c{i}" for i in range(9)]
    m = np.concatenate([x, np.stack([x[5]] * 9)]).astype(np.float32).astype(float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    s = np.round(m @ m.T, 9)
    want = set()
    for i, a in enumerate(ids):
        order = sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-s[i, j], ids[j]))[:5]
        want |= {(min(a, ids[j]), max(a, ids[j])) for j in order if s[i, j] >= 0.85}
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(want)
    old = knn.BLOCK
    try:
        knn.BLOCK = 16
        assert len({(r.id_a, r.id_b) for r in knn.similar_pairs(df).collect()} & want) >= 0.97 * len(want)
    finally:
        knn.BLOCK = old
    asked = [i for i in range(len(ids)) if ids[i] < "v0020"]
    exact = {(r.id, r.rank): (r.other, r.cosine) for r in knn.exact_neighbours(df, F.col("id") < "v0020", block=16).collect()}
    assert len(exact) == 5 * len(asked)
    for i in asked:
        order = sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-s[i, j], ids[j]))[:5]
        assert [exact[ids[i], r][1] for r in range(1, 6)] == pytest.approx([s[i, j] for j in order], abs=1e-5)
    assert knn.neighbours(df.limit(0)).count() == 0 and knn.exact_neighbours(df, F.col("id") == "none").count() == 0


def test_completion_is_optimal():
    rng = np.random.default_rng(5)
    for _ in range(60):
        left = {int(s): int(n) for s, n in zip(rng.integers(1, 40, 6), rng.integers(1, 4, 6), strict=True)}
        room = int(rng.integers(1, 90))
        sums = {0}
        for s, n in left.items():
            sums = {t + k * s for t in sums for k in range(n + 1)}
        got = packing.completion(room, sorted(left, reverse=True), left)
        assert sum(s * n for s, n in got) == max(t for t in sums if t <= room) and all(n <= left[s] for s, n in got)


def test_packing(spark):
    rng = np.random.default_rng(6)
    docs = [(i, "a " * int(n)) for i, n in enumerate(rng.integers(1, 130, 400))] + [(1000, None), (1001, ""), (1002, "b " * 250), (1003, "b " * 200)]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, tokens int")
    specs = spark.createDataFrame([("s", 100), ("none", None), ("zero", 0)], "spec_id string, capacity_tokens int")
    p = packing.Packing(df, specs)
    rows = p.containers().collect()
    fill, pieces = {}, {}
    for r in rows:
        fill[r.container_id] = fill.get(r.container_id, 0) + r.tokens
        pieces.setdefault(r.doc_id, []).append((r.piece_no, r.tokens))
    assert max(fill.values()) <= 100 and set(pieces) == {d for d, _ in docs}
    sizes = {d: len((t or "").split()) for d, t in docs}
    assert all(sum(t for _, t in v) == sizes[d] and len(v) == max(1, -(-sizes[d] // 100)) for d, v in pieces.items())
    assert {r.doc_id for r in p.oversized().collect()} == {d for d, n in sizes.items() if n > 100}
    s = p.summary().first()
    assert s.n_containers <= s.least_containers + 1 and s.fullest <= 100
    assert packing.Packing(df.limit(0), specs).containers().count() == 0


def test_subset_sum_and_fit():
    rng = np.random.default_rng(7)
    for _ in range(60):
        counts = {int(s): int(n) for s, n in zip(rng.integers(1, 30, 5), rng.integers(1, 4, 5), strict=True)}
        budget = int(rng.integers(0, 120))
        got = mixture.subset_sum(counts, budget)
        sums = {0}
        for s, n in counts.items():
            sums = {t + k * s for t in sums for k in range(n + 1)}
        assert sum(s * n for s, n in got.items()) == max(t for t in sums if t <= budget) and all(n <= counts[s] for s, n in got.items())
        small = mixture.WINDOW
        try:
            mixture.WINDOW = 0
            got = mixture.fill(counts, budget)
        finally:
            mixture.WINDOW = small
        assert sum(s * n for s, n in got.items()) == max(t for t in sums if t <= budget) and all(n <= counts[s] for s, n in got.items())
    assert mixture.fit({10: 5}, 175, 8) == (3, {10: 2}) and mixture.fit({10: 5}, 175, 2) == (2, {}) and mixture.fit({}, 5, 2) == (0, {})


def test_mixture(spark):
    rng = np.random.default_rng(8)
    docs = [(i, "w " * int(rng.integers(1, 60)), ["A", " a", "b", "C", None][i % 5]) for i in range(500)] + [(900, None, "a")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("m", "a", 1.0, 2, 0.9), ("m", "b", 1.0, 8, 0.9), ("m", "gone", 1.0, 3, 0.9), ("m", "c", None, 1, 0.9), ("n", "C", 5.0, 1, 0.1)], "mix_id string, source string, target_weight double, max_repeats int, size_ratio double")
    mix = mixture.Mixture(df, targets)
    report = {(r.mix_id, r.source): r for r in mix.report().collect()}
    drawn = {}
    for r in mix.selection().collect():
        drawn[r.mix_id, r.source] = drawn.get((r.mix_id, r.source), 0) + r.n_tokens * r.copies
    assert report["m", "gone"].short and not report["m", "b"].short and ("m", "c") not in report
    for k, r in report.items():
        assert drawn.get(k, 0) == r.reached_tokens <= r.target_tokens
        assert r.short or r.target_tokens - r.reached_tokens < 2
    assert mixture.Mixture(df.limit(0), targets).report().where("reached_tokens > 0").count() == 0


def test_token_pattern_and_ranks(spark):
    assert tokens.WORD_PUNCT.findall("Añb_1, c... д!") == ["Añb_1", ",", "c", "...", "д", "!"]
    df = spark.range(300).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("g"), F.xxhash64("id").alias("h"))
    got = sorted((r.g, r.rank) for r in tokens.ranked(df, ["g"], "h").collect())
    assert got == [(g, i) for g in (0, 1) for i in range(150)]
