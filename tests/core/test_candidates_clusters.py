import random

import numpy as np
import pytest
from lumagrain.functions import expressions as x
from lumagrain.operators import candidates, clustering
from lumagrain.policy import BALANCED, MAX_LONG
from pyspark.sql import functions as F
from rows import OPEN, analysis, record


def distance(a, b):
    return ((a ^ b) & (1 << 64) - 1).bit_count()


def ids(df):
    return sorted((r["first_id"], r["second_id"]) for r in df.collect())


@pytest.mark.parametrize("mode", ["complete", "budgeted"])
def test_capture_window(spark, mode):
    rows = analysis(spark, [record("a", captured=0), record("b", captured=1001), record("c")])
    assert ids(candidates.find_pairs(rows, OPEN.with_(max_capture_gap_ms=1000), mode)[0]) == [("a", "c"), ("b", "c")]


@pytest.mark.parametrize("mode", ["complete", "budgeted"])
def test_aspect_and_largest_distance(spark, mode):
    wide = analysis(spark, [record("a"), record("b", w=200)])
    assert ids(candidates.find_pairs(wide, OPEN.with_(max_aspect_ratio_delta=0.1), mode)[0]) == []
    ends = analysis(spark, [record("a", -1), record("b", 0)])
    assert ids(candidates.find_pairs(ends, OPEN.with_(max_perceptual_distance=64), mode)[0]) == [("a", "b")]
    assert ids(candidates.find_pairs(ends, OPEN.with_(max_perceptual_distance=63), mode)[0]) == []


def test_extreme_times_do_not_overflow(spark):
    rows = analysis(spark, [record("a", captured=-MAX_LONG - 1), record("b", captured=MAX_LONG), record("c", captured=-MAX_LONG + 5)])
    for gap, want in ((10, [("a", "c")]), (MAX_LONG, [("a", "c")])):
        assert ids(candidates.find_pairs(rows, OPEN.with_(max_capture_gap_ms=gap), "budgeted")[0]) == want


@pytest.mark.parametrize("d", [0, 1, 5, 19, 40, 63])
def test_no_pair_is_lost(spark, d):
    r = random.Random(d)
    base = r.getrandbits(64)
    hashes = [base]
    for _ in range(25):
        h = base
        for bit in r.sample(range(64), r.randrange(0, min(64, d + 4))):
            h ^= 1 << bit
        hashes.append(h)
    signed = [h - (1 << 64) if h >> 63 else h for h in hashes]
    rows = analysis(spark, [record(f"p{k:02d}", h, captured=None if k % 5 == 0 else k * 10) for k, h in enumerate(signed)])
    policy = OPEN.with_(max_perceptual_distance=d, max_capture_gap_ms=100)
    want = [(f"p{i:02d}", f"p{j:02d}") for i in range(26) for j in range(i + 1, 26) if distance(signed[i], signed[j]) <= d and (i % 5 == 0 or j % 5 == 0 or (j - i) * 10 <= 100)]
    assert ids(candidates.complete_pairs(rows, policy)) == ids(candidates.budgeted_pairs(rows, policy)[0]) == sorted(want)


def test_budget_is_kept_and_told(spark):
    many = analysis(spark, [record(f"a{k:05d}") for k in range(2000)])
    pairs, coverage = candidates.budgeted_pairs(many, OPEN)
    assert pairs.count() == 100_000 and tuple(coverage.first()) == ("PairLimitReached", 100_000)
    assert pairs.agg(F.max("first_id")).first()[0] == "a00050"
    pairs, coverage = candidates.budgeted_pairs(analysis(spark, [record(f"a{k}") for k in range(10)]), OPEN)
    assert pairs.count() == 45 and tuple(coverage.first()) == ("Complete", 45)


def test_budget_order_over_bands(spark):
    r = random.Random(3)
    hashes = [r.getrandbits(64) - (1 << 63) for _ in range(60)]
    rows = analysis(spark, [record(f"a{k:02d}", h) for k, h in enumerate(hashes)])
    policy = OPEN.with_(max_perceptual_distance=19)
    seen, order = set(), []
    for start, bits in x.band_layout(19):
        groups = {}
        for k, h in enumerate(hashes):
            groups.setdefault((h >> start) & (1 << bits) - 1, []).append(k)
        for _, m in sorted(groups.items()):
            for a in range(len(m)):
                for b in range(a + 1, len(m)):
                    if (m[a], m[b]) not in seen:
                        seen.add((m[a], m[b]))
                        order.append((m[a], m[b]))
    for most in (10, 300, 1200):
        pairs, coverage = candidates.budgeted_pairs(rows, policy, most)
        want = [(f"a{a:02d}", f"a{b:02d}") for a, b in order[:most] if distance(hashes[a], hashes[b]) <= 19]
        assert ids(pairs) == sorted(want) and tuple(coverage.first()) == ("PairLimitReached" if len(order) > most else "Complete", min(most, len(order)))


def clusters(spark, hashes, d):
    rows = analysis(spark, [record(k, h) for k, h in hashes.items()])
    found = clustering.cluster(rows, candidates.complete_pairs(rows, OPEN.with_(max_perceptual_distance=d)))
    out = {}
    for r in found.collect():
        out.setdefault(r["cluster_id"], []).append(r["asset_id"])
    return {k: sorted(v) for k, v in out.items()}


def test_cluster_goldens(spark):
    assert clusters(spark, {"a": 0, "b": 1, "c": 3}, 1) == {"a": ["a", "b"], "c": ["c"]}
    assert clusters(spark, {"a": 0, "b": 1, "c": 2}, 1) == {"a": ["a", "b"], "c": ["c"]}
    assert clusters(spark, {"a": 3, "b": 5, "c": 57, "d": 9}, 2) == {"a": ["a", "b"], "c": ["c", "d"]}
    assert clusters(spark, {"a": 0}, 1) == {"a": ["a"]}


def plain_linkage(n, distance, linked):
    live = [[k] for k in range(n)]
    while True:
        best = None
        for i, a in enumerate(live):
            for j in range(i + 1, len(live)):
                b = live[j]
                if all(linked[x][y] for x in a for y in b):
                    key = (max(distance[x][y] for x in a for y in b), a[0], b[0])
                    if best is None or key < best[0]:
                        best = key, i, j
        if best is None:
            return sorted(sorted(c) for c in live)
        _, i, j = best
        merged = sorted(live[i] + live[j])
        live = [c for k, c in enumerate(live) if k not in (i, j)] + [merged]


def test_linkage_equals_brute_force():
    for seed in range(25):
        r = np.random.default_rng(seed)
        n = int(r.integers(2, 14))
        h = r.integers(0, 64, n)
        d = np.array([[bin(a ^ b).count("1") for b in h] for a in h])
        ok = d <= 2
        got = sorted(sorted(c) for c in clustering.complete_linkage([str(k) for k in range(n)], d, ok.copy()))
        assert got == plain_linkage(n, d, ok)
        keep = np.triu(r.random((n, n)) < 0.7)
        ok &= keep | keep.T
        assert sorted(sorted(c) for c in clustering.complete_linkage([str(k) for k in range(n)], d, ok.copy())) == plain_linkage(n, d, ok)


def test_large_components(spark):
    """Chains and dense groups of thousands; a chain merges at its ends first, in pairs."""
    chain = analysis(spark, [record(f"a{k:05d}", 0, captured=k * 10) for k in range(9000)])
    policy = OPEN.with_(max_capture_gap_ms=10)
    found = clustering.cluster(chain, candidates.complete_pairs(chain, policy)).groupBy("cluster_id").count()
    assert sorted(r["count"] for r in found.collect()) == [2] * 4500
    dense = analysis(spark, [record(f"b{k:04d}", captured=5) for k in range(700)])
    assert clustering.cluster(dense, candidates.complete_pairs(dense, policy)).select("cluster_id").distinct().count() == 1


def test_band_layout():
    for d in range(64):
        layout = x.band_layout(d)
        assert len(layout) == d + 1 and layout[0][0] == 0 and sum(n for _, n in layout) == 64
        assert all(a + n == b for (a, n), (b, _) in zip(layout, layout[1:]))
    assert x.band_layout(64) == [] and BALANCED.max_perceptual_distance == 19


@pytest.mark.parametrize("seed", [1])
def test_stages_equal_one_run(spark, monkeypatch, seed):
    """Links taken in stages, by one task or by components, give the merges of all links taken at once."""
    r = np.random.default_rng(seed)
    h = [int(x) for x in r.integers(0, 256, 90)]
    names = [f"p{k:03d}" for k in range(len(h))]
    d = np.array([[distance(a, b) for b in h] for a in h])
    want = {tuple(names[k] for k in c) for c in clustering.complete_linkage(names, d, d <= 4)}
    rows = analysis(spark, [record(n, x) for n, x in zip(names, h, strict=True)])
    pairs = candidates.complete_pairs(rows, OPEN.with_(max_perceptual_distance=4))
    for most in (1, 200, 1 << 20):
        monkeypatch.setattr(clustering, "LINKS_A_STAGE", most)
        got = {}
        for x in clustering.cluster(rows, pairs).orderBy("asset_id").collect():
            got.setdefault(x["cluster_id"], []).append(x["asset_id"])
        assert {tuple(c) for c in got.values()} == want, most


def test_no_record_is_compared_in_band_after_band(spark, monkeypatch):
    """Blocks of few records lose no pair and give none twice; records without a time meet all."""
    monkeypatch.setattr(candidates, "BLOCK", 16)
    r = random.Random(5)
    hashes = [r.getrandbits(64) - (1 << 63) for _ in range(100)]
    rows = analysis(spark, [record(f"a{k:02d}", h, w=100 + k % 3 * 40, captured=None if k % 2 else k * 10) for k, h in enumerate(hashes)])
    for policy in (OPEN.with_(max_perceptual_distance=28, max_capture_gap_ms=100, max_aspect_ratio_delta=0.3), OPEN.with_(max_perceptual_distance=28, max_aspect_ratio_delta=0.3)):
        gap = policy.max_capture_gap_ms
        shape = [100 / (100 + k % 3 * 40) for k in range(100)]
        want = [(f"a{i:02d}", f"a{j:02d}") for i in range(100) for j in range(i + 1, 100) if distance(hashes[i], hashes[j]) <= 28 and (i % 2 or j % 2 or (j - i) * 10 <= gap) and abs(shape[i] - shape[j]) <= 0.3]
        found = candidates.complete_pairs(rows, policy)
        assert ids(found) == sorted(want)
        assert "_cell" in found._jdf.queryExecution().analyzed().toString()
