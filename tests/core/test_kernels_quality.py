import numpy as np
import pytest
from lumagrain.functions import kernels as k
from lumagrain.operators import quality
from lumagrain.policy import BALANCED, BROAD, CONSERVATIVE
from lumagrain.sources import synthetic


def gradient(w, h, m):
    return np.tile((np.arange(w) * m // (w - 1)).astype(np.uint8), (h, 1))


def test_hash_goldens():
    assert k.perceptual_hash(gradient(48, 37, 200)) == k.perceptual_hash(gradient(32, 32, 255)) == -6196953087261802496
    assert k.perceptual_hash(np.full((1, 1), 127, np.uint8)) < 0


def distance(a, b):
    return ((k.perceptual_hash(a) ^ k.perceptual_hash(b)) & (1 << 64) - 1).bit_count()


def test_hash_of_changed_frames():
    g = gradient(48, 37, 200)
    y, x = np.mgrid[0:32, 0:32]
    checker = np.where((x // 3 + y // 5) % 2 == 0, 0, 255).astype(np.uint8)
    assert distance(g, g + 20) <= 4 and distance(checker, gradient(32, 32, 255)) >= 20


def test_blur_bounds():
    y, x = np.mgrid[0:64, 0:64]
    grid = np.where((x // 8 + y // 8) % 2 == 0, 0, 255).astype(np.uint8)
    soft = synthetic.box_blur(grid, 4)
    assert k.blur_signals(grid)[0] > k.blur_signals(soft)[0] and k.blur_signals(np.zeros((2, 9), np.uint8)) == (0.0, 0.0, 0.0)
    assert k.blur_signals(np.full((600, 300), 7, np.uint8)) == pytest.approx((0.0, 0.0, 0.0))


def test_analysis_skips_bad_frames(spark):
    rows = [("a", 2, 2, bytearray(4)), ("b", 2, 2, bytearray(3)), ("c", 0, 0, None), ("d", 48, 37, bytearray(gradient(48, 37, 200).tobytes()))]
    got = {r["asset_id"]: r for r in k.analyze_frames(spark.createDataFrame(rows, "asset_id string, width int, height int, pixels binary")).collect()}
    assert [got[x]["skip_stage"] for x in "abcd"] == [None, "LumaDecode", "LumaDecode", None]
    assert got["d"]["perceptual_hash"] == -6196953087261802496
    assert k.analyze_frames(spark.createDataFrame([], "asset_id string, width int, height int, pixels binary")).collect() == []


@pytest.fixture(scope="module")
def corpus(spark):
    return synthetic.development_corpus(spark)


def test_corpus_sizes(corpus):
    assert (corpus["assets"].count(), corpus["exact"].count(), corpus["near"].count(), corpus["blur"].count(), corpus["hard_negative"].count()) == (71, 4, 24, 3, 3)
    assert len(synthetic.embargoed()[0]) == 8


def test_balanced_metrics(corpus):
    rows = quality.evaluate(corpus["assets"], corpus["exact"], corpus["near"], corpus["blur"], BALANCED).collect()
    got = {r["kind"]: (r["true_positive"], r["false_positive"], r["false_negative"]) for r in rows}
    assert got == {"exact": (4, 0, 0), "near": (24, 1, 0), "blur": (2, 0, 1)}


def test_search_finds_the_presets(spark, corpus):
    found = quality.select_policies(spark, corpus["assets"], corpus["exact"], corpus["near"], corpus["blur"])
    assert (found.conservative, found.balanced, found.broad) == (CONSERVATIVE, BALANCED, BROAD)


def test_hard_negatives_are_near_the_threshold(corpus):
    rows = {r["asset_id"]: r for r in corpus["assets"].collect()}
    for a, b in corpus["hard_negative"].collect():
        away = ((rows[a]["perceptual_hash"] ^ rows[b]["perceptual_hash"]) & (1 << 64) - 1).bit_count()
        assert 8 <= away <= 30


def test_frames_are_bounded_and_turned(spark):
    g = gradient(1024, 256, 255)
    rows = [("a", 1024, 256, bytearray(g.tobytes()), 90), ("b", 2, 1, bytearray([1, 2]), 180), ("c", 3, 3, bytearray(2), 0), ("d", None, 1, None, None)]
    got = {r["asset_id"]: r for r in k.bound_frames(spark.createDataFrame(rows, "asset_id string, width int, height int, pixels binary, orientation int")).collect()}
    assert (got["a"]["width"], got["a"]["height"]) == (128, 512) and bytes(got["b"]["pixels"]) == bytes([2, 1]) and len(got["c"]["pixels"]) == 2 and got["d"]["pixels"] is None


def test_near_grid_counts_cells(spark):
    """The grid's counts are those of every pair under every candidate, and pairs are not joined with the grid."""
    from rows import analysis, record

    r = np.random.default_rng(4)
    rows = [record(f"p{k:02d}", int(h), f"s{k % 30}", w=int(100 + k % 4), captured=None if k % 6 == 0 else int(t)) for k, (h, t) in enumerate(zip(r.integers(0, 1 << 22, 40), r.integers(0, 300_000, 40), strict=True))]
    assets = analysis(spark, rows)
    features = quality.pair_features(assets).collect()
    labels = {(f["first_id"], f["second_id"]) for k, f in enumerate(features) if k % 5 == 0}
    found = quality.near_grid(spark, assets, spark.createDataFrame([*labels, ("p00", "none"), ("p03", "p01")], "first_id string, second_id string"))
    got = {(x["max_distance"], x["max_gap_ms"], x["max_aspect"]): (x["true_positive"], x["false_positive"], x["false_negative"]) for x in found.collect()}
    assert len(got) == 504
    for (d, w, a), counts in got.items():
        hit = {(f["first_id"], f["second_id"]) for f in features if not f["same"] and f["distance"] <= d and (f["gap_ms"] is None or f["gap_ms"] <= w) and f["aspect_delta"] <= a}
        assert counts == (len(hit & labels), len(hit - labels), len(labels - hit))
    assert "CartesianProduct" not in found._jdf.queryExecution().executedPlan().toString()
    none = analysis(spark, [record("a", 0, "x"), record("b", -1, "y")])
    assert quality.near_grid(spark, none, spark.createDataFrame([], "first_id string, second_id string")).count() == 0
