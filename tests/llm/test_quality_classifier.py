import numpy as np
import pytest
from fixtures_llm import frame, prose
from lumagrain.llm import quality_classifier as q
from pyspark.sql import functions as F

JUNK = ("zz%%", "###", "buy", "NOW!!", "$$$", "click", "ww|", "xx&")


@pytest.fixture(scope="module")
def corpus(spark):
    texts = [prose(60 + k % 90, k) if k % 5 else prose(40 + k % 70, k, JUNK) for k in range(300)]
    labels = [(k, int(k % 5 > 0), 0) for k in range(0, 300, 2)] + [(None, 1, 0), (9999, 0, None), (4, None, None)]
    return texts, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_documents_are_told_apart(spark, corpus):
    texts, labels = corpus
    docs = frame(spark, texts).withColumn("kept", F.lit(3))
    rows = {r["doc_id"]: r["kept"] for r in q.resample(docs, labels).collect()}
    wrong = [k for k in range(300) if rows[k] != (k % 5 > 0)]
    assert len(rows) == 300 and len(wrong) <= 6 and sum(k % 5 > 0 for k in wrong) <= 2


def test_weights_equal_brute_force(spark, corpus):
    texts, labels = corpus
    docs = frame(spark, [*texts[:40], None, "", " "])
    model = q.fit(docs, labels, buckets=97)
    target = {r[0] for r in labels.where("quality = 1 AND toxic = 0").collect()} - set(model.good.tolist())
    raw, good = np.ones(97), np.ones(97)
    for k, t in enumerate(texts[:40]):
        for b, _ in q.grams(__import__("pyarrow").array([t]), buckets=97):
            raw += np.bincount(b, minlength=97)
            if k in target:
                good += np.bincount(b, minlength=97)
    want = np.round(np.log(good / good.sum() / (raw / raw.sum())) * q.UNIT)
    assert np.abs(model.weights - want).max() <= 1
    rows = {r["doc_id"]: r for r in q.scored(docs, model).collect()}
    assert rows[40]["n_grams"] == rows[41]["n_grams"] == rows[42]["n_grams"] == 0 == rows[41]["log_ratio"]


@pytest.mark.parametrize("values", [[5, 5, 5, 1], list(range(-3000, 3000, 7)), [-(1 << 62), 1 << 61, 0, 3], [9]])
def test_kth_largest(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x long").repartition(3)
    ordered = sorted(values, reverse=True)
    for k in {1, 2, len(values) // 2, len(values)}:
        if 1 <= k <= len(values):
            v = ordered[k - 1]
            got = q.kth_largest(df, "x", k)
            assert got == (v, sum(x > v for x in values))
    assert q.kth_largest(df, "x", len(values) + 1) is None and q.kth_largest(df, "x", 0) is None


def test_keeps_exactly_k(spark, corpus):
    texts, labels = corpus
    rows = q.resample(frame(spark, texts), labels, keep=0.5).collect()
    assert sum(r["kept"] for r in rows) == 150
    noisy = sorted(((r["gumbel_key"], r["kept"]) for r in rows), reverse=True)
    assert [k for _, k in noisy] == [True] * 150 + [False] * 150


def test_equal_weights_are_sampled_by_noise(spark):
    n = 2000
    docs = frame(spark, ["a"] * n)
    rows = q.resample(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"), keep=0.25, seed=3).collect()
    assert sum(r["kept"] for r in rows) == n // 4 and {r["log_ratio"] for r in rows} == {0.0}


def test_inclusion_follows_the_weights(spark):
    """Over many seeds a text is among the top k as often as draws without replacement by weight take it."""
    words = [f"w{k}" for k in range(6)]
    texts = [words[k % 6] for k in range(60)]
    docs = frame(spark, texts).coalesce(1)
    model = q.Ratio(np.zeros(q.BUCKETS, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    logs = {w: 0.6 * k for k, w in enumerate(words)}
    for w, x in logs.items():
        (one, _), _ = q.grams(__import__("pyarrow").array([w]))
        model.weights[one[0]] = round(x * q.UNIT)
    k, seeds = 15, 60
    taken = np.zeros(60)
    for seed in range(seeds):
        rows = q.scored(docs, model, seed=seed).select("doc_id", "_noisy").toPandas()
        taken[rows.sort_values("_noisy")["doc_id"].to_numpy()[-k:]] += 1
    r = np.random.default_rng(0)
    p = np.exp([logs[t] for t in texts])
    want = np.zeros(60)
    for _ in range(4000):
        want[r.choice(60, k, replace=False, p=p / p.sum())] += 1
    got, want = (x.reshape(10, 6).sum(0) / n / 10 for x, n in ((taken, seeds), (want, 4000)))
    assert np.abs(got - want).max() < 0.06 and want[5] > 3 * want[0]


def test_noise_changes_the_kept_set(spark):
    """Near the cut the sample is not the plain top k."""
    rows = q.resample(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), keep=0.5).toPandas()
    weight = rows["log_ratio"] * np.minimum(rows["n_grams"], q.EFFECTIVE) / np.maximum(rows["n_grams"], 1)
    top = set(rows["doc_id"][weight.sort_values(kind="stable").index[-500:]])
    assert rows["kept"].sum() == 500 and 0 < len(top - set(rows["doc_id"][rows["kept"]])) < 150


def test_odd_rows(spark, corpus, odd_texts):
    _, labels = corpus
    docs = frame(spark, [*odd_texts, "same", "same"], ids=[*range(len(odd_texts)), None, None])
    rows = q.resample(docs, labels).collect()
    assert len(rows) == len(odd_texts) + 2 and all(r["kept"] is not None for r in rows)
    assert q.resample(docs.where("false"), labels).collect() == []
    none = q.resample(docs, labels.where("false")).collect()
    assert all(r["kept"] for r in none)


def test_cut():
    w, g = np.array([5, 1, 2, 2, 9, 0]), np.array([True, False, False, True, True, False])
    assert q.best_cut(w, g) in (2, 5) and q.best_cut(w, np.zeros(6, bool)) == np.iinfo(np.int64).min


def test_the_cut_does_not_defend_toxic_documents(spark):
    texts = [" ".join(f"{'vile' if k % 3 == 0 else 'fair'}{(k * 7 + j * j) % 40}" for j in range(200)) for k in range(240)]
    labels = spark.createDataFrame([(k, 1, int(k % 3 == 0)) for k in range(240)], "doc_id long, quality int, toxic int")
    kept = {r["doc_id"] for r in q.resample(frame(spark, texts), labels).where("kept").collect()}
    assert kept == {k for k in range(240) if k % 3}
