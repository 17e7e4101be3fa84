import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
from fixtures_llm import frame, prose
from lumagrain.llm import fm_index, substring_dedup, suffix_dedup, winnow
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_bytes(texts, length):
    where = defaultdict(list)
    raw = [(t or "").encode() for t in texts]
    for d, t in enumerate(raw):
        for p in range(len(t) - length + 1):
            where[t[p : p + length]].append((d, p))
    gone = [bytearray(len(t)) for t in raw]
    for v in where.values():
        if len(v) > 1:
            for d, p in v:
                gone[d][p : p + length] = b"\x01" * length
    return [(len(t), sum(g), len(re.findall(b"\x01+", bytes(g))), bytes(x for x, y in zip(t, g, strict=True) if not y)) for t, g in zip(raw, gone, strict=True)]


def brute_words(texts, window, order=None):
    seen, out = set(), {}
    for d in order or range(len(texts)):
        w = WORD.findall(texts[d] or "")
        gone = set()
        for p in range(len(w) - window + 1):
            x = tuple(w[p : p + window])
            if x in seen:
                gone |= set(range(p, p + window))
            seen.add(x)
        out[d] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return [out[d] for d in range(len(texts))]


@pytest.fixture(scope="module")
def texts(odd_texts):
    base = prose(600, 77)
    near = [base[:k] + "#" + base[k + 1 :] for k in range(100, 3000, 171)]
    return [*odd_texts, base, *near, base, "z " * 700, "z " * 300, "abcdefgh" * 300, "é" * 900, prose(30, 8) * 20]


@pytest.mark.parametrize("shard,hot", [(1 << 22, 1 << 23), (3000, 1 << 23), (1 << 22, 1500)])
def test_bytes_equal_brute_force(spark, texts, shard, hot):
    docs = frame(spark, texts).withColumn("kept", F.lit(1)).repartition(5)
    rows = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffix_dedup.remove_repeats(docs, shard_bytes=shard, hot_bytes=hot).collect()}
    assert [rows[k] for k in range(len(texts))] == brute_bytes(texts, 400)


@pytest.mark.parametrize("shard,hot", [(1 << 22, 1 << 23), (3000, 1 << 23), (1 << 22, 500)])
def test_words_equal_brute_force(spark, texts, shard, hot):
    docs = frame(spark, texts).withColumn("n_words", F.lit("x")).repartition(5)
    rows = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substring_dedup.remove_passages(docs, shard_bytes=shard, hot_bytes=hot).collect()}
    assert [rows[k] for k in range(len(texts))] == brute_words(texts, 20)


def test_other_lengths(spark, texts):
    rows = {r["doc_id"]: bytes(r["kept"]) for r in suffix_dedup.remove_repeats(frame(spark, texts), length=50, gram=9).collect()}
    assert [rows[k] for k in range(len(texts))] == [x[3] for x in brute_bytes(texts, 50)]


def test_repeated_and_null_keys(spark):
    texts = [prose(100, 5)] * 3 + [prose(50, 6) + prose(100, 5)] + [None, ""]
    docs = frame(spark, texts, ids=[7, 7, None, 3, 3, None]).coalesce(1)
    words = substring_dedup.remove_passages(docs).collect()
    assert sorted(r["n_removed"] for r in words) == sorted(x[1] for x in brute_words(texts, 20, [2, 5, 3, 4, 0, 1]))
    got = suffix_dedup.remove_repeats(docs).collect()
    assert sorted(r["n_removed"] for r in got) == sorted(x[1] for x in brute_bytes(texts, 400))


def test_empty(spark):
    none = frame(spark, ["a"]).where("false")
    assert suffix_dedup.remove_repeats(none).collect() == [] and substring_dedup.remove_passages(none).collect() == []


def test_fm_index_counts():
    r = np.random.default_rng(3)
    parts = [r.integers(1, 6, k) for k in (40, 1, 0, 33, 40)]
    parts[4] = parts[0].copy()
    s, of = np.concatenate(parts).astype(np.int32), np.append(0, np.cumsum([len(p) for p in parts]))
    index = fm_index.FmIndex(s, of, 6)
    ends = np.concatenate([np.arange(of[k] + 3, of[k + 1] + 1) for k in range(5)]).astype(np.int64)
    length, lo, hi = index.matching_statistics(s, ends, 3)
    grams = [tuple(p[k : k + 3]) for p in parts for k in range(len(p) - 2)]
    for e, m, a, b in zip(ends, length, lo, hi, strict=True):
        n = grams.count(tuple(s[e - 3 : e]))
        assert (m == 3) == (n > 1) and (m < 3 or b - a == n)
        if m == 3:
            assert sorted(index.locate(np.arange(a, b)).tolist()) == [k for k in range(len(s) - 2) if any(of[j] <= k <= of[j + 1] - 3 for j in range(5)) and tuple(s[k : k + 3]) == tuple(s[e - 3 : e])]
    order = index.locate(np.arange(5, 5 + len(s)))
    assert sorted(order.tolist()) == list(range(len(s))) and len(index.samples) < len(s) / 4


def test_sliding_min():
    r = np.random.default_rng(4)
    for n in (0, 1, 5, 64, 101):
        h = r.integers(0, 1000, n).astype(np.uint64)
        for w in (1, 3, 7, 64):
            assert winnow.sliding_min(h, w).tolist() == [int(h[k : k + w].min()) for k in range(max(0, n - w + 1))]


def test_query_removes_passages_of_400_bytes_only(spark, tmp_path):
    long, short = ("long " * 20 + prose(90, 41, ("a", "bc", "def"))).ljust(400, "x")[:400], prose(90, 43, ("g", "hi", "jkl"))[:399]
    assert len(long) == 400 and len(short) == 399 and min(len(WORD.findall(x)) for x in (long, short)) > 50
    texts = [f"aé{long}b", f"c{long}d", f"e{short}f", f"g{short}h", prose(60, 42), None]
    frame(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.op5_suffix_dedup(spark, str(tmp_path)).collect()}
    assert [rows[k] for k in range(6)] == [(*x[:3], hashlib.sha256(x[3]).hexdigest()) for x in brute_bytes(texts, 400)]
    assert [rows[k][:2] for k in range(4)] == [(404, 400), (402, 400), (401, 0), (401, 0)]
