import random

import numpy as np
import pyarrow as pa
import pytest
from fixtures_llm import frame, prose
from hypothesis import given, settings
from hypothesis import strategies as st
from lumagrain.llm import near_dedup
from pyspark.sql import functions as F


def labelled(text):
    w = (text or "").encode().translate(bytes(near_dedup.LOWER)).decode().replace("\x0b", " ").replace("\x0c", " ")
    w = [x for x in w.replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if x]
    g = [tuple(w[k : k + 5]) for k in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else []
    seen = {}
    out = []
    for x in g:
        seen[x] = seen.get(x, 0) + 1
        out.append((x, seen[x]))
    return out


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def brute(texts):
    s = [labelled(t) for t in texts]
    root = list(range(len(s)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(s)):
        for j in range(i):
            if s[i] and s[j] and len(set(s[i]) & set(s[j])) >= 0.8 * max(len(s[i]), len(s[j])) - 1:
                n = lcs(s[i], s[j])
                if n >= 0.8 * (len(s[i]) + len(s[j]) - n) - 1e-9:
                    a, b = sorted((find(i), find(j)))
                    root[b] = a
    return [find(k) for k in range(len(s))]


def edited(text, n, seed):
    r = random.Random(seed)
    w = text.split()
    for _ in range(n):
        k = r.randrange(len(w))
        w[k : k + 1] = r.choice([[], ["new"], [w[k], "more"]])
    return " ".join(w)


@pytest.fixture(scope="module")
def texts(odd_texts):
    base = [prose(150, 300 + k) for k in range(6)]
    passage = prose(60, 400)
    near = [edited(t, n, 10 * k + n) for k, t in enumerate(base) for n in (1, 1, 2, 5, 20)]
    shared = [passage + " " + prose(70, 500 + k) for k in range(40)]
    moved = " ".join(base[0].split()[75:] + base[0].split()[:75])
    return [*odd_texts, *base, *near, *shared, moved, base[0].upper(), "one two three", "One  two\nthree"]


@pytest.mark.parametrize("group", [512, 4])
def test_classes_equal_brute_force(spark, texts, group):
    docs = frame(spark, texts).withColumn("class_id", F.lit("x")).repartition(3)
    rows = {r["doc_id"]: (r["class_id"], r["is_first"]) for r in near_dedup.near_duplicates(docs, group=group).collect()}
    want = brute(texts)
    assert [rows[k][0] for k in range(len(texts))] == want
    assert [k for k in range(len(texts)) if rows[k][1]] == sorted(set(want))


def test_a_large_group_of_near_copies(spark):
    base = prose(200, 1)
    texts = [edited(base, 1, k) for k in range(300)]
    rows = near_dedup.near_duplicates(frame(spark, texts), group=16).collect()
    assert {r["class_id"] for r in rows} == {0} and sum(r["is_first"] for r in rows) == 1


def test_pairs_in_different_parts_of_a_large_group(spark):
    passage, texts = prose(124, 900), []
    for k in range(20):  # texts of one passage are not similar but for each pair, whose sketches are mostly the passage's
        own = prose(17, 1000 + k).split()
        texts += [passage + " " + " ".join(own), passage + " " + " ".join(own[:8]) + " " + prose(9, 2000 + k)]
    want = brute(texts)
    assert len(set(want)) == 20
    rows = near_dedup.near_duplicates(frame(spark, texts), group=4).collect()
    assert [r["class_id"] for r in sorted(rows, key=lambda r: r["doc_id"])] == want


def test_repeated_and_null_keys(spark):
    a = prose(50, 2)
    docs = frame(spark, [a, a, prose(50, 3), a, None, None], ids=[5, 5, 5, None, None, 8]).coalesce(1)
    rows = near_dedup.near_duplicates(docs).collect()
    assert sorted((str(r["doc_id"]), str(r["class_id"]), r["is_first"]) for r in rows) == [("5", "5", True), ("5", "None", False), ("5", "None", False), ("8", "8", True), ("None", "None", True), ("None", "None", True)]


def test_first_documents_keep_their_columns(spark, texts):
    docs = frame(spark, texts).withColumn("class_id", F.lit("mine"))
    kept = near_dedup.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(brute(texts)))


def test_empty(spark):
    assert near_dedup.without_near_duplicates(frame(spark, ["a"]).where("false")).collect() == []
    assert near_dedup.near_duplicates(frame(spark, ["a"]).where("false")).collect() == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 6), min_size=5, max_size=40), st.lists(st.integers(0, 6), min_size=5, max_size=40))
def test_alignment(a, b):
    h, at, _, _ = near_dedup.shingles(pa.array([" ".join(f"w{x}" for x in t) for t in (a, b)]))
    x, y = (labelled(" ".join(f"w{k}" for k in t)) for t in (a, b))
    n = lcs(x, y)
    assert near_dedup.aligned(h[: at[1]], h[at[1] :], len(x) + len(y)) == n
    assert near_dedup.similar(h[: at[1]], h[at[1] :]) == (n >= 0.8 * (len(x) + len(y) - n) - 1e-9)


def test_sketches_depend_on_order():
    words = [f"w{k}" for k in range(60)]
    h, at, _, _ = near_dedup.shingles(pa.array([" ".join(words), " ".join(words[30:] + words[:30])]))
    s = near_dedup.sketches(h, at)
    both = [sorted(set(h[at[k] : at[k + 1]].tolist())) for k in (0, 1)]
    assert len(set(both[0]) & set(both[1])) == 52 and 0 < np.sum(s[0] != s[1])

