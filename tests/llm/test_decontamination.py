import hashlib
import re

import pytest
from fixtures_llm import frame, prose
from lumagrain.llm import decontamination as d
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return WORD.findall((text or "").translate(UPPER))


def brute(texts, items, window=13):
    out = {}
    cut = {i: [tuple(w[k : k + min(window, len(w))]) for k in range(len(w) - min(window, len(w)) + 1)] for i, t in items if (w := split(t))}
    for k, t in enumerate(texts):
        w, hit, found = split(t), set(), set()
        for i, windows in cut.items():
            for x in windows:
                for p in range(len(w) - len(x) + 1):
                    if tuple(w[p : p + len(x)]) == x:
                        hit |= set(range(p, p + len(x)))
                        found.add(i)
        out[k] = (len(w), len(hit), sorted(found), len(hit) > 0 and 20 * len(hit) >= len(w))
    return out


@pytest.fixture(scope="module")
def cases(odd_texts):
    lines = [" ".join(t.split()[3:40]) for t in odd_texts if t and len(t.split()) > 40]
    items = [("7", lines[0]), ("12", prose(40, 99)), ("9", "a b c"), ("x", None), ("y", " ! "), ("7", lines[0]), ("40", "w25 w26 w27"), ("41", " ".join(f"W{k}" for k in range(30, 50))), ("3", "word " * 15)]
    texts = [*odd_texts, prose(50, 5) + " " + prose(40, 99)[:150] + " end", "A, b! C?", prose(40, 99).upper()]
    return texts, items


def run(spark, texts, items, **more):
    bench = spark.createDataFrame(items, "item_id string, text string")
    docs = frame(spark, texts).withColumn("items", F.lit("mine"))
    return d.find_matches(docs, bench, **more)


def test_equals_brute_force(spark, cases):
    texts, items = cases
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"], r["n_hit"] > 0 and 20 * r["n_hit"] >= r["n_words"]) for r in run(spark, texts, items).collect()}
    assert got == brute(texts, items)


def test_blocks_agree(spark, cases, monkeypatch):
    texts, items = cases
    one = {r["doc_id"]: r.asDict(True) for r in run(spark, texts, items).collect()}
    real = d.blocks
    monkeypatch.setattr(d, "blocks", lambda *a: real(*a, most=200))
    assert {r["doc_id"]: r.asDict(True) for r in run(spark, texts, items).collect()} == one


def test_longest_match(spark):
    item = " ".join(f"k{j}" for j in range(30))
    text = "a b " + " ".join(f"k{j}" for j in range(2, 25)) + " z"
    row = run(spark, [text, "none here"], [("1", item)]).orderBy("doc_id").collect()
    assert (row[0]["longest"], row[0]["longest_item"], row[0]["longest_start"]) == (23, "1", 2)
    assert [tuple(s) for s in row[0]["spans"]] == [(2, 25)] and row[1]["longest"] is None


def test_removal_keeps_columns(spark, cases):
    texts, items = cases
    docs = frame(spark, texts).withColumn("items", F.lit("mine"))
    kept = d.decontaminate(docs, spark.createDataFrame(items, "item_id string, text string"))
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {k for k, v in brute(texts, items).items() if not v[3]}


def test_empty(spark):
    none = spark.createDataFrame([], "item_id string, text string")
    rows = d.find_matches(frame(spark, ["a b", None]), none).collect()
    assert [(r["n_words"], r["n_hit"], r["items"]) for r in rows] == [(2, 0, []), (0, 0, [])]
    assert d.find_matches(frame(spark, ["a"]).where("false"), none).collect() == []


def test_query_digest(spark, tmp_path):
    texts, items = ["x " + " ".join(f"q{j}" for j in range(20)), None], [(10, " ".join(f"q{j}" for j in range(20))), (9, " ".join(f"q{j}" for j in range(3, 18)))]
    frame(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    a, b = d.op1_decontamination(spark, str(tmp_path)).orderBy("doc_id").collect()
    assert (a["n_items"], a["items_sha256"], a["contaminated"]) == (2, hashlib.sha256(b"10,9").hexdigest(), True)
    assert (b["n_items"], b["items_sha256"], b["contaminated"]) == (0, hashlib.sha256(b"").hexdigest(), False)
