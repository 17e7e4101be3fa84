import re
from collections import Counter, defaultdict

import pytest
from fixtures_llm import frame, prose
from lumagrain.llm import quality_rules as q
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(t):
    t = t or ""
    w = WORD.findall(t)
    where = defaultdict(list)
    for k in range(len(w) - 7):
        where[tuple(w[k : k + 8])].append(k)
    covered = {x for v in where.values() if len(v) > 1 for k in v for x in range(k, k + 8)}
    lines = Counter(x for x in t.split("\n") if WORD.search(x))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), sum(lines.values()) - len(lines), len(covered)


def test_counts_equal_brute_force(spark, odd_texts):
    texts = [*odd_texts, "a b c d e f g h " * 3, "a b c d e f g h a b c d e f g h i", "a " * 9, "## $ <x> &|*%"]
    docs = frame(spark, texts).withColumn("n_words", F.lit("x")).withColumn("kept", F.lit(9))
    rows = {r["doc_id"]: r for r in q.judge(docs).collect()}
    for k, t in enumerate(texts):
        n = brute(t)
        assert tuple(rows[k][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == n, t
        assert rows[k]["base_failed"] == (n[0] < 20 or 100 * n[4] > 30 * n[0])
        assert rows[k]["kept"] == (not rows[k]["base_failed"] and rows[k]["rejected_by"] is None)


def test_order_never_changes_the_verdict(spark, odd_texts):
    docs = q.counted(frame(spark, [*odd_texts, *(prose(50, k) for k in range(20)), "THE END IS NEAR!! " * 9, "x# " * 30]))
    checks = q.rules()
    names = sorted(checks)
    one = {r["doc_id"]: r["r"] for r in q.cascade(docs, checks, names, "r").collect()}
    two = {r["doc_id"]: r["r"] for r in q.cascade(docs, checks, names[::-1], "r").collect()}
    assert {k for k, v in one.items() if v} == {k for k, v in two.items() if v} and one != two


def test_order_is_by_rejections_per_cost(spark):
    docs = q.counted(frame(spark, ["x# y# z# " * 20] * 50 + [prose(40, 1)] * 50))
    found = q.measured_order(docs, q.rules())
    assert {n for n, _, _ in found} == set(q.rules()) and dict((n, r) for n, r, _ in found)["symbols"] == pytest.approx(0.5)
    assert [r / s for _, r, s in found] == sorted((r / s for _, r, s in found), reverse=True)


def test_empty(spark):
    assert q.judge(frame(spark, ["a"]).where("false")).collect() == []
    assert q.cascade(frame(spark, ["a"]), {}, [], "r").first()["r"] is None
