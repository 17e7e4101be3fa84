"""Columns of the input whose names operators use inside, or add."""

import pytest
from fixtures_llm import frame, prose
from lumagrain.llm import decontamination, lm_scoring, near_dedup, packing, quality_classifier, quality_rules, substring_dedup, suffix_dedup, token_counts, url_filters
from pyspark.sql import functions as F

INSIDE = ["_rid", "_sub", "_spans", "_k", "_weight", "_noisy", "_tie", "_label", "_w", "class_rid", "least", "content", "start", "n", "key", "salt", "h"]


def operators(spark):
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 1)], "doc_id long, quality int, toxic int")
    return {
        "repeats": suffix_dedup.remove_repeats,
        "passages": substring_dedup.remove_passages,
        "near": near_dedup.near_duplicates,
        "resample": lambda d: quality_classifier.resample(d, labels),
        "judge": quality_rules.judge,
        "tokens": token_counts.count_tokens,
        "matches": lambda d: decontamination.find_matches(d, bench),
        "decontaminate": lambda d: decontamination.decontaminate(d, bench),
        "pack": packing.pack,
    }


@pytest.mark.parametrize("name", ["repeats", "passages", "near", "resample", "judge", "tokens", "matches", "decontaminate", "pack"])
def test_own_columns_come_back(spark, name):
    docs = frame(spark, [prose(40, 1), prose(40, 1), None, ""]).withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in INSIDE})
    out = operators(spark)[name](docs)
    rows = out.collect()
    if name == "pack":  # pieces, not documents
        assert {r["doc_id"] for r in rows} == {0, 1, 2, 3}
        return
    assert len(out.columns) == len(set(out.columns)) and len(rows) == 4
    for r in rows:
        assert all(r[c] == f"{c}{r['doc_id']}" for c in INSIDE)


def test_columns_beside_are_left_alone_where_an_operator_has_rows_of_its_own(spark):
    """Scores and verdicts, with columns of the names that the operators use inside or add."""
    names = ["_rid", "_sub", "h", "n", "ids", "part", "rare", "alone", "known", "score", "held_out"]
    docs = frame(spark, [prose(40, 1), None, ""]).withColumns({c: F.lit("x") for c in names})
    assert sorted(r["doc_id"] for r in lm_scoring.score_texts(docs).collect()) == [0, 1, 2]
    pages = spark.createDataFrame([(1, "http://a.com/en/1", '<a href="//b.info/">'), (2, "http://b.info/", None)], "page_id long, url string, html string")
    inside = ["_says", "_bad", "_h", "_rules", "src", "dst", "n", "received", "mass"]
    rows = url_filters.judge_urls(pages.withColumns({c: F.lit(c) for c in inside}), url_filters.RULES).collect()
    assert len(rows) == 2 and all(r[c] == c for r in rows for c in inside)


@pytest.mark.parametrize("name", ["repeats", "passages", "near", "resample"])
def test_keys_that_are_no_integers_are_refused(spark, name):
    docs = frame(spark, ["a"]).withColumn("doc_id", F.lit("x"))
    with pytest.raises(TypeError):
        operators(spark)[name](docs)
