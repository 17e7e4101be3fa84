import numpy as np
import pytest
from fixtures_llm import frame, prose
from test_decontamination import brute as contaminated
from test_near_dedup import brute as near_classes
from test_near_dedup import edited
from test_repeat_removal import brute_words

import corpus_pipeline as p


@pytest.fixture(scope="module")
def folder(spark, odd_texts, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    item = prose(30, 4000)
    texts = [*odd_texts, *(prose(60 + k % 90, 2000 + k) for k in range(120)), *(("%% ## " + prose(40, 3000 + k).replace("e", "|#")) for k in range(40))]
    texts += [edited(texts[40], 1, 1), texts[41], prose(40, 70) + " " + item, texts[42] + " " + " ".join(texts[43].split()[5:50])]
    frame(spark, texts).write.parquet(f"{at}/documents.parquet")
    first = len(odd_texts)
    labels = [(k, 1, 0) for k in range(first, first + 120, 2)] + [(k, 0, 0) for k in range(first + 120, first + 160, 2)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, texts, item


def test_stages_against_brute_force(spark, folder):
    at, texts, item = folder
    docs = spark.read.parquet(f"{at}/documents.parquet")
    one = p.stored(p.quality_classifier(spark, docs, at))
    kept = {r["doc_id"]: r for r in one.collect()}
    first = len(texts) - 164
    assert sum(k in kept for k in range(first, first + 120)) >= 114 and sum(k in kept for k in range(first + 120, first + 160)) <= 12
    two = p.stored(p.near_dedup(spark, one, at))
    ids = sorted(kept)
    roots = near_classes([kept[k]["text"] for k in ids])
    assert sorted(r["doc_id"] for r in two.collect()) == sorted({ids[r] for r in roots})
    left = sorted(r["doc_id"] for r in two.collect())
    three = p.stored(p.substring_dedup(spark, two, at))
    want = dict(zip(left, brute_words([kept[k]["text"] for k in left], 20), strict=True))
    got = {r["doc_id"]: r for r in three.collect()}
    for k in left:
        text = want[k][2] if want[k][1] else kept[k]["text"]
        assert got[k]["text"] == text and got[k]["lang"] == kept[k]["lang"]
        assert got[k]["n_chars"] == (None if text is None else len(text)) or not want[k][1]
    four = p.stored(p.benchmark_decontamination(spark, three, at))
    bad = contaminated([got[k]["text"] for k in left], [("1", item)])
    clean = [k for j, k in enumerate(left) if not bad[j][3]]
    assert sorted(r["doc_id"] for r in four.collect()) == clean and len(clean) < len(left)
    five = p.packing(spark, four, at).collect()
    assert {r["doc_id"] for r in five} == set(clean)
    assert sum(r["length"] for r in five) == sum({r["doc_id"]: r["doc_tokens"] for r in five}.values())


def test_run(spark, folder):
    rows = p.run(spark, folder[0])
    assert rows.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and rows.count() > 0


def test_stages_keep_the_columns(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    for name, stage in p.STAGES[:-1]:
        assert stage(spark, docs, folder[0]).dtypes == docs.dtypes, name
    assert [n for n, _ in p.STAGES] == ["quality classifier", "MinHash near-dedup", "substring dedup", "benchmark decontamination", "packing"] and np


def test_empty_documents(spark, folder, tmp_path):
    none = spark.read.parquet(f"{folder[0]}/documents.parquet").where("false")
    for _, stage in p.STAGES:
        none = stage(spark, none, folder[0])
    assert none.count() == 0
