import pytest
from lumagrain.operators import exact, findings, recommend
from lumagrain.policy import MAX_LONG
from lumagrain.schema import InvariantError
from pyspark.sql import functions as F
from rows import BLURRED, OPEN, SHARP, analysis, record

APART = OPEN.with_(max_perceptual_distance=0)


def groups(df):
    return {r["group_id"]: r for r in df.collect()}


def test_exact_hash_work(spark):
    rows = [record("a", bytes_=5), record("b", bytes_=5, sha="x"), record("c", bytes_=6), record("d", hash_=9, bytes_=5), record("e", w=50, bytes_=5)]
    assert [r[0] for r in exact.exact_hash_work(analysis(spark, rows)).collect()] == ["a"]
    unknown = [record("a", bytes_=5), record("b", bytes_=None), record("c", bytes_=6)]
    assert sorted(r[0] for r in exact.exact_hash_work(analysis(spark, unknown)).collect()) == ["a", "b", "c"]
    assert exact.exact_hash_work(analysis(spark, [record(f"a{k}", bytes_=k) for k in range(500)])).count() == 0


def test_contradictory_sizes_part(spark):
    rows = [record(f"{n}{k}", sha="x", bytes_=s) for n, s in (("p", 100), ("q", 200), ("u", None)) for k in range(2)]
    got = findings.exact_groups(analysis(spark, rows))
    assert sorted(r["asset_ids"] for r in got.collect()) == [["p0", "p1"], ["q0", "q1"], ["u0", "u1"]]
    mixed = [record("a", sha="x", bytes_=7), record("b", sha="x", bytes_=None), record("c", sha="x", bytes_=7, w=100, h=100)]
    assert [r["asset_ids"] for r in findings.exact_groups(analysis(spark, mixed)).collect()] == [["a", "b", "c"]]


def test_orientation_does_not_matter_and_hash_does(spark):
    rows = [record("a", sha="x", w=200, h=100), record("b", sha="x", w=100, h=200), record("c", hash_=1, sha="x", w=200, h=100)]
    assert [r["asset_ids"] for r in findings.exact_groups(analysis(spark, rows)).collect()] == [["a", "b"]]


def test_large_group(spark):
    got = findings.exact_groups(analysis(spark, [record(f"a{k:05d}", sha="x") for k in range(10_000)])).first()
    assert len(got["asset_ids"]) == 10_000 and len(got["selected"]) == 9_999 and got["estimated_bytes"] == 99_990 and got["keeper"] == "a00000"


def test_stable_ids_and_saturation(spark):
    rows = [record("exact-b", sha="x"), record("exact-a", sha="x"), record("near-b", hash_=1 << 20, captured=5), record("near-a", hash_=1 << 20, captured=5, w=101)]
    s = findings.assemble(analysis(spark, rows), APART)
    assert list(groups(s.exact_groups)) == ["exact:7:exact-a7:exact-b"] and list(groups(s.near_groups)) == ["near:6:near-a6:near-b"]
    rows = [record("a", sha="x", bytes_=None), record("b", sha="x", bytes_=None), record("c", sha="x", bytes_=MAX_LONG), record("d", hash_=3, sha="y", bytes_=9), record("e", hash_=3, sha="y", bytes_=9)]
    s = findings.assemble(analysis(spark, rows), APART)
    assert groups(s.exact_groups)["exact:1:a1:b1:c"]["selected"] == ["b", "c"] and s.summary.first()["estimated_bytes"] == MAX_LONG


def test_favourites(spark):
    rows = [record("a", sha="x", fav=True), record("b", sha="x", fav=True), record("c", sha="x")]
    got = findings.exact_groups(analysis(spark, rows)).first()
    assert (got["keeper"], got["reasons"], got["selected"]) == ("a", ["Favorite", "StableTieBreak"], ["c"])


@pytest.mark.parametrize(
    "rows,keeper,reasons",
    [
        ([record("a"), record("b", edited=True)], "b", ["Edited"]),
        ([record("a"), record("b", evidence=(2.0, 1.0, 1.0))], "b", ["Sharper"]),
        ([record("a"), record("b", evidence=(1.0, 2.0, 1.0))], "b", ["Sharper"]),
        ([record("a"), record("b", w=200)], "b", ["HigherResolution"]),
        ([record("b"), record("a")], "a", ["StableTieBreak"]),
        ([record("a", fav=True, evidence=(0.5, 0.5, 1.0)), record("b", evidence=(2.0, 1.0, 1.0), w=300)], "a", ["Favorite"]),
        ([record("a", fav=True, w=200), record("b", edited=True)], "a", ["Favorite", "HigherResolution"]),
        ([record("a")], "a", []),
    ],
)
def test_keeper_precedence(spark, rows, keeper, reasons):
    ranked = recommend.rank_keepers(analysis(spark, rows).withColumn("g", F.lit(1)), ["g"])
    got = recommend.keeper_reasons(ranked, ["g"]).first()
    assert (got["keeper"], got["reasons"]) == (keeper, reasons)


def test_fold_with_missing_evidence(spark):
    fields = "array<struct<asset_id:string,is_favorite:boolean,is_edited:boolean,laplacian_variance:double,edge_density:double,width:int,height:int>>"
    one = lambda i, lap=None, w=10: (i, False, False, lap, None if lap is None else 1.0, w, 10)
    cases = [([one("b", 1.0), one("a")], "a"), ([one("c", 2.0), one("b"), one("a", 1.0)], "a"), ([one("a", 1.0), one("b", float("nan"), 20)], "b"), ([one("x")], "x")]
    df = spark.createDataFrame([(k, m) for k, (m, _) in enumerate(cases)], f"k int, m {fields}")
    assert [r[0] for r in df.orderBy("k").select(recommend.fold_keeper(F.col("m"))).collect()] == [w for _, w in cases]


def test_snapshot(spark):
    rows = [record("e1", sha="x", evidence=BLURRED), record("e2", sha="x", evidence=BLURRED), record("n1", hash_=255, captured=1, evidence=BLURRED), record("n2", hash_=254, captured=2, bytes_=50), record("z", hash_=1 << 40, evidence=(0.01, 0.01, 0.0))]
    s = findings.assemble(analysis(spark, rows), OPEN.with_(max_perceptual_distance=1))
    assert list(groups(s.exact_groups)) == ["exact:2:e12:e2"] and list(groups(s.near_groups)) == ["near:2:n12:n2"]
    assert [tuple(r)[:2] for r in s.blur_items.collect()] == [("blur:2:n1", "n1")]
    total = s.summary.first()
    assert (total["exact_count"], total["near_count"], total["blur_count"], total["total_count"], total["estimated_bytes"], total["status"]) == (1, 1, 1, 3, 10, "Complete")
    assert groups(s.near_groups)["near:2:n12:n2"]["selected"] == [] and SHARP
    g, m = findings.finding_tables(s, "Balanced")
    assert g.count() == 2 and [(r["asset_id"], r["position"], r["is_keeper"], r["selected_for_removal"]) for r in m.where("group_id LIKE 'exact%'").orderBy("position").collect()] == [("e1", 0, True, False), ("e2", 1, False, True)]


def test_reaching_the_pair_limit_is_told(spark):
    rows = [record(f"a{k:03d}", hash_=k, captured=k * 1000) for k in range(448)]
    s = findings.assemble(analysis(spark, rows), OPEN.with_(max_perceptual_distance=64, max_capture_gap_ms=0), "budgeted")
    assert s.summary.first()["status"] == "PairLimitReached" and s.near_groups.count() == 0


def test_empty_and_repeated_ids(spark):
    s = findings.assemble(analysis(spark, []), OPEN)
    assert s.summary.first()["total_count"] == 0 and s.summary.first()["estimated_bytes"] == 0
    with pytest.raises(InvariantError):
        findings.assemble(analysis(spark, [record("a"), record("a")]), OPEN)


def test_utf16_ids(spark):
    rows = [record("a😀", sha="x"), record("b", sha="x")]
    assert findings.exact_groups(analysis(spark, rows)).first()["group_id"] == "exact:3:a😀1:b"
