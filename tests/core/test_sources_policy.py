import pytest
from lumagrain.functions import expressions as x
from lumagrain.functions import kernels
from lumagrain.policy import BALANCED, BROAD, CONSERVATIVE, MAX_LONG, AnalysisPolicy, BlurPolicy
from lumagrain.sources import media
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

ANDROID = "_id long, width int, height int, _size long, datetaken long, date_modified long, orientation int, is_favorite int, media_type int"
IOS = "localIdentifier string, width int, height int, createdSeconds double, modifiedSeconds double, isFavorite boolean, hasAdjustments boolean"


def test_android_rows(spark):
    rows = [(84, 4032, 3024, -1, 0, None, -90, None, 1), (85, 10, 10, 5, 7, 8, 450, 1, 1), (86, 0, 10, 5, 7, 8, 0, 0, 1), (87, 10, 10, 5, 7, 8, 0, 0, 3)]
    got = {r["asset_id"]: r for r in media.enumerate_android(spark.createDataFrame(rows, ANDROID)).collect()}
    assert set(got) == {"android-media:84", "android-media:85"}
    assert got["android-media:84"]["content_signature"] == "android-v1|w=4032|h=3024|s=null|taken=null|modified=null|orientation=270|favorite=false"
    assert got["android-media:85"]["content_signature"] == "android-v1|w=10|h=10|s=5|taken=7|modified=8|orientation=90|favorite=true"


def test_android_order_and_access(spark):
    rows = [(i, 1, 1, 1, t, None, 0, 0, 1) for i, t in ((9, None), (7, 2000), (4, 2000), (1, 3000))]
    df = spark.createDataFrame(rows, ANDROID)
    assert [r["asset_id"][14:] for r in media.enumerate_android(df).collect()] == ["1", "4", "7", "9"]
    assert media.enumerate_android(df, "Denied").collect() == []
    with pytest.raises(PySparkException):
        media.enumerate_android(spark.createDataFrame([(None, 1, 1, 1, 1, 1, 0, 0, 1)], ANDROID)).collect()


def test_ios_rows(spark):
    rows = [("b", 2, 2, -5.0, 1.5, True, True), ("a", 2, 2, 1.2345, None, False, None), ("n", 2, 2, None, None, False, False), ("x", 0, 2, 1.0, 1.0, False, False)]
    got = media.enumerate_ios(spark.createDataFrame(rows, IOS)).collect()
    assert [r["asset_id"] for r in got] == ["ios-photo:a", "ios-photo:b", "ios-photo:n"] and {r["byte_count"] for r in got} == {None}
    assert got[1]["content_signature"] == "ios-v1|w=2|h=2|created=-5000|modified=1500|favorite=true|edited=true" and got[0]["captured_at_ms"] == 1235


def test_ids(spark):
    one = spark.range(1)
    row = one.select(media.android_asset_id(F.lit(7)), media.android_media_id(F.lit("android-media:7")), media.ios_asset_id(F.lit("q")), media.ios_identifier(F.lit("ios-photo:q"))).first()
    assert tuple(row) == ("android-media:7", 7, "ios-photo:q", "q")
    for bad in (media.android_asset_id(F.lit(-1)), media.android_media_id(F.lit("ios-photo:7")), media.ios_identifier(F.lit("q")), media.ios_asset_id(F.lit(" "))):
        with pytest.raises(PySparkException):
            one.select(bad).collect()


def test_originals_are_read_for_wanted_assets(spark, tmp_path):
    for n in "abc":
        (tmp_path / f"{n}.jpg").write_bytes(n.encode() * 3)
    wanted = spark.createDataFrame([("b",), ("zz",)], "asset_id string")
    assert [(r[0], bytes(r[1])) for r in media.original_bytes(spark, str(tmp_path), wanted).collect()] == [("b", b"bbb")]
    assert media.original_bytes(spark, str(tmp_path)).count() == 3
    assert {r[0]: r[1] is None for r in media.original_bytes(spark, str(tmp_path), most=2).collect()} == {r[0]: len(r[1]) > 2 for r in media.original_bytes(spark, str(tmp_path)).collect()}


def test_resources_and_access(spark):
    rows = [("a", "Photo", b"1"), ("a", "FullSizePhoto", b"2"), ("b", "Photo", b"3"), ("c", "Video", b"4")]
    got = {r[0]: bytes(r[1]) for r in media.preferred_resource(spark.createDataFrame(rows, "asset_id string, resource_type string, content binary")).collect()}
    assert got == {"a": b"2", "b": b"3"}
    df = spark.createDataFrame([(True, False, False), (False, True, False), (False, False, True), (False, False, False)], "f boolean, p boolean, d boolean")
    assert [r[0] for r in df.select(media.access_state(F.col("f"), F.col("p"), F.col("d"))).collect()] == ["Full", "Partial", "Denied", "NotDetermined"]


def test_luma(spark, tmp_path):
    assert tuple(spark.range(1).select(x.luma(F.lit(255), F.lit(0), F.lit(0)), x.luma(F.lit(255), F.lit(255), F.lit(255))).first()) == (77, 255)
    (tmp_path / "g.txt").write_text("\n".join(" ".join(str(c * 255 // 31) for c in range(32)) for _ in range(32)))
    frame = media.text_luma(spark, str(tmp_path / "g.txt"), "g", 32, 32)
    assert kernels.analyze_frames(frame).first()["perceptual_hash"] == -6196953087261802496
    image = spark.createDataFrame([("i", (1, 2, 3, bytearray([0, 0, 255, 255, 255, 255])))], "asset_id string, image struct<height:int,width:int,nChannels:int,data:binary>")
    assert bytes(media.image_luma(image).first()["pixels"]) == bytes([77, 255])


def test_decoded_size():
    assert kernels.decoded_size(4032, 3024) == (512, 384) and kernels.decoded_size(100, 50) == (100, 50) and kernels.decoded_size(5000, 1) == (512, 1)


def test_policies():
    assert (BALANCED.max_perceptual_distance, BALANCED.max_capture_gap_ms, BALANCED.max_aspect_ratio_delta) == (19, 180_000, 0.04)
    assert CONSERVATIVE.blur.laplacian_variance_ceiling == 5.223295514542475e-4 and BROAD.blur == BALANCED.blur == BlurPolicy(5.341212412216976e-4, 0.0)
    for bad in ({"max_perceptual_distance": 65}, {"max_capture_gap_ms": -1}, {"max_aspect_ratio_delta": float("nan")}, {"sensitivity": "x"}):
        with pytest.raises(ValueError):
            BALANCED.with_(**bad)
    with pytest.raises(ValueError):
        BlurPolicy(-1.0, 0.0)
    assert AnalysisPolicy("Broad", 64, MAX_LONG, 0.0, BlurPolicy(0.0, 0.0))


def test_expressions(spark):
    row = spark.range(1).select(
        x.blur_verdict(F.lit(0.1), F.lit(0.1), F.lit(0.01), BlurPolicy(0.1, 0.1)), x.blur_verdict(F.lit(0.1), F.lit(0.1), F.lit(0.009), BlurPolicy(0.1, 0.1)), x.blur_verdict(F.lit(0.10001), F.lit(0.1), F.lit(1.0), BlurPolicy(0.1, 0.1)),
        x.hamming(F.lit(-1).cast("long"), F.lit(0).cast("long")), x.ratio_or_one(F.lit(0), F.lit(0)), x.ratio_or_one(F.lit(1), F.lit(4)),
    ).first()
    assert tuple(row) == ("PossiblyBlurred", "Inconclusive", "Inconclusive", 64, 1.0, 0.25)
    df = spark.createDataFrame([(MAX_LONG,), (5,), (None,)], "v long")
    assert df.agg(x.saturating_sum(F.col("v"))).first()[0] == MAX_LONG and df.where("false").agg(x.saturating_sum(F.col("v"))).first()[0] == 0
