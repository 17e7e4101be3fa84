from lumagrain.operators import graph


def test_components_of_chains(spark):
    links = [(k, k + 1) for k in range(0, 50)] + [(100, 101), (101, 100), (7, 7), (200, 150), (150, 190)]
    got = graph.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r["node"]: r["label"] for r in got} == {**{k: 0 for k in range(51)}, 100: 100, 101: 100, 200: 150, 150: 150, 190: 150}
    assert graph.components(spark.createDataFrame([(1, 1)], "a long, b long")).collect() == []
