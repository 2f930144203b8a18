"""Windows, chance correction and components on hand-made rows."""

from helioscope.operators import communities as C


def test_windows_of_short_markets(spark):
    times = spark.createDataFrame([(m, t, 7200.0) for m, n in ((1, 9), (2, 10), (3, 14), (4, 28)) for t in range(n)], "netuid int, t int, spacing_blocks double")
    got = sorted((r["netuid"], r["window"], r["a"], r["b"]) for r in C.windows(times, 14, 7).collect())
    assert got == [(2, 0, 0, 10), (3, 0, 0, 14), (4, 0, 0, 14), (4, 1, 7, 21), (4, 2, 14, 28)]


def test_components(spark):
    nodes = spark.createDataFrame([(1, x) for x in (5, 3, 9, 7, 8)] + [(2, 3)], "g int, uid int")
    edges = spark.createDataFrame([(1, 9, 5), (1, 5, 3), (1, 7, 8), (1, 8, 7), (1, 3, 4), (3, 1, 2)], "g int, a int, b int")
    got = {(r["g"], r["uid"]): r["root"] for r in C.components(nodes, edges, ["g"]).collect()}
    assert got == {(1, 5): 3, (1, 3): 3, (1, 9): 3, (1, 7): 7, (1, 8): 7, (2, 3): 3}
    assert C.components(nodes.filter("g = 9"), edges.filter("g = 9"), ["g"]).collect() == []


def test_chance_correction(spark):
    pairs = spark.createDataFrame([(1, 0, 1, 2, 0.9), (1, 1, 1, 2, 1.0), (1, 1, 1, 3, 1.0), (1, 2, 1, 2, 0.8), (1, 2, 1, 3, 0.2)], "netuid int, window int, a int, b int, x double")
    got = {(r["window"], r["b"]): round(r["x"], 9) for r in C.chance_corrected(pairs, "x").collect()}
    assert got == {(0, 2): 0.9, (1, 2): 0.0, (1, 3): 0.0, (2, 2): 0.6, (2, 3): 0.0}
    both = C.combined(pairs.withColumn("y", -pairs.x), {"x": 1.0, "y": 3.0, "z": 0.0}).filter("window = 0").first()
    assert round(both["similarity"], 9) == 0.225 and both["strong"] == 1
