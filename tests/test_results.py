"""The result catalogue against what was put into it, and signals on hand-made rows."""

import math

import pytest

from helioscope.operators import signals as G
from helioscope.operators.sequences import trailing_robust_z
from helioscope.sources.results import Results, markdown, report


@pytest.fixture(scope="module")
def results(spark):
    made = Results()
    made.add("checks", "issues", spark.createDataFrame([("Keys, \"quoted\"\nmissing", 2, 0.123456), (None, None, float("nan"))], "issue string, markets int, part double"), "Q1", "what is lacking")
    made.add("scoring", "summary", spark.createDataFrame([], "netuid int, agreement double"), "Q2", "means")
    return made


def test_names_and_search(spark, results):
    assert results["checks.issues"] is results["checks_issues"] and "scoring.summary" in results and "other" not in results
    assert results.analyses() == ["checks", "scoring"]
    assert [r["name"] for r in results.search(spark, "LACKING").collect()] == ["checks_issues"]
    assert [r["name"] for r in results.search(spark, "agreement").collect()] == ["scoring_summary"]


def test_round_trip(spark, results, tmp_path):
    results.save(spark, str(tmp_path))
    back = Results.load(spark, str(tmp_path))
    assert back.about == {n: (*about[:4],) for n, about in results.about.items()}
    for name, df in results.tables.items():
        assert back[name].schema.simpleString() == df.schema.simpleString()
    rows = sorted(back["checks_issues"].collect(), key=lambda r: r["issue"] is None)
    assert rows[0]["markets"] == 2 and rows[0]["part"] == 0.123456 and rows[1]["issue"] is None and math.isnan(rows[1]["part"])
    assert back["scoring_summary"].count() == 0


def test_markdown(spark, results):
    assert markdown(results["scoring_summary"]) == "_no rows_\n"
    df = spark.createDataFrame([("a|b", 0.123456), ("c", float("inf"))], "name string, x double").orderBy("name")
    assert markdown(df) == "| name | x |\n| --- | --- |\n| a\\|b | 0.1235 |\n| c |  |\n"
    assert markdown(spark.range(20).coalesce(1)).count("\n") == 17
    text = report(results, {"scoring": {"How?": ["summary", "none"]}})
    assert "`scoring_summary`" in text and "none" not in text and "## Ranking" not in text


def test_group_z_of_what_does_not_vary(spark):
    rows = spark.createDataFrame([(1, 2.0), (1, 2.0), (2, 1.0), (2, 3.0), (3, 5.0)], "g int, x double")
    got = {(r["g"], r["x"]): r["z_x"] for r in G.group_z(rows, ["g"], ["x"]).collect()}
    assert got[1, 2.0] is None and got[3, 5.0] is None and got[2, 3.0] == pytest.approx(math.sqrt(0.5))


def test_partial_spearman_of_a_constant_control(spark):
    rows = spark.createDataFrame([(1, float(i), float(i * i), 7.0) for i in range(6)] + [(2, float(i), float(i), 1.0) for i in range(5)] + [(3, 1.0, float(i), float(i)) for i in range(6)], "g int, x double, y double, c double")
    assert {r["g"]: r["r"] for r in G.partial_spearman(rows, ["g"], "x", "y", "c").collect()} == {1: pytest.approx(1.0), 2: None, 3: None}


def test_scores_of_a_flat_past(spark):
    panel = spark.createDataFrame([(1, t, 5.0 if t < 9 else 6.0) for t in range(10)], "netuid int, t int, x double")
    times = panel.selectExpr("netuid", "t", "7200.0D AS spacing_blocks")
    got = {r["t"]: r["score"] for r in G.signal_scores(panel, times, ["x"]).collect()}
    assert all(got[t] is None for t in range(7)) and got[7] == 0 and got[9] == pytest.approx(1e9)


def test_robust_z_of_large_equal_values(spark):
    rows = spark.createDataFrame([(1, t, float("nan") if t == 2 else 1e9 + 0.1 + (t == 7)) for t in range(8)], "g int, t int, x double")
    got = {r["t"]: r["z"] for r in trailing_robust_z(rows, ["g"], "t", "x", 6).collect()}
    assert got[6] == 0 and got[7] == pytest.approx(1e9, rel=1e-6)


def test_jaccard_of_empty_sets(spark):
    rows = spark.createDataFrame([(1, ["a", "b"], ["b", "c"]), (2, [], [])], "k int, a array<string>, b array<string>")
    assert [r["j"] for r in rows.orderBy("k").select(G.jaccard(rows.a, rows.b).alias("j")).collect()] == [pytest.approx(1 / 3), None]
