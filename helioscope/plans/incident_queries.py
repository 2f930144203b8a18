"""Queries of the incident operators, each beside the SQL that says the same; change points and spaced peaks are sequential and have none."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import incidents, panel
from ..sources.adapters import states
from .queries import STATES, TOTALS, K, totals

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def starts(spark: SparkSession, d: str) -> DataFrame:
    return totals(spark, d).filter("t % 5 = 2").select(*K)


@query()
def change_points(spark, d):
    p = panel.concentration(states(spark, d), K, "incentive").join(totals(spark, d), K)
    return incidents.change_points(p, ["netuid"], "t", ["gini", "top_share", "total"], min_size=3, scale=0.2, min_effect=0.5)


@query()
def spaced_peaks(spark, d):
    return incidents.spaced_peaks(totals(spark, d), ["netuid"], "t", "total", 4)


@query(f"""WITH {STATES}, {TOTALS}, i AS (SELECT netuid, t AS start FROM d WHERE t % 5 = 2), m AS (SELECT i.start, d.* FROM i JOIN d ON d.netuid = i.netuid AND d.t >= i.start - 4),
f AS (SELECT netuid, start, sum(total) FILTER (t < start) / count(*) FILTER (t < start) AS base, max(total) FILTER (t BETWEEN start AND start + 3) AS peak FROM m GROUP BY 1, 2),
g AS (SELECT f.*, (SELECT min(t) FROM d WHERE d.netuid = f.netuid AND t BETWEEN f.start AND f.start + 3 AND total = f.peak) AS peak_t FROM f),
l AS (SELECT g.netuid, g.start, d.t, coalesce(total <= base + 0.25 * (peak - base), false) AS low FROM g JOIN d ON d.netuid = g.netuid AND d.t >= g.peak_t), n AS (SELECT *, lead(low) OVER (PARTITION BY netuid, start ORDER BY t) AS next FROM l)
SELECT g.*, (SELECT min(t) FROM n WHERE n.netuid = g.netuid AND n.start = g.start AND low AND next) AS recovered_t FROM g""")
def incident_recovery(spark, d):
    return incidents.recovery(totals(spark, d), starts(spark, d), "netuid", "t", "total", before=4, peak_within=4, unwind=0.75, run=2)


@query(f"""WITH {STATES}, {TOTALS}, i AS (SELECT netuid, t AS start FROM d WHERE t % 5 = 2), b AS (SELECT i.netuid, i.start, sum(total) / nullif(count(total), 0) AS base FROM i LEFT JOIN d ON d.netuid = i.netuid AND d.t BETWEEN i.start - 4 AND i.start - 1 GROUP BY 1, 2)
SELECT b.netuid, b.start, min(d.t) AS response_t FROM b LEFT JOIN d ON d.netuid = b.netuid AND d.t BETWEEN b.start AND b.start + 7 AND d.total - b.base >= 500 GROUP BY 1, 2""")
def incident_response(spark, d):
    return incidents.first_rise(totals(spark, d), starts(spark, d), "netuid", "t", "total", before=4, horizon=8, rise=500)


@query(f"""WITH {STATES}, e AS (SELECT netuid, t FROM s GROUP BY 1, 2 HAVING max(incentive) > 30000), g AS (SELECT *, t - lag(t) OVER (PARTITION BY netuid ORDER BY t) AS g FROM e)
SELECT netuid, count(*) AS n, median(g) AS median_gap, count(*) FILTER (g BETWEEN 2 AND 4) / nullif(count(g), 0) AS regular_share FROM g GROUP BY 1""")
def incident_gaps(spark, d):
    e = states(spark, d).groupBy(*K).agg(F.max("incentive").alias("m")).filter("m > 30000").select(*K)
    return incidents.gap_profile(e, ["netuid"], "t", 2, 4)


SPIKES = """f AS (SELECT netuid, t, uid, incentive, CAST(count(incentive) OVER f AS DOUBLE) AS n, CAST(sum(incentive) OVER f AS DOUBLE) AS x, CAST(sum(CAST(incentive AS HUGEINT) * incentive) OVER f AS DOUBLE) AS q FROM s WINDOW f AS (PARTITION BY netuid, uid ORDER BY t ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)),
m AS (SELECT *, CASE WHEN n >= 3 THEN x / n END AS mean FROM f), k AS (SELECT netuid, t, uid, incentive, mean, coalesce(incentive - mean >= 1.5 * greatest(sqrt(greatest(n * q - x * x, 0) / nullif(n * (n - 1), 0)), 10) AND incentive - mean >= 1000, false) AS spike FROM m)"""


def spiked(spark: SparkSession, d: str) -> DataFrame:
    return incidents.spikes(states(spark, d), ["netuid", "uid"], "t", "incentive", 7, z=1.5, least=1000, floor=10.0).select(*K, "uid", "incentive", "mean", "spike")


@query(f"WITH {STATES}, {SPIKES} SELECT * FROM k")
def reward_spikes(spark, d):
    return spiked(spark, d)


@query(f"""WITH {STATES}, {SPIKES} SELECT netuid, t, uid, bool_or(spike) OVER (PARTITION BY netuid, uid ORDER BY t ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS around, coalesce(bool_or(spike) OVER (PARTITION BY netuid, uid ORDER BY t ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), false) AS ahead FROM k""")
def event_dilation(spark, d):
    of = lambda back, ahead: incidents.dilate(F.col("spike"), ["netuid", "uid"], "t", back, ahead)
    return spiked(spark, d).select(*K, "uid", of(1, 1).alias("around"), of(-1, 3).alias("ahead"))


@query(f"""WITH {STATES}, g AS (SELECT netuid, t, n AS p, incentive AS q, sum(n) OVER w AS sp, sum(incentive) OVER w AS sq FROM s WINDOW w AS (PARTITION BY netuid, t))
SELECT netuid, t, CASE WHEN max(sp) > 0 AND max(sq) > 0 THEN CAST(sum(abs(CAST(p AS HUGEINT) * sq - CAST(q AS HUGEINT) * sp)) AS DOUBLE) / (2.0 * CAST(max(sp) AS DOUBLE) * CAST(max(sq) AS DOUBLE)) END AS gap FROM g GROUP BY 1, 2""")
def variation_distance(spark, d):
    return incidents.variation_distance(states(spark, d), K, "n", "incentive")


@query(f"""WITH {STATES}, p AS (SELECT netuid, t, uid, CASE WHEN incentive > 15000 THEN 1 ELSE 0 END AS flag FROM s), w AS (SELECT *, sum(flag) OVER f AS k, count(*) OVER f AS n FROM p WINDOW f AS (PARTITION BY netuid, uid ORDER BY t ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
SELECT netuid, t, uid, flag = 1 AND n >= 4 AND 10 * k >= 6 * n AS persistent FROM w""")
def persistent_flag(spark, d):
    f = Window.partitionBy("netuid", "uid").orderBy("t").rowsBetween(-4, 0)
    p = states(spark, d).withColumn("flag", F.when(F.col("incentive") > 15000, 1).otherwise(0))
    return p.select(*K, "uid", ((F.col("flag") == 1) & (F.count("*").over(f) >= 4) & (10 * F.sum("flag").over(f) >= 6 * F.count("*").over(f))).alias("persistent"))


@query(f"""WITH {STATES} SELECT netuid, t, sum(incentive) FILTER (uid % 3 = 0) / count(*) FILTER (uid % 3 = 0) AS a, sum(incentive) FILTER (uid % 3 = 1) / count(*) FILTER (uid % 3 = 1) AS b, sum(incentive) FILTER (uid % 3 = 2) / count(*) FILTER (uid % 3 = 2) AS c FROM s GROUP BY 1, 2""")
def pivot_mean(spark, d):
    s = states(spark, d).withColumn("part", F.element_at(F.array(*map(F.lit, "abc")), (F.col("uid") % 3 + 1).cast("int")))
    return s.groupBy(*K).pivot("part", ["a", "b", "c"]).agg(F.sum("incentive") / F.count("incentive"))


@query(f"""WITH {STATES}, g AS (SELECT netuid, count(DISTINCT uid) AS size_value, CAST(sum(incentive) AS DOUBLE) AS x, CAST(sum(incentive) FILTER (incentive > 20000) AS DOUBLE) AS y FROM s GROUP BY 1), p AS (SELECT netuid, size_value, 100 * coalesce(y, 0) / x AS impact_pct FROM g),
b AS (SELECT *, 1 + (size_value >= 5)::BIGINT + (size_value >= 10)::BIGINT + (size_value >= 15)::BIGINT AS size_score, 1 + (impact_pct >= 1)::BIGINT + (impact_pct >= 5)::BIGINT + (impact_pct >= 10)::BIGINT + (impact_pct >= 25)::BIGINT AS impact_score FROM p)
SELECT row_number() OVER (ORDER BY size_score * impact_score DESC, impact_pct DESC, netuid) AS rank, netuid, size_value, impact_pct, size_score, impact_score, size_score * impact_score AS priority FROM b""")
def priority_ranking(spark, d):
    g = states(spark, d).groupBy("netuid").agg(F.countDistinct("uid").alias("size_value"), (100 * F.coalesce(F.sum(F.when(F.col("incentive") > 20000, F.col("incentive"))), F.lit(0)).cast("double") / F.sum("incentive").cast("double")).alias("impact_pct"))
    b = g.withColumn("size_score", incidents.band(F.col("size_value"), [5, 10, 15]).cast("long")).withColumn("impact_score", incidents.band(F.col("impact_pct"), [1, 5, 10, 25]).cast("long")).withColumn("priority", F.col("size_score") * F.col("impact_score"))
    return b.select(F.row_number().over(Window.orderBy(F.desc("priority"), F.desc("impact_pct"), "netuid")).cast("long").alias("rank"), "*")
