"""Queries over the adapter views, each beside the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import panel, sequences
from ..sources.adapters import states, table, weights

STATES = """s AS (SELECT event_type AS netuid, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS t, user_id % 15 AS uid,
  CAST(sum(CAST(floor(value * 100) AS BIGINT)) AS BIGINT) AS incentive, max(event_id) AS last_update, min(event_id) AS first_seen, count(*) AS n FROM events GROUP BY 1, 2, 3)"""
WEIGHTS = """w AS (SELECT l_returnflag AS netuid, (year(l_shipdate) - 1992) * 4 + quarter(l_shipdate) - 1 AS t, l_suppkey % 20 AS src, l_partkey % 40 AS dest,
  CAST(sum(CAST(floor(l_quantity) AS BIGINT)) AS BIGINT) AS w FROM lineitem GROUP BY 1, 2, 3, 4)"""
TOTALS = "d AS (SELECT netuid, t, CAST(sum(incentive) AS BIGINT) AS total, count(*) AS members FROM s GROUP BY 1, 2)"
K = ["netuid", "t"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def totals(spark: SparkSession, d: str) -> DataFrame:
    return states(spark, d).groupBy(*K).agg(F.sum("incentive").alias("total"), F.count("*").alias("members"))


@query(f"""WITH {STATES}, r AS (SELECT *, row_number() OVER (PARTITION BY netuid, t ORDER BY incentive) AS up, row_number() OVER (PARTITION BY netuid, t ORDER BY incentive DESC) AS down FROM s),
g AS (SELECT netuid, t, count(*) AS n, CAST(sum(incentive) AS DOUBLE) AS s, CAST(sum(incentive * up) AS DOUBLE) AS w, CAST(sum(incentive) FILTER (down <= 10) AS DOUBLE) AS top, CAST(sum(CAST(incentive AS HUGEINT) * incentive) AS DOUBLE) AS q FROM r GROUP BY 1, 2)
SELECT netuid, t, n, CASE WHEN s > 0 THEN 2.0 * w / (n * s) - (n + 1) / n END AS gini, CASE WHEN s > 0 THEN top / s END AS top_share, CASE WHEN s > 0 THEN q / (s * s) END AS hhi, CASE WHEN s > 0 THEN s * s / q END AS effective_n FROM g""")
def panel_concentration(spark, d):
    return panel.concentration(states(spark, d), K, "incentive")


@query(f"WITH {STATES} SELECT netuid, t, uid, coalesce(incentive / nullif(sum(incentive) OVER (PARTITION BY netuid, t), 0), 0.0) AS share FROM s")
def row_share(spark, d):
    return states(spark, d).select(*K, "uid", panel.share("incentive", K).alias("share"))


@query(f"WITH {STATES} SELECT netuid, t, uid, rank() OVER (PARTITION BY netuid, t ORDER BY n) + (count(*) OVER (PARTITION BY netuid, t, n) - 1) / 2 AS avg_rank FROM s")
def avg_tie_rank(spark, d):
    return states(spark, d).select(*K, "uid", panel.average_rank("n", K).alias("avg_rank"))


@query(f"WITH {STATES}, r AS (SELECT netuid, t, uid, rank() OVER (PARTITION BY netuid, t ORDER BY n) + (count(*) OVER (PARTITION BY netuid, t, n) - 1) / 2 AS r, count(*) OVER (PARTITION BY netuid, t) AS m FROM s) SELECT netuid, t, uid, CASE WHEN m > 1 THEN (r - 1) / (m - 1) ELSE 0.0 END AS pct FROM r")
def pct_rank(spark, d):
    return states(spark, d).select(*K, "uid", panel.percent_rank("n", K).alias("pct"))


@query(f"""WITH {STATES}, p AS (SELECT a.netuid, a.t, a.incentive AS x, b.incentive AS y FROM s a JOIN s b ON a.netuid = b.netuid AND a.uid = b.uid AND a.t = b.t + 1),
r AS (SELECT netuid, t, 2 * rank() OVER (PARTITION BY netuid, t ORDER BY x) + count(*) OVER (PARTITION BY netuid, t, x) - 1 AS x, 2 * rank() OVER (PARTITION BY netuid, t ORDER BY y) + count(*) OVER (PARTITION BY netuid, t, y) - 1 AS y FROM p),
g AS (SELECT netuid, t, count(*) AS n, CAST(count(*) * sum(x * x) - sum(x) * sum(x) AS DOUBLE) AS vx, CAST(count(*) * sum(y * y) - sum(y) * sum(y) AS DOUBLE) AS vy, CAST(count(*) * sum(x * y) - sum(x) * sum(y) AS DOUBLE) AS c FROM r GROUP BY 1, 2)
SELECT netuid, t, n, CASE WHEN n >= 5 AND vx > 0 AND vy > 0 THEN c / sqrt(vx * vy) END AS r FROM g""")
def spearman_consecutive(spark, d):
    rows = panel.previous(states(spark, d), ["netuid", "uid"], "t", "incentive")
    return panel.rank_correlation(rows, K, "incentive", "prev_incentive")


@query(f"""WITH {STATES}, x AS (SELECT netuid, n AS score, incentive > 25000 AS y FROM s), r AS (SELECT netuid, y, 2 * rank() OVER (PARTITION BY netuid ORDER BY score) + count(*) OVER (PARTITION BY netuid, score) - 1 AS r FROM x),
g AS (SELECT netuid, count(*) FILTER (y) AS p, count(*) FILTER (NOT y) AS n, CAST(sum(r) FILTER (y) AS DOUBLE) AS s FROM r GROUP BY 1) SELECT netuid, CASE WHEN p > 0 AND n > 0 THEN (s - p * (p + 1)) / (2.0 * p * n) END AS auc FROM g""")
def auc_by_market(spark, d):
    return panel.auc(states(spark, d).withColumn("y", F.col("incentive") > 25000), ["netuid"], "n", "y")


@query(f"WITH {STATES}, {TOTALS} SELECT s.netuid, s.t, uid, last_update, incentive, coalesce(lag(first_seen) OVER w > first_seen, false) AS moved_back, lag(s.t) OVER w AS prev_t, lead(s.t) OVER w AS next_t, coalesce(lead(s.t) OVER w - s.t, s.t - lag(s.t) OVER w, 1) AS interval_t FROM s WINDOW w AS (PARTITION BY netuid, uid ORDER BY t)")
def interval_lead_lag(spark, d):
    w = Window.partitionBy("netuid", "uid").orderBy("t")
    gap = F.coalesce(F.lead("t").over(w) - F.col("t"), F.col("t") - F.lag("t").over(w), F.lit(1))
    return states(spark, d).select(*K, "uid", "last_update", "incentive", F.coalesce(F.lag("first_seen").over(w) > F.col("first_seen"), F.lit(False)).alias("moved_back"), F.lag("t").over(w).alias("prev_t"), F.lead("t").over(w).alias("next_t"), gap.alias("interval_t"))


@query(f"WITH {STATES}, f AS (SELECT *, CASE WHEN n <> lag(n) OVER w THEN 1 ELSE 0 END AS replaced FROM s WINDOW w AS (PARTITION BY netuid, uid ORDER BY t)) SELECT netuid, t, uid, replaced, uid || ':' || CAST(sum(replaced) OVER (PARTITION BY netuid, uid ORDER BY t) AS BIGINT) AS occupant FROM f")
def occupant_epoch(spark, d):
    w = Window.partitionBy("netuid", "uid").orderBy("t")
    s = states(spark, d).withColumn("replaced", F.when(F.col("n") != F.lag("n").over(w), 1).otherwise(0))
    return s.select(*K, "uid", "replaced", F.concat_ws(":", "uid", F.sum("replaced").over(w)).alias("occupant"))


@query(f"WITH {STATES}, {TOTALS} SELECT netuid, t, total, CASE WHEN count(total) OVER f >= 3 THEN sum(total) OVER f / count(total) OVER f END AS trailing FROM d WINDOW f AS (PARTITION BY netuid ORDER BY t ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)")
def rolling_mean_shift(spark, d):
    w = sequences.ordered(["netuid"], "t")
    return totals(spark, d).select(*K, "total", sequences.trailing_mean("total", w, 7).alias("trailing"))


@query(f"""WITH {STATES}, {TOTALS}, b AS (SELECT netuid, t, total, list(CAST(total AS DOUBLE)) OVER f AS b, count(*) OVER f AS k, row_number() OVER (PARTITION BY netuid ORDER BY t) AS place FROM d WINDOW f AS (PARTITION BY netuid ORDER BY t ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)),
m AS (SELECT *, CASE WHEN k >= 3 THEN CAST(list_aggregate(b, 'median') AS DOUBLE) END AS median FROM b), a AS (SELECT *, CASE WHEN k >= 3 THEN CAST(list_aggregate(list_transform(b, lambda v: abs(v - median)), 'median') AS DOUBLE) END AS mad FROM m)
SELECT netuid, t, total, members, median, mad, CASE WHEN place > 7 THEN (total - median) / CASE WHEN mad > 0 THEN 1.4826 * mad ELSE greatest(sqrt(greatest(k * list_sum(list_transform(b, lambda v: v * v)) - list_sum(b) * list_sum(b), 0)) / k, 1e-9) END END AS z FROM a JOIN (SELECT netuid, t, members FROM d) USING (netuid, t)""")
def trailing_robust_z(spark, d):
    return sequences.trailing_robust_z(totals(spark, d), ["netuid"], "t", "total", 7)


@query(f"""WITH {STATES}, e AS (SELECT netuid, uid, t FROM s WHERE incentive > 20000), g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY netuid, uid ORDER BY t) <= 2 THEN 0 ELSE 1 END AS new FROM e),
i AS (SELECT *, CAST(sum(new) OVER (PARTITION BY netuid, uid ORDER BY t) AS BIGINT) AS session FROM g) SELECT netuid, uid, session, min(t) AS first, max(t) AS last, count(*) AS n FROM i GROUP BY 1, 2, 3""")
def burst_sessions(spark, d):
    return sequences.sessions(states(spark, d).filter("incentive > 20000"), ["netuid", "uid"], "t", 2)


@query(f"""WITH RECURSIVE {STATES}, e AS (SELECT netuid, uid, t FROM s WHERE incentive > 20000), c AS (SELECT netuid, uid, min(t) AS t, CAST(1 AS BIGINT) AS n FROM e GROUP BY 1, 2
UNION ALL SELECT c.netuid, c.uid, (SELECT min(e.t) FROM e WHERE e.netuid = c.netuid AND e.uid = c.uid AND e.t >= c.t + 3), c.n + 1 FROM c WHERE EXISTS (SELECT 1 FROM e WHERE e.netuid = c.netuid AND e.uid = c.uid AND e.t >= c.t + 3))
SELECT netuid, uid, max(n) AS n FROM c GROUP BY 1, 2""")
def cooldown_count(spark, d):
    return sequences.separated_count(states(spark, d).filter("incentive > 20000"), ["netuid", "uid"], "t", 3)


@query(f"""WITH {STATES}, {TOTALS}, l AS (SELECT netuid, max(t) AS last FROM d GROUP BY 1) SELECT d.netuid, a.start, count(*) AS n, CAST(sum(total) AS BIGINT) AS total FROM d JOIN l USING (netuid), (SELECT unnest(range(0, 400, 2)) AS start) a
WHERE d.t >= a.start AND d.t < a.start + 7 AND a.start + 7 <= l.last + 1 GROUP BY 1, 2""")
def sliding_row_windows(spark, d):
    return sequences.row_windows(totals(spark, d), ["netuid"], "t", 7, 2).groupBy("netuid", F.col("start").cast("long").alias("start")).agg(F.count("*").alias("n"), F.sum("total").alias("total"))


@query(f"WITH {STATES}, {TOTALS} SELECT netuid, t // 7 AS w, count(*) AS n, CAST(sum(total) AS BIGINT) AS total FROM d GROUP BY 1, 2 HAVING count(*) >= 4")
def tumbling_row_windows(spark, d):
    return totals(spark, d).groupBy("netuid", F.floor(F.col("t") / 7).alias("w")).agg(F.count("*").alias("n"), F.sum("total").alias("total")).filter("n >= 4")


@query(f"WITH {STATES}, {TOTALS}, k AS (SELECT netuid, t, CASE WHEN t % 3 = 0 THEN total END AS sampled FROM d) SELECT netuid, t, sampled, last_value(sampled IGNORE NULLS) OVER (PARTITION BY netuid ORDER BY t ROWS UNBOUNDED PRECEDING) AS filled FROM k")
def ffill_cadence(spark, d):
    return sequences.forward_fill(totals(spark, d).select(*K, F.when(F.col("t") % 3 == 0, F.col("total")).alias("sampled")), ["netuid"], "t", "sampled")


@query(f"WITH {STATES}, r AS (SELECT netuid, t, uid, row_number() OVER (PARTITION BY netuid, t ORDER BY incentive, uid) AS r, count(*) OVER (PARTITION BY netuid, t) AS n FROM s) SELECT netuid, t, uid, CAST(greatest(0, ceil((r - 1) * 5 / nullif(n - 1, 0)) - 1) AS BIGINT) AS bin FROM r")
def qcut_bins(spark, d):
    return states(spark, d).select(*K, "uid", sequences.quintile("incentive", "uid", K).alias("bin"))


@query(f"""WITH {STATES}, {TOTALS}, i AS (SELECT netuid, t AS start, t + 3 AS stop FROM d WHERE t % 5 = 0) SELECT i.netuid, i.start, count(d.t) AS n, CAST(sum(d.total) AS BIGINT) AS total FROM i LEFT JOIN d ON d.netuid = i.netuid AND d.t BETWEEN i.start AND i.stop GROUP BY 1, 2""")
def interval_join_active(spark, d):
    p = totals(spark, d)
    i = p.filter("t % 5 = 0").select(F.col("netuid").alias("m"), F.col("t").alias("start"), (F.col("t") + 3).alias("stop"))
    return i.join(p, (F.col("m") == F.col("netuid")) & F.col("t").between(F.col("start"), F.col("stop")), "left").groupBy(F.col("m").alias("netuid"), "start").agg(F.count("t").alias("n"), F.sum("total").alias("total"))


@query(f"""WITH {STATES}, {TOTALS} SELECT a.netuid, a.t, max(b.t) AS before FROM d a LEFT JOIN d b ON a.netuid = b.netuid AND b.t < a.t AND b.t % 4 = 1 GROUP BY 1, 2""")
def asof_registration(spark, d):
    w = Window.partitionBy("netuid").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    return totals(spark, d).select(*K, F.max(F.when(F.col("t") % 4 == 1, F.col("t"))).over(w).alias("before"))


GAIN = "b AS (SELECT netuid, uid, CAST(sum(incentive) AS BIGINT) AS x FROM s WHERE t < 15 GROUP BY 1, 2), a AS (SELECT netuid, uid, CAST(sum(incentive) AS BIGINT) AS y FROM s WHERE t >= 15 GROUP BY 1, 2), g AS (SELECT netuid, uid, coalesce(y, 0) - coalesce(x, 0) AS gain FROM b FULL JOIN a USING (netuid, uid))"


def gains(spark, d):
    s = states(spark, d)
    x = s.filter("t < 15").groupBy("netuid", "uid").agg(F.sum("incentive").alias("x"))
    y = s.filter("t >= 15").groupBy("netuid", "uid").agg(F.sum("incentive").alias("y"))
    return x.join(y, ["netuid", "uid"], "full_outer").select("netuid", "uid", (F.coalesce("y", F.lit(0)) - F.coalesce("x", F.lit(0))).alias("gain"))


@query(f"WITH {STATES}, {GAIN} SELECT * FROM g")
def full_outer_gain(spark, d):
    return gains(spark, d)


@query(f"""WITH {STATES}, {GAIN}, n AS (SELECT *, count(*) OVER (PARTITION BY netuid) AS m FROM g), r AS (SELECT netuid, uid, gain, m, row_number() OVER w AS place, coalesce(sum(gain) OVER (PARTITION BY netuid ORDER BY gain DESC, uid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(gain) OVER (PARTITION BY netuid) AS gains FROM n WHERE gain > 0 WINDOW w AS (PARTITION BY netuid ORDER BY gain DESC, uid))
SELECT netuid, uid, gain, place FROM r WHERE before < 0.5 * gains AND place <= greatest(floor(m * 0.2), 1)""")
def cohort_smallest_set(spark, d):
    return panel.smallest_cover(gains(spark, d), ["netuid"], "gain", "uid")


@query(f"""WITH {STATES}, k AS (SELECT netuid, t, uid FROM s QUALIFY row_number() OVER (PARTITION BY netuid, t ORDER BY incentive DESC, uid) <= 5) SELECT b.netuid, b.t, 1 - count(a.uid) / 5 AS turnover FROM k b LEFT JOIN k a ON a.netuid = b.netuid AND a.uid = b.uid AND a.t = b.t - 1 WHERE b.t > 0 GROUP BY 1, 2""")
def topk_turnover(spark, d):
    k = states(spark, d).withColumn("r", F.row_number().over(Window.partitionBy(*K).orderBy(F.desc("incentive"), "uid"))).filter("r <= 5").select(*K, "uid")
    return panel.previous(k, ["netuid", "uid"], "t", "uid").filter("t > 0").groupBy(*K).agg((1 - F.count("prev_uid") / 5).alias("turnover"))


@query(f"WITH {STATES}, o AS (SELECT DISTINCT netuid, uid FROM s WHERE incentive > 30000) SELECT s.netuid, s.t, s.uid, o.uid IS NOT NULL AS flagged FROM s LEFT JOIN o ON s.netuid = o.netuid AND s.uid = o.uid")
def semi_join_flag(spark, d):
    s = states(spark, d)
    o = s.filter("incentive > 30000").select("netuid", "uid").distinct().withColumn("hit", F.lit(True))
    return s.join(o, ["netuid", "uid"], "left").select(*K, "uid", F.coalesce("hit", F.lit(False)).alias("flagged"))


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 40)")
def anti_join_todo(spark, d):
    return table(spark, d, "orders").join(table(spark, d, "lineitem").filter("l_quantity > 40"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


@query(f"WITH {STATES}, u AS (SELECT netuid, uid, t, 1 AS kind FROM s WHERE incentive > 30000 UNION ALL SELECT netuid, uid, min(t), 2 FROM s GROUP BY 1, 2) SELECT netuid, uid, t, kind FROM u QUALIFY row_number() OVER (PARTITION BY netuid, t ORDER BY kind, uid) = 1")
def union_dedupe_first(spark, d):
    s = states(spark, d)
    u = s.filter("incentive > 30000").select("netuid", "uid", "t", F.lit(1).alias("kind")).unionByName(s.groupBy("netuid", "uid").agg(F.min("t").alias("t")).withColumn("kind", F.lit(2)))
    return u.withColumn("r", F.row_number().over(Window.partitionBy(*K).orderBy("kind", "uid"))).filter("r = 1").drop("r")


@query(f"WITH {STATES} SELECT netuid, count(*) AS n, CAST(min(incentive) AS BIGINT) AS low, CAST(max(incentive) AS BIGINT) AS high, quantile_cont(CAST(incentive AS DOUBLE), 0.1) AS p10, quantile_cont(CAST(incentive AS DOUBLE), 0.5) AS median, quantile_cont(CAST(incentive AS DOUBLE), 0.9) AS p90, count(DISTINCT n) AS kinds FROM s GROUP BY 1")
def column_profile(spark, d):
    p = lambda q: F.expr(f"percentile(incentive, {q})")
    return states(spark, d).groupBy("netuid").agg(F.count("*").alias("n"), F.min("incentive").alias("low"), F.max("incentive").alias("high"), p(0.1).alias("p10"), p(0.5).alias("median"), p(0.9).alias("p90"), F.countDistinct("n").alias("kinds"))


@query(f"""WITH {STATES}, u AS (SELECT netuid, uid, count(*) FILTER (incentive > 20000) AS k, count(*) AS m FROM s GROUP BY 1, 2) SELECT netuid, uid, (sum(k) OVER w - k + 1) / (sum(m) OVER w - m + 2) AS rate FROM u WINDOW w AS (PARTITION BY netuid)""")
def leave_one_out_rate(spark, d):
    w = Window.partitionBy("netuid")
    u = states(spark, d).groupBy("netuid", "uid").agg(F.count(F.when(F.col("incentive") > 20000, 1)).alias("k"), F.count("*").alias("m"))
    return u.select("netuid", "uid", ((F.sum("k").over(w) - F.col("k") + 1) / (F.sum("m").over(w) - F.col("m") + 2)).alias("rate"))


@query(f"""WITH {STATES}, m AS (SELECT netuid, median(incentive) AS med FROM s GROUP BY 1), a AS (SELECT s.netuid, median(abs(incentive - med)) AS mad FROM s JOIN m USING (netuid) GROUP BY 1) SELECT s.netuid, t, uid, (incentive - med) / (1.4826 * nullif(mad, 0)) AS z FROM s JOIN m USING (netuid) JOIN a USING (netuid)""")
def group_mad_z(spark, d):
    s = states(spark, d)
    s = s.join(s.groupBy("netuid").agg(F.expr("percentile(incentive, 0.5)").alias("med")), "netuid")
    mad = s.groupBy("netuid").agg(F.expr("percentile(abs(incentive - med), 0.5)").alias("mad"))
    return s.join(mad, "netuid").select(*K, "uid", ((F.col("incentive") - F.col("med")) / (1.4826 * F.nullif("mad", F.lit(0.0)))).alias("z"))


@query(f"""WITH {STATES}, r AS (SELECT *, row_number() OVER (PARTITION BY netuid, t ORDER BY incentive DESC, uid) AS r FROM s), g AS (SELECT netuid, t, sum(incentive) FILTER (r = 1) / sum(incentive) AS top1, sum(incentive) FILTER (r <= 3) / sum(incentive) AS top3 FROM r GROUP BY 1, 2),
c AS (SELECT netuid, t, CASE WHEN top1 > 0.2 THEN 'winner' WHEN top3 > 0.3 THEN 'few' ELSE 'flat' END AS kind FROM g), v AS (SELECT netuid, kind, count(*) AS k, sum(count(*)) OVER (PARTITION BY netuid) AS n FROM c GROUP BY 1, 2)
SELECT netuid, CASE WHEN k / n < 0.6 THEN 'mixed' ELSE kind END AS kind, k / n AS stability FROM v QUALIFY row_number() OVER (PARTITION BY netuid ORDER BY k DESC, kind) = 1""")
def majority_vote_type(spark, d):
    w = Window.partitionBy(*K).orderBy(F.desc("incentive"), "uid")
    part = lambda k: F.sum(F.when(F.col("r") <= k, F.col("incentive"))) / F.sum("incentive")
    g = states(spark, d).withColumn("r", F.row_number().over(w)).groupBy(*K).agg(part(1).alias("top1"), part(3).alias("top3"))
    v = g.select("netuid", F.when(F.col("top1") > 0.2, "winner").when(F.col("top3") > 0.3, "few").otherwise("flat").alias("kind")).groupBy("netuid", "kind").agg(F.count("*").alias("k"))
    m = Window.partitionBy("netuid")
    v = v.withColumn("n", F.sum("k").over(m)).withColumn("r", F.row_number().over(m.orderBy(F.desc("k"), "kind"))).filter("r = 1")
    return v.select("netuid", F.when(F.col("k") / F.col("n") < 0.6, "mixed").otherwise(F.col("kind")).alias("kind"), (F.col("k") / F.col("n")).alias("stability"))


@query(f"""WITH {WEIGHTS}, v AS (SELECT DISTINCT netuid, t, src FROM w), m AS (SELECT DISTINCT netuid, t, dest FROM w), g AS (SELECT v.netuid, v.t, v.src, m.dest, coalesce(w.w, 0) AS w FROM v JOIN m USING (netuid, t) LEFT JOIN w ON w.netuid = v.netuid AND w.t = v.t AND w.src = v.src AND w.dest = m.dest)
SELECT netuid, t, dest, count(*) AS scorers, median(w) AS median, count(*) FILTER (w > 0) / count(*) AS breadth, CASE WHEN sum(w) > 0 THEN sqrt(CAST(count(*) * sum(w * w) - sum(w) * sum(w) AS DOUBLE)) / CAST(sum(w) AS DOUBLE) END AS cv FROM g GROUP BY 1, 2, 3""")
def support_grid(spark, d):
    w = weights(spark, d)
    grid = w.select(*K, "src").distinct().join(w.select(*K, "dest").distinct(), K).join(w, [*K, "src", "dest"], "left").withColumn("w", F.coalesce("w", F.lit(0)))
    n, s, q = F.count("*"), F.sum("w"), F.sum(F.col("w") * F.col("w"))
    return grid.groupBy(*K, "dest").agg(n.alias("scorers"), F.expr("percentile(w, 0.5)").alias("median"), (F.count(F.when(F.col("w") > 0, 1)) / n).alias("breadth"), F.when(s > 0, F.sqrt((n * q - s * s).cast("double")) / s.cast("double")).alias("cv"))


@query(f"""WITH {WEIGHTS}, q AS (SELECT netuid, t, src, CAST(sum(w * w) AS DOUBLE) AS q FROM w GROUP BY 1, 2, 3), p AS (SELECT a.netuid, a.t, a.src AS a, b.src AS b, CAST(sum(a.w * b.w) AS DOUBLE) AS dot FROM w a JOIN w b ON a.netuid = b.netuid AND a.t = b.t AND a.dest = b.dest AND a.src < b.src GROUP BY 1, 2, 3, 4)
SELECT p.netuid, p.t, p.a, p.b, dot / sqrt(x.q * y.q) AS cosine FROM p JOIN q x ON x.netuid = p.netuid AND x.t = p.t AND x.src = p.a JOIN q y ON y.netuid = p.netuid AND y.t = p.t AND y.src = p.b""")
def pair_cosine(spark, d):
    w = weights(spark, d)
    norm = w.groupBy(*K, "src").agg(F.sum(F.col("w") * F.col("w")).cast("double").alias("q"))
    other = w.select(*K, "dest", F.col("src").alias("b"), F.col("w").alias("v"))
    p = w.withColumnRenamed("src", "a").join(other, [*K, "dest"]).filter("a < b").groupBy(*K, "a", "b").agg(F.sum(F.col("w") * F.col("v")).cast("double").alias("dot"))
    side = lambda n: norm.select(*K, F.col("src").alias(n), F.col("q").alias(f"q{n}"))
    return p.join(side("a"), [*K, "a"]).join(side("b"), [*K, "b"]).select(*K, "a", "b", (F.col("dot") / F.sqrt(F.col("qa") * F.col("qb"))).alias("cosine"))


@query(f"WITH {STATES}, v AS (SELECT unnest([10000, 20000, 30000]) AS threshold) SELECT threshold, netuid, count(*) AS hits, count(DISTINCT uid) AS members FROM s, v WHERE incentive > threshold GROUP BY ROLLUP (threshold, netuid) HAVING threshold IS NOT NULL")
def variants_sensitivity(spark, d):
    s = states(spark, d).withColumn("threshold", F.explode(F.array(*map(F.lit, (10000, 20000, 30000))))).filter("incentive > threshold")
    return s.rollup("threshold", "netuid").agg(F.count("*").alias("hits"), F.countDistinct("uid").alias("members")).filter("threshold is not null")


@query("SELECT event_type, count(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT)) AS n, CAST(sum(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY 1")
def json_extract_scalar(spark, d):
    k = F.expr("try_cast(get_json_object(props, '$.k') as bigint)")
    return table(spark, d, "events").groupBy("event_type").agg(F.count(k).alias("n"), F.sum(k).alias("k"))
