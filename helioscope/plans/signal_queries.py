"""Queries of signals and of what a collector asks, each beside the SQL that says the same.

Scores are rounded to nine places before they are ranked, in both: their medians differ in the last bit, which would split ties.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import collection as C
from ..operators import signals as G
from ..operators import silver as S
from ..sources import silver as source
from ..sources.silver import SILVER_SQL
from .silver_queries import TIMED, K, nine, query

SIGNALS = ["subnet_tao", "burn_cost", "alpha_in"]
#: Items and how often they are fetched; what a call of each takes.
EVERY = {"emission": 1, "weights": 3, "owners": 10}
SECONDS = {"emission": 2, "weights": 9, "owners": 4}
#: The days without an owner stand for incidents; an alarm is a score of 1.5 here, as these signals are noise.
ALARM = 1.5

LONG = "lo AS (SELECT netuid, t, signal, CAST(v AS DOUBLE) AS v FROM (SELECT netuid, t, CAST(subnet_tao AS BIGINT) AS subnet_tao, CAST(burn_cost AS BIGINT) AS burn_cost, CAST(alpha_in AS BIGINT) AS alpha_in FROM sn) UNPIVOT (v FOR signal IN (subnet_tao, burn_cost, alpha_in)))"
SPANS = "sp AS (SELECT DISTINCT netuid, greatest(1, CAST(round_even(7 * 86400.0 / spacing_blocks / 12, 0) AS INTEGER)) AS k, greatest(1, CAST(round_even(3 * 86400.0 / spacing_blocks / 12, 0) AS INTEGER)) AS l FROM tm)"
SCORES = f"""{LONG}, {SPANS}, ps AS (SELECT a.netuid, a.signal, a.t, a.v, any_value(k) AS k, list(b.v) AS b, quantile_cont(b.v, 0.5) AS m, stddev_pop(b.v) AS sd FROM lo a JOIN sp USING (netuid) JOIN lo b ON b.netuid = a.netuid AND b.signal = a.signal AND b.t < a.t AND b.t >= a.t - k WHERE a.t >= k GROUP BY 1, 2, 3, 4),
pm AS (SELECT *, list_median(list_transform(b, lambda x: abs(x - m))) AS mad FROM ps WHERE len(b) >= greatest(3, k // 2)),
ss AS (SELECT lo.netuid, lo.t, lo.signal, round(abs((pm.v - m) / CASE WHEN mad > 0 THEN 1.4826 * mad ELSE greatest(sd, 1e-9) END), 9) AS score FROM lo LEFT JOIN pm USING (netuid, signal, t))"""
LEADING = f"""{SCORES}, ic AS (SELECT netuid, t AS t0 FROM sn WHERE owner_hotkey = 'gone'),
lb AS (SELECT tm.netuid, tm.t, hours, EXISTS (SELECT 1 FROM ic WHERE ic.netuid = tm.netuid AND tm.t BETWEEN t0 - l AND t0) AS label, EXISTS (SELECT 1 FROM ic WHERE ic.netuid = tm.netuid AND tm.t > t0 AND tm.t <= t0 + l) AS after FROM tm JOIN sp USING (netuid)),
us2 AS (SELECT signal, score, label FROM ss JOIN lb USING (netuid, t) WHERE label OR NOT after),
rk AS (SELECT signal, label, rank() OVER (PARTITION BY signal ORDER BY score) + (count(*) OVER (PARTITION BY signal, score) - 1) / 2 AS r FROM us2 WHERE score IS NOT NULL),
au AS (SELECT signal, (sum(r) FILTER (label) - count(*) FILTER (label) * (count(*) FILTER (label) + 1) / 2) / (count(*) FILTER (label) * count(*) FILTER (NOT label)) AS auc FROM rk GROUP BY 1),
fa AS (SELECT signal, avg(CASE WHEN score >= {ALARM} THEN 1.0 ELSE 0.0 END) AS false_alarm_rate FROM us2 WHERE NOT label GROUP BY 1),
fi AS (SELECT ss.signal, ic.netuid, t0, min(ss.t) FILTER (score >= {ALARM}) AS h FROM ic JOIN sp USING (netuid) JOIN ss ON ss.netuid = ic.netuid AND ss.t BETWEEN t0 - l AND t0 GROUP BY 1, 2, 3),
hi AS (SELECT signal, avg(CASE WHEN h IS NOT NULL THEN 1.0 ELSE 0.0 END) AS hit_rate, quantile_cont(b.hours - a.hours, 0.5) AS median_lead_hours FROM fi JOIN tm b ON b.netuid = fi.netuid AND b.t = t0 LEFT JOIN tm a ON a.netuid = fi.netuid AND a.t = h GROUP BY 1),
ld AS (SELECT signal, round(auc, 9) AS auc, round(false_alarm_rate, 9) AS false_alarm_rate, round(hit_rate, 9) AS hit_rate, round(median_lead_hours, 9) AS median_lead_hours, coalesce(auc >= 0.65 AND hit_rate >= 0.3, false) AS actionable FROM au LEFT JOIN fa USING (signal) LEFT JOIN hi USING (signal))"""


def scored(spark, d):
    rows = source.snapshots(spark, d)
    return nine(G.signal_scores(rows, S.timed(rows), SIGNALS), "score"), S.timed(rows)


def led(spark, d):
    scores, times = scored(spark, d)
    gone = times.filter("owner_hotkey = 'gone'").select(F.concat_ws(":", *K).alias("incident"), *K)
    return nine(G.leading(scores, times, gone, alarm=ALARM), "auc", "false_alarm_rate", "hit_rate", "median_lead_hours")


@query(f"WITH {SILVER_SQL} SELECT netuid, t, " + ", ".join(f"round(({x} - avg({x}) OVER w) / nullif(stddev_samp({x}) OVER w, 0), 9) AS z_{x}" for x in SIGNALS) + " FROM sn WINDOW w AS (PARTITION BY netuid)")
def signal_group_z(spark, d):
    names = [f"z_{x}" for x in SIGNALS]
    return nine(G.group_z(source.snapshots(spark, d), ["netuid"], SIGNALS).select(*K, *names), *names)


@query(f"""WITH {SILVER_SQL}, r AS (SELECT netuid, """ + ", ".join(f"rank() OVER (PARTITION BY netuid ORDER BY {x}) + (count(*) OVER (PARTITION BY netuid, {x}) - 1) / 2 AS {n}" for x, n in zip(SIGNALS, "xyc", strict=True)) + """ FROM sn),
c AS (SELECT netuid, count(*) AS n, corr(x, y) AS xy, corr(x, c) AS xc, corr(y, c) AS yc FROM r GROUP BY 1) SELECT netuid, n, round((xy - xc * yc) / sqrt((1 - xc * xc) * (1 - yc * yc)), 9) AS r FROM c""")
def signal_partial_spearman(spark, d):
    return nine(G.partial_spearman(source.snapshots(spark, d), ["netuid"], *SIGNALS), "r")


@query(f"WITH {SILVER_SQL}, {TIMED}, {SCORES} SELECT netuid, t, signal, score FROM ss")
def signal_scores(spark, d):
    return scored(spark, d)[0]


@query(f"WITH {SILVER_SQL}, {TIMED}, {LEADING} SELECT * FROM ld")
def signal_leading(spark, d):
    return led(spark, d)


@query(f"WITH {SILVER_SQL}, {TIMED}, {LEADING} SELECT * FROM ld WHERE auc IS NOT NULL ORDER BY auc DESC, signal LIMIT 2")
def signal_top(spark, d):
    return G.top_signals(led(spark, d), 2)


@query(f"WITH {SILVER_SQL}, i(item, n) AS (VALUES ('emission', 1), ('weights', 3), ('owners', 10)) SELECT netuid, t, block, item FROM sn JOIN i ON t % n = 0")
def collect_due(spark, d):
    return C.due(source.snapshots(spark, d).select(*K, "block"), EVERY, "t")


@query(f"WITH {SILVER_SQL}, s AS (SELECT netuid, CAST(sum(emission) AS BIGINT) AS total FROM us GROUP BY 1) SELECT netuid, total, row_number() OVER (ORDER BY total DESC NULLS LAST, netuid) AS place FROM s QUALIFY place <= 3")
def collect_top_markets(spark, d):
    return C.top_markets(source.uid_state(spark, d), "emission", 3)


@query(f"WITH {SILVER_SQL} SELECT netuid, hotkey, reg_block FROM us WHERE reg_block IS NOT NULL QUALIFY row_number() OVER (PARTITION BY netuid, hotkey ORDER BY t DESC, uid DESC) = 1")
def last_registration(spark, d):
    return C.last_known(source.uid_state(spark, d), ["netuid", "hotkey"], "reg_block", "t", "uid")


@query(f"WITH {SILVER_SQL}, k AS (SELECT hotkey, min(reg_block) AS reg_block FROM us WHERE t < 10 AND hotkey <> '' GROUP BY 1) SELECT *, false AS new FROM k UNION ALL SELECT hotkey, min(reg_block), true FROM us WHERE hotkey <> '' AND hotkey NOT IN (SELECT hotkey FROM k) GROUP BY 1")
def collect_owners(spark, d):
    rows = source.uid_state(spark, d).filter("hotkey <> ''").select("t", "hotkey", "reg_block")
    return C.remember(rows.filter("t < 10").groupBy("hotkey").agg(F.min("reg_block").alias("reg_block")), rows.select("hotkey", "reg_block"), "hotkey", "reg_block")


@query(f"WITH {SILVER_SQL}, i(item, n, s) AS (VALUES ('emission', 1, 2), ('weights', 3, 9), ('owners', 10, 4)) SELECT netuid, item, count(*) AS fetches, round(any_value(s) * ceil(501 / any_value(n)) / 3600, 9) AS hours FROM sn JOIN i ON t % n = 0 GROUP BY 1, 2")
def collect_cost(spark, d):
    told = lambda of: F.create_map(*[F.lit(x) for pair in of.items() for x in pair])[F.col("item")]
    rows = C.due(source.snapshots(spark, d).select(*K), EVERY, "t").groupBy("netuid", "item").agg(F.count("*").alias("fetches"))
    return nine(rows.withColumn("hours", C.expected_hours(told(SECONDS), 501, told(EVERY))), "hours")


@query(f"""WITH {SILVER_SQL}, s AS (SELECT DISTINCT netuid, t, hotkey FROM us WHERE hotkey <> ''), p AS (SELECT netuid, t, lag(t) OVER (PARTITION BY netuid ORDER BY t) AS pt, count(*) AS n FROM s GROUP BY 1, 2),
shared AS (SELECT p.netuid, p.t, count(*) AS n FROM p JOIN s x ON x.netuid = p.netuid AND x.t = p.t JOIN s y ON y.netuid = p.netuid AND y.t = p.pt AND y.hotkey = x.hotkey GROUP BY 1, 2)
SELECT p.netuid, p.t, round(coalesce(shared.n, 0) / (p.n + q.n - coalesce(shared.n, 0)), 9) AS jaccard FROM p JOIN p q ON q.netuid = p.netuid AND q.t = p.pt LEFT JOIN shared ON shared.netuid = p.netuid AND shared.t = p.t""")
def names_jaccard(spark, d):
    sets = source.uid_state(spark, d).filter("hotkey <> ''").groupBy(*K).agg(F.collect_set("hotkey").alias("s"))
    rows = sets.withColumn("p", F.lag("s").over(Window.partitionBy("netuid").orderBy("t"))).filter("p is not null")
    return nine(rows.select(*K, G.jaccard(F.col("s"), F.col("p")).alias("jaccard")), "jaccard")
