"""Queries of members that behave alike, each beside the SQL that says the same. Windows of 14 days, every 7."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import communities as C
from ..operators import silver as S
from ..sources.silver import SILVER_SQL
from .silver_queries import MEMBERS, SHARES, TIMED, frames, nine, query

#: Layers in equal parts. Members of these tables are noise, so pairs are joined from 0.2 on, far below what an analysis would ask.
WEIGHTS, ALIKE = {"trajectory": 1.0, "emission_change": 1.0}, 0.2

SPANS = """w0 AS (SELECT netuid, greatest(1, CAST(round_even(14 * 86400.0 / any_value(spacing_blocks) / 12, 0) AS INTEGER)) AS w, greatest(1, CAST(round_even(7 * 86400.0 / any_value(spacing_blocks) / 12, 0) AS INTEGER)) AS s, max(t) + 1 AS n FROM tm GROUP BY 1),
w1 AS (SELECT netuid, unnest(CASE WHEN n >= w THEN range(0, n - w + 1, s) WHEN n >= 10 THEN [0] ELSE [] END) AS a, w, n FROM w0),
wi AS (SELECT netuid, row_number() OVER (PARTITION BY netuid ORDER BY a) - 1 AS "window", a, least(a + w, n) AS b FROM w1)"""
CHOSEN = f"""{TIMED}, {MEMBERS}, {SHARES}, {SPANS}, pl AS (SELECT netuid, "window", uid, occupant AS last FROM sh JOIN wi USING (netuid) WHERE t = b - 1),
pr AS (SELECT netuid, "window", t, uid, a, b, miner_emi_share, is_miner AND occupant = last AND last <> '' AS present FROM sh JOIN wi USING (netuid) JOIN pl USING (netuid, "window", uid) WHERE t >= a AND t < b),
nm AS (SELECT netuid, "window", greatest(count(*) FILTER (is_miner), 1) AS m FROM sh JOIN wi USING (netuid) WHERE t = b - 1 GROUP BY 1, 2),
c1 AS (SELECT netuid, "window", uid, count(*) FILTER (present) / any_value(b - a) AS presence, coalesce(avg(miner_emi_share) FILTER (present), 0) AS mean_share FROM pr GROUP BY 1, 2, 3),
ca AS (SELECT c1.* FROM c1 JOIN nm USING (netuid, "window") WHERE presence >= 0.6 AND mean_share >= 0.1 / m)"""
PAIRS = f"""{CHOSEN}, lg AS (SELECT netuid, t, uid, ln(miner_emi_share + 1e-6) AS l FROM sh WHERE is_miner), md AS (SELECT netuid, t, quantile_cont(l, 0.5) AS m FROM lg GROUP BY 1, 2),
gd AS (SELECT ca.netuid, ca."window", ca.uid, tm.t, CASE WHEN present THEN l - m END AS v FROM ca JOIN wi USING (netuid, "window") JOIN tm ON tm.netuid = ca.netuid AND tm.t >= a AND tm.t < b
  LEFT JOIN pr ON pr.netuid = ca.netuid AND pr."window" = ca."window" AND pr.uid = ca.uid AND pr.t = tm.t LEFT JOIN lg ON lg.netuid = ca.netuid AND lg.t = tm.t AND lg.uid = ca.uid LEFT JOIN md ON md.netuid = ca.netuid AND md.t = tm.t),
gx AS (SELECT *, coalesce(v, avg(v) OVER (PARTITION BY netuid, "window", uid)) AS x FROM gd),
gy AS (SELECT netuid, "window", uid, t, x, CASE WHEN lag(t) OVER o IS NULL THEN NULL WHEN v IS NOT NULL AND lag(v) OVER o IS NOT NULL THEN x - lag(x) OVER o ELSE 0 END AS d FROM gx WINDOW o AS (PARTITION BY netuid, "window", uid ORDER BY t)),
pp AS (SELECT p.netuid, p."window", p.uid AS a, q.uid AS b, CASE WHEN var_pop(p.x) <= 1e-12 OR var_pop(q.x) <= 1e-12 THEN 0 ELSE covar_pop(p.x, q.x) / sqrt(var_pop(p.x) * var_pop(q.x)) END AS trajectory,
  CASE WHEN var_pop(p.d) <= 1e-12 OR var_pop(q.d) <= 1e-12 THEN 0 ELSE covar_pop(p.d, q.d) / sqrt(var_pop(p.d) * var_pop(q.d)) END AS emission_change
  FROM gy p JOIN gy q ON q.netuid = p.netuid AND q."window" = p."window" AND q.t = p.t AND p.uid < q.uid GROUP BY 1, 2, 3, 4),
cc AS (SELECT netuid, "window", a, b, CASE WHEN count(*) OVER o = 1 THEN trajectory WHEN avg(trajectory) OVER o >= 1 THEN 0 ELSE greatest(0, least(1, (trajectory - avg(trajectory) OVER o) / (1 - avg(trajectory) OVER o))) END AS trajectory, emission_change FROM pp WINDOW o AS (PARTITION BY netuid, "window")),
cb AS (SELECT netuid, "window", a, b, (greatest(0, least(1, trajectory)) + greatest(0, least(1, emission_change))) / 2 AS similarity, CAST(trajectory >= 0.8 AS INTEGER) + CAST(emission_change >= 0.8 AS INTEGER) AS strong FROM pp)"""
GROUPS = f"""{PAIRS}, eg AS (SELECT netuid, "window", a, b FROM cb WHERE similarity >= {ALIKE} UNION ALL SELECT netuid, "window", b, a FROM cb WHERE similarity >= {ALIKE}),
re AS (SELECT netuid, "window", uid, uid AS other FROM ca UNION SELECT re.netuid, re."window", re.uid, eg.b FROM re JOIN eg ON eg.netuid = re.netuid AND eg."window" = re."window" AND eg.a = re.other),
gr AS (SELECT netuid, "window", uid, min(other) AS root FROM re GROUP BY 1, 2, 3)"""


def found(spark, d):
    """(rows, times, spans, candidates)."""
    members, times, _ = frames(spark, d)
    rows, spans = S.shares(members), C.windows(times, 14, 7)
    return rows, times, spans, C.candidates(rows, spans)


def grouped(spark, d):
    rows, times, spans, chosen = found(spark, d)
    alike = C.combined(C.share_layers(rows, times, spans, chosen), WEIGHTS).filter(F.col("similarity") >= ALIKE)
    return C.components(chosen, alike, C.WINDOW)


@query(f'WITH {SILVER_SQL}, {TIMED}, {SPANS} SELECT netuid, "window", a, b FROM wi')
def community_windows(spark, d):
    return C.windows(frames(spark, d)[1], 14, 7)


@query(f'WITH {SILVER_SQL}, {CHOSEN} SELECT netuid, "window", uid, round(presence, 9) AS presence, round(mean_share, 9) AS mean_share FROM ca')
def community_candidates(spark, d):
    return nine(found(spark, d)[3], "presence", "mean_share")


@query(f'WITH {SILVER_SQL}, {PAIRS} SELECT netuid, "window", a, b, round(trajectory, 9) AS trajectory, round(emission_change, 9) AS emission_change FROM pp')
def community_layers(spark, d):
    return nine(C.share_layers(*found(spark, d)), "trajectory", "emission_change")


@query(f'WITH {SILVER_SQL}, {PAIRS} SELECT netuid, "window", a, b, round(trajectory, 9) AS trajectory FROM cc')
def community_chance(spark, d):
    return nine(C.chance_corrected(C.share_layers(*found(spark, d)), "trajectory").drop("emission_change"), "trajectory")


@query(f'WITH {SILVER_SQL}, {PAIRS} SELECT netuid, "window", a, b, round(similarity, 9) AS similarity, strong FROM cb')
def community_combined(spark, d):
    return nine(C.combined(C.share_layers(*found(spark, d)), WEIGHTS).drop("trajectory", "emission_change"), "similarity")


@query(f'WITH RECURSIVE {SILVER_SQL}, {GROUPS} SELECT netuid, "window", uid, root FROM gr')
def community_components(spark, d):
    return grouped(spark, d)


@query(f'WITH RECURSIVE {SILVER_SQL}, {GROUPS} SELECT netuid, "window", round(count(DISTINCT root) / count(*), 9) AS distinct_ratio FROM gr GROUP BY 1, 2')
def community_distinct(spark, d):
    """Groups over members: 1 where no two members behave alike."""
    return nine(grouped(spark, d).groupBy(*C.WINDOW).agg((F.count_distinct("root") / F.count("*")).alias("distinct_ratio")), "distinct_ratio")
