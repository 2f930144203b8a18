"""Queries of exploits, checks, scoring, observability and the ranking, and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import exploits as E
from ..operators import market_panel as M
from ..operators import surveys as V
from ..sources import silver as source
from ..sources.silver import SILVER_SQL
from .panel_queries import CONTESTED, COPY, FLAGS, PAIRS
from .silver_queries import MEMBERS, SCORERS, SHARES, TIMED, K, frames, nine, query

#: A day is a snapshot: windows of three, segments of two. 0.05 is enough of a capture among rows that are noise.
LEAST = 0.05
COHORTS = """cd AS (SELECT netuid, unnest(range(3, n - 2)) AS t0, n FROM (SELECT netuid, max(t) + 1 AS n FROM tm GROUP BY 1)),
oc AS (SELECT netuid, t, occupant, sum(CASE WHEN is_miner THEN miner_emi_share ELSE 0 END) AS v FROM sh WHERE occupant <> '' GROUP BY 1, 2, 3),
co1 AS (SELECT cd.netuid, t0, n, occupant, sum(CASE WHEN t >= t0 THEN v ELSE 0 END) / (least(t0 + 3, n) - t0) AS a, sum(CASE WHEN t < t0 THEN v ELSE 0 END) / (t0 - greatest(t0 - 3, 0)) AS b FROM cd JOIN oc ON oc.netuid = cd.netuid AND t >= t0 - 3 AND t < t0 + 3 GROUP BY 1, 2, 3, 4),
co2 AS (SELECT co1.*, round(a - b, 12) AS gain, (SELECT greatest(count(*), 1) FROM mb WHERE is_miner AND mb.netuid = co1.netuid AND mb.t = t0) AS m FROM co1 WHERE round(a - b, 12) > 0),
co3 AS (SELECT *, row_number() OVER o AS nth, coalesce(sum(gain) OVER (PARTITION BY netuid, t0 ORDER BY gain DESC, occupant ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(gain) OVER (PARTITION BY netuid, t0) AS held FROM co2 WINDOW o AS (PARTITION BY netuid, t0 ORDER BY gain DESC, occupant)),
co AS (SELECT * FROM co3 WHERE nth <= greatest(1, floor(m * 0.2)) AND held < 0.5),
sc3 AS (SELECT netuid, t0, sum(gain) AS gain FROM co GROUP BY 1, 2),
cap AS (SELECT sc3.* FROM sc3 WHERE gain >= 0.05 AND (SELECT avg(k) FROM (SELECT count(*) FILTER (is_miner) AS k FROM mb WHERE mb.netuid = sc3.netuid AND mb.t >= t0 - 3 AND mb.t < t0 GROUP BY mb.t)) >= 3)"""
BASE = f"{SILVER_SQL}, {TIMED}, {MEMBERS}, {SHARES}"


@query(f"WITH {BASE}, {COHORTS} SELECT netuid, t0, occupant, round(gain, 9) AS share_gain, round(b, 9) AS before FROM co")
def exploit_cohorts(spark, d):
    rows, times, _ = frames(spark, d)
    return nine(E.cohorts(rows, E.candidates(times)).drop("m"), "share_gain", "before")


@query(f"WITH {BASE}, {COHORTS} SELECT netuid, t0, 2 AS min_seg, round(gain, 9) AS gain FROM cap")
def exploit_capture_scan(spark, d):
    rows, times, _ = frames(spark, d)
    return nine(E.capture_scan(rows, times, LEAST), "gain")


@query(f"""WITH {BASE}, {COHORTS}, fl AS (SELECT netuid, t, sum(emission / 1e9 * (interval_blocks / (tempo_v + 1))) AS al, sum(emission / 1e9 * (interval_blocks / (tempo_v + 1)) * coalesce(price, 0)) AS ta FROM mb JOIN tm USING (netuid, t) GROUP BY 1, 2),
g AS (SELECT cap.netuid, t0, (hours - lag(hours) OVER (PARTITION BY cap.netuid ORDER BY t0)) / 24 AS gap FROM cap JOIN tm ON tm.netuid = cap.netuid AND tm.t = t0),
e AS (SELECT netuid, count(*) AS n, quantile_cont(gap, 0.5) AS m, avg(CASE WHEN gap IS NOT NULL THEN CAST(gap BETWEEN 14 AND 28 AS INTEGER) END) AS s FROM g GROUP BY 1)
SELECT p.netuid, round(p.d, 9) AS period_days, coalesce(n, 0) AS n_incidents, coalesce(n, 0) AS n_capture_events, coalesce(n, 0) >= 2 AS recurring, round(m, 9) AS median_interval_days, round(s, 9) AS share_intervals_14_28d, round((SELECT sum(ta) FROM fl WHERE fl.netuid = p.netuid), 6) AS subnet_tao_flow_total, round((SELECT sum(al) FROM fl WHERE fl.netuid = p.netuid), 6) AS subnet_alpha_flow_total
FROM (SELECT netuid, any_value(period_days) AS d FROM tm GROUP BY 1) p LEFT JOIN e USING (netuid)""")
def exploit_recurrence(spark, d):
    rows, times, _ = frames(spark, d)
    events = E.capture_scan(rows, times, LEAST).select("netuid", "t0", F.lit("capture").alias("detector"))
    done = E.recurrence(events, times, rows)
    return nine(done.withColumn("subnet_tao_flow_total", F.round("subnet_tao_flow_total", 6)).withColumn("subnet_alpha_flow_total", F.round("subnet_alpha_flow_total", 6)), "period_days", "median_interval_days", "share_intervals_14_28d")


@query(f"""WITH {BASE}, {COHORTS}, mi AS (SELECT netuid, t, occupant, miner_emi_share AS s FROM sh WHERE is_miner),
ty AS (SELECT cap.netuid, t0, quantile_cont(s, 0.5) AS typical FROM cap JOIN mi ON mi.netuid = cap.netuid AND t >= t0 - 3 AND t < t0 GROUP BY 1, 2),
ba AS (SELECT co.netuid, co.t0, sum(greatest(b, typical)) AS base FROM co JOIN ty ON ty.netuid = co.netuid AND ty.t0 = co.t0 GROUP BY 1, 2),
fw AS (SELECT netuid, t, coalesce(sum(emission / 1e9 * (interval_blocks / (tempo_v + 1))) FILTER (is_miner), 0) AS al, coalesce(sum(emission / 1e9 * (interval_blocks / (tempo_v + 1)) * coalesce(price, 0)) FILTER (is_miner), 0) AS ta FROM mb JOIN tm USING (netuid, t) GROUP BY 1, 2),
pa AS (SELECT ba.*, tm.t, hours, al, ta, coalesce((SELECT sum(s) FROM mi JOIN co ON co.netuid = mi.netuid AND co.occupant = mi.occupant WHERE co.netuid = ba.netuid AND co.t0 = ba.t0 AND mi.t = tm.t), 0) AS cs FROM ba JOIN tm ON tm.netuid = ba.netuid AND tm.t >= ba.t0 JOIN fw ON fw.netuid = tm.netuid AND fw.t = tm.t),
pk AS (SELECT netuid, t0, max(cs) AS top FROM pa WHERE t < t0 + 3 GROUP BY 1, 2), pt AS (SELECT pa.netuid, pa.t0, any_value(top) AS top, min(t) FILTER (cs = top) AS t_peak FROM pa JOIN pk ON pk.netuid = pa.netuid AND pk.t0 = pa.t0 WHERE t < pa.t0 + 3 GROUP BY 1, 2),
lo AS (SELECT pa.*, t_peak, t >= t_peak AND cs <= base + 0.25 * (top - base) AS low FROM pa JOIN pt ON pt.netuid = pa.netuid AND pt.t0 = pa.t0),
ru AS (SELECT *, low AND coalesce(lead(low, 1) OVER o, false) AND coalesce(lead(low, 2) OVER o, false) AS run FROM lo WINDOW o AS (PARTITION BY netuid, t0 ORDER BY t)),
en AS (SELECT netuid, t0, min(t) FILTER (run) AS rec, max(t) AS last FROM ru GROUP BY 1, 2)
SELECT ru.netuid, ru.t0, round(any_value(base), 9) AS base, any_value(t_peak) AS t_peak, any_value(rec) IS NOT NULL AS recovered, round(max(hours) FILTER (t = coalesce(rec, last)) - max(hours) FILTER (t = ru.t0), 9) AS recovery_hours, round(sum(greatest(cs - base, 0) * al) FILTER (t <= coalesce(rec, last)), 9) AS at_risk_alpha, round(sum(greatest(cs - base, 0) * ta) FILTER (t <= coalesce(rec, last)), 9) AS at_risk_tao
FROM ru JOIN en ON en.netuid = ru.netuid AND en.t0 = ru.t0 GROUP BY 1, 2""")
def exploit_unwinding(spark, d):
    rows, times, _ = frames(spark, d)
    starts = E.capture_scan(rows, times, LEAST).select("netuid", "t0").join(E.windows(times), "netuid")
    done = E.unwinding(starts, E.cohorts(rows, starts.select("netuid", "t0", "w", "n")), rows, times, 0.75, 3)
    return nine(done, "base", "recovery_hours", "at_risk_alpha", "at_risk_tao")


def detected(spark, d):
    """Members, times, panel and events, each computed once: the plan of the records would otherwise hold the panel's many times."""
    rows, times, _ = frames(spark, d)
    rows, times = rows.cache(), times.cache()
    panel = M.miner_metrics(rows).join(times.select(*K, *M.HYPERPARAMETERS), K).cache()
    return rows, times, panel, E.detect(rows, panel, times, LEAST, scale=0.5, min_effect=0.3).cache()


@query()
def exploit_incidents(spark, d):
    """The incident records of the merged events. Change points are sequential, so there is no SQL; parts have theirs above."""
    rows, times, panel, events = detected(spark, d)
    return E.incidents(events, rows, panel, times, ["tempo", "kappa", "immunity_period"])


@query()
def exploit_summary(spark, d):
    rows, times, panel, events = detected(spark, d)
    found = E.incidents(events, rows, panel, times, ["tempo", "kappa", "immunity_period"]).cache()
    return E.summary(E.recurrence(events, times, rows), found)


CHECK = """k1 AS (SELECT netuid, t, count(*) FILTER (incentive IS NOT NULL) AS n, sum(vpermit) AS p, sum(emission) AS e FROM us GROUP BY 1, 2), k2 AS (SELECT *, coalesce(n <> lag(n) OVER (PARTITION BY netuid ORDER BY t), false) AS ch FROM k1),
k3 AS (SELECT netuid, count(*) FILTER (ch) AS uid_count_changes, CAST(max(p) AS INTEGER) AS max_validator_permits, count(*) FILTER (e = 0) AS zero_emission_snapshots FROM k2 GROUP BY 1),
k4 AS (SELECT netuid, count(*) AS snapshots, any_value(spacing_blocks) AS median_spacing_blocks, coalesce(max(gap), 0) AS max_gap_blocks, count(price) > 0 AS has_price, bool_or(owner_hotkey <> '') AS has_owner_hotkey, last(subnet_tao ORDER BY t) AS last_subnet_tao FROM (SELECT *, block - lag(block) OVER (PARTITION BY netuid ORDER BY t) AS gap FROM tm) GROUP BY 1),
k5 AS (SELECT netuid, max(uid) + 1 AS max_uids, bool_or(hotkey <> '') AS has_hotkeys, bool_or(reg_block IS NOT NULL) AS has_reg_block, sum(stake_weight) > 0 AS has_stake_weight FROM us GROUP BY 1),
ck AS (SELECT *, max_validator_permits > 0 AND weight_rows_seen >= 0.5 * max_validator_permits AS weights_look_complete FROM k4 JOIN k3 USING (netuid) JOIN k5 USING (netuid) JOIN (SELECT netuid, count(DISTINCT src) AS weight_rows_seen FROM wt GROUP BY 1) USING (netuid))"""


def checked(spark, d):
    return V.completeness(source.uid_state(spark, d), frames(spark, d)[1], source.weights(spark, d))


@query(f"WITH {SILVER_SQL}, {TIMED}, {CHECK} SELECT * FROM ck")
def checks_markets(spark, d):
    return checked(spark, d)


@query(f"""WITH {SILVER_SQL}, {TIMED}, {CHECK}, i AS (SELECT 'Keys missing' AS issue, count(*) FILTER (NOT has_hotkeys) AS markets FROM ck UNION ALL SELECT 'BlockAtRegistration missing', count(*) FILTER (NOT has_reg_block) FROM ck UNION ALL SELECT 'SubnetTAO/SubnetAlphaIn missing', count(*) FILTER (NOT has_price) FROM ck
UNION ALL SELECT 'StakeWeight missing', count(*) FILTER (NOT has_stake_weight) FROM ck UNION ALL SELECT 'SubnetOwnerHotkey missing', count(*) FILTER (NOT has_owner_hotkey) FROM ck UNION ALL SELECT 'Far fewer weight rows than validator permits', count(*) FILTER (NOT weights_look_complete) FROM ck
UNION ALL SELECT 'Snapshots without emission', count(*) FILTER (zero_emission_snapshots > 0) FROM ck UNION ALL SELECT 'Number of uids changes', count(*) FILTER (uid_count_changes > 0) FROM ck) SELECT * FROM i WHERE markets > 0""")
def checks_issues(spark, d):
    return V.issues(checked(spark, d))


@query(f"""WITH {SILVER_SQL}, {TIMED}, {MEMBERS}, {SCORERS}, {CONTESTED}, o1 AS (SELECT cn.*, consensus, count(*) OVER (PARTITION BY cn.netuid, cn.t) AS m, (SELECT max(t) + 1 FROM tm WHERE tm.netuid = cn.netuid) AS n FROM cn JOIN mb USING (netuid, t, uid)),
o2 AS (SELECT *, count(*) OVER (PARTITION BY netuid, t) AS k, row_number() OVER (PARTITION BY netuid, t ORDER BY consensus, uid) AS r FROM o1 WHERE t >= 1 AND (t - 1) % 3 = 0 AND t < n - 7 AND received >= 0.1 / m),
o3 AS (SELECT *, greatest(0, ceil((r - 1) * 5 / (k - 1)) - 1) AS bin, coalesce((SELECT bool_or(replaced) FROM mb x WHERE x.netuid = o2.netuid AND x.uid = o2.uid AND x.t > o2.t AND x.t <= o2.t + 7), false) AS gone FROM o2 WHERE k >= 5),
o4 AS (SELECT netuid, bin, avg(CAST(gone AS INTEGER)) FILTER (contested) AS a, avg(CAST(gone AS INTEGER)) FILTER (NOT contested) AS b FROM o3 GROUP BY 1, 2)
SELECT netuid, round(avg(a), 9) AS replace_rate_contested, round(avg(b), 9) AS replace_rate_uncontested, round(avg(a) - avg(b), 9) AS replace_rate_gap FROM o4 WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1""")
def scoring_replacement_gap(spark, d):
    rows, times, w = frames(spark, d)
    done = V.replacement_gap(rows, times, M.contested(rows, w))
    return nine(done, *done.columns[1:])


@query(f"""WITH {SILVER_SQL}, {MEMBERS}, {SHARES}, {SCORERS}, {FLAGS}, {PAIRS}, {CONTESTED},
s5 AS (SELECT netuid, t, count(*) AS nv, coalesce(sum(dividend_share) FILTER (stale), 0) AS sd, coalesce(sum(dividend_share) FILTER (copying), 0) AS cd, count(*) FILTER (NOT stale AND NOT copying) AS es FROM fl GROUP BY 1, 2),
a5 AS (SELECT netuid, t, CASE WHEN sum(influence) > 0 THEN sum(cosine * influence) / sum(influence) ELSE avg(cosine) END AS va FROM pp GROUP BY 1, 2),
v5 AS (SELECT mb.netuid, sum(emission / 1e9 * (interval_blocks / (tempo_v + 1)) * coalesce(price, 0)) FILTER (contested) AS ct, sum(emission / 1e9 * (interval_blocks / (tempo_v + 1))) FILTER (contested) AS ca, sum(emission / 1e9 * (interval_blocks / (tempo_v + 1))) AS al FROM mb JOIN tm USING (netuid, t) LEFT JOIN cn ON cn.netuid = mb.netuid AND cn.t = mb.t AND cn.uid = mb.uid GROUP BY 1)
SELECT s5.netuid, round(avg(nv), 9) AS mean_validators, round(avg(va), 9) AS validator_agreement, coalesce(avg(va) < 0.7, false) AS low_agreement, round(avg(least(sd + cd, 1)), 9) AS non_independent_div_share, round(avg(es / nullif(nv, 0)), 9) AS effective_scorer_ratio, round(coalesce(any_value(ct), 0), 6) AS contested_tao, round(coalesce(any_value(ca), 0), 6) AS contested_alpha, round(coalesce(any_value(ca), 0) / any_value(al), 9) AS contested_subnet_share
FROM s5 LEFT JOIN a5 USING (netuid, t) JOIN v5 ON v5.netuid = s5.netuid GROUP BY 1""")
def scoring_markets(spark, d):
    rows, times, w = frames(spark, d)
    rows, times, w = rows.cache(), times.cache(), w.cache()
    done = V.scoring(M.scorer_metrics(rows, times, w, **COPY).cache(), rows, times, M.contested(rows, w).cache())
    done = done.select("netuid", "mean_validators", "validator_agreement", "low_agreement", "non_independent_div_share", "effective_scorer_ratio", F.round("contested_tao", 6).alias("contested_tao"), F.round("contested_alpha", 6).alias("contested_alpha"), "contested_subnet_share")
    return nine(done, "mean_validators", "validator_agreement", "non_independent_div_share", "effective_scorer_ratio", "contested_subnet_share")


LIKE = """z1 AS (SELECT netuid, t, t // 14 AS wd, count(*) OVER (PARTITION BY netuid, t // 14) AS n FROM tm), z2 AS (SELECT sh.netuid, wd, sh.uid, any_value(n) AS n, count(*) AS k, count(*) FILTER (replaced AND sh.t > wd * 14) AS nw, avg(miner_emi_share) AS s FROM sh JOIN z1 USING (netuid, t) WHERE is_miner AND n >= 10 GROUP BY 1, 2, 3),
z3 AS (SELECT *, count(*) OVER (PARTITION BY netuid, wd) AS m FROM z2 WHERE k = n AND nw = 0), z4 AS (SELECT *, count(*) OVER (PARTITION BY netuid, wd) AS m2 FROM z3 WHERE s >= 0.1 / m),
l1 AS (SELECT netuid, t, uid, ln(miner_emi_share + 1e-6) AS l FROM sh WHERE is_miner), l2 AS (SELECT *, l - (SELECT quantile_cont(y.l, 0.5) FROM l1 y WHERE y.netuid = l1.netuid AND y.t = l1.t) AS level FROM l1),
x1 AS (SELECT l2.netuid, l2.t, z4.wd, l2.uid, level - avg(level) OVER (PARTITION BY l2.netuid, z4.wd, l2.uid) AS x FROM l2 JOIN z1 ON z1.netuid = l2.netuid AND z1.t = l2.t JOIN z4 ON z4.netuid = l2.netuid AND z4.wd = z1.wd AND z4.uid = l2.uid WHERE m2 >= 3),
lk2 AS (SELECT a.netuid, a.wd AS "window", a.uid AS a, b.uid AS b, coalesce(sum(a.x * b.x) / nullif(sqrt(sum(a.x * a.x) * sum(b.x * b.x)), 0), 0) AS similarity FROM x1 a JOIN x1 b ON a.netuid = b.netuid AND a.t = b.t AND a.wd = b.wd AND a.uid < b.uid GROUP BY 1, 2, 3, 4)"""


@query(f"WITH {BASE}, {LIKE} SELECT netuid, \"window\", a, b, round(similarity, 7) AS similarity FROM lk2")
def telemetry_likeness(spark, d):
    rows, times, _ = frames(spark, d)
    return V.likeness(rows, times).withColumn("similarity", F.round("similarity", 7))


@query(f"""WITH {BASE}, {LIKE}, u AS (SELECT netuid, "window", unnest([a, b]) AS uid, similarity FROM lk2), e AS (SELECT netuid, "window", uid, max(similarity) >= 0.3 AS f FROM u GROUP BY 1, 2, 3), w AS (SELECT netuid, avg(CAST(f AS INTEGER)) AS d FROM e GROUP BY netuid, "window")
SELECT netuid, round(avg(d), 9) AS indistinguishable_share, round(1 - avg(d), 9) AS observability FROM w GROUP BY 1""")
def telemetry_observability(spark, d):
    rows, times, _ = frames(spark, d)
    return nine(V.observability(V.likeness(rows, times), same=0.3), "indistinguishable_share", "observability")


@query(f"""WITH {SILVER_SQL}, p AS (SELECT netuid AS problem, count(*) FILTER (t % 3 = 0) / count(*) * (1 + length(netuid) % 3) / 2 AS size_value, CAST(sum(burn_cost) AS BIGINT) % 97 / 20.0 AS impact_pct FROM sn GROUP BY 1),
bd AS (SELECT *, 1 + (size_value >= 0.05)::INT + (size_value >= 0.15)::INT + (size_value >= 0.3)::INT + (size_value >= 0.5)::INT AS size_score, 1 + (impact_pct >= 0.1)::INT + (impact_pct >= 0.5)::INT + (impact_pct >= 1.0)::INT + (impact_pct >= 3.0)::INT AS impact_score FROM p)
SELECT problem, round(size_value, 9) AS size_value, round(impact_pct, 9) AS impact_pct, size_score, impact_score, size_score * impact_score AS priority, row_number() OVER (ORDER BY size_score * impact_score DESC, impact_pct DESC, problem) AS rank FROM bd""")
def ranking_problems(spark, d):
    s = source.snapshots(spark, d)
    p = s.groupBy(F.col("netuid").alias("problem")).agg((F.count_if(F.col("t") % 3 == 0) / F.count("*") * (1 + F.length(F.first("netuid")) % 3) / 2).alias("size_value"), (F.sum("burn_cost") % 97 / 20.0).alias("impact_pct"))
    return nine(V.ranking(p), "size_value", "impact_pct")


