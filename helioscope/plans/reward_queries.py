"""Queries of reward spikes and mechanism types, and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rewards as R
from ..sources.silver import SILVER_SQL
from .silver_queries import MEMBERS, SCORERS, SHARES, TIMED, K, frames, nine, query

#: In the adapter's markets a day is a snapshot, so three days are three. Spikes are lowered to one deviation: rows are noise.
SPIKE = {"z": 1.0, "gain": 0.3}

SUPPORT = """h1 AS (SELECT netuid, t, src, uid, w / greatest(CAST(sum(w) OVER r AS DOUBLE), 1e-12) AS s, count(*) OVER r AS n FROM gr WINDOW r AS (PARTITION BY netuid, t, src)),
h2 AS (SELECT netuid, t, uid, quantile_cont(s, 0.5) AS median, avg(CASE WHEN s >= 1 / n THEN 1.0 ELSE 0.0 END) AS breadth FROM h1 GROUP BY 1, 2, 3),
sp AS (SELECT netuid, t, uid, coalesce(median / nullif(sum(median) OVER k, 0), 0) AS support, breadth, coalesce(consensus / nullif(sum(consensus) OVER k, 0), 0) AS agreed FROM h2 JOIN mb USING (netuid, t, uid) WINDOW k AS (PARTITION BY netuid, t))"""
CELLS = f"""{SUPPORT}, nm AS (SELECT netuid, t, greatest(count(*) FILTER (is_miner), 1) AS n_miners FROM mb GROUP BY 1, 2),
c1 AS (SELECT tm.netuid, tm.t, u.uid, n_miners, coalesce(sh.miner_emi_share, 0) AS share, coalesce(sh.is_miner, false) AS miner, coalesce(CAST(sh.replaced AS INTEGER), 0) AS new, coalesce(support, 0) AS support, coalesce(agreed, 0) AS agreed, coalesce(breadth, 0) AS breadth
  FROM tm JOIN (SELECT DISTINCT netuid, uid FROM mb) u USING (netuid) JOIN nm ON nm.netuid = tm.netuid AND nm.t = tm.t LEFT JOIN sh ON sh.netuid = tm.netuid AND sh.t = tm.t AND sh.uid = u.uid LEFT JOIN sp ON sp.netuid = tm.netuid AND sp.t = tm.t AND sp.uid = u.uid),
c2 AS (SELECT *, CASE WHEN count(*) OVER f >= 3 THEN avg(share) OVER f END AS mean_share, CASE WHEN count(*) OVER f >= 3 THEN avg(support) OVER f END AS mean_support, CASE WHEN count(*) OVER f >= 3 THEN avg(agreed) OVER f END AS mean_agreed, CASE WHEN count(*) OVER f >= 3 THEN avg(breadth) OVER f END AS mean_breadth,
  CASE WHEN count(*) OVER f >= 3 THEN stddev_samp(share) OVER f END AS sd, sum(new) OVER (PARTITION BY netuid, uid ORDER BY t ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS resets FROM c1 WINDOW f AS (PARTITION BY netuid, uid ORDER BY t ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)),
ce AS (SELECT *, (share - mean_share) / greatest(coalesce(sd, 0), 0.1 / n_miners) AS z, coalesce((share - mean_share) / greatest(coalesce(sd, 0), 0.1 / n_miners) >= 1 AND share - mean_share >= 0.3 / n_miners AND resets = 0 AND miner, false) AS spike FROM c2)"""
EVENTS = f"""{CELLS}, fw AS (SELECT netuid, t, coalesce(sum(emission / 1e9 * (interval_blocks / (tempo_v + 1))) FILTER (is_miner), 0) AS alpha, coalesce(sum(emission / 1e9 * (interval_blocks / (tempo_v + 1)) * coalesce(price, 0)) FILTER (is_miner), 0) AS tao FROM mb JOIN tm USING (netuid, t) GROUP BY 1, 2),
e1 AS (SELECT netuid, uid, t, CASE WHEN t - lag(t) OVER o <= 2 THEN 0 ELSE 1 END AS g FROM ce WHERE spike WINDOW o AS (PARTITION BY netuid, uid ORDER BY t)), e2 AS (SELECT *, sum(g) OVER (PARTITION BY netuid, uid ORDER BY t) AS s FROM e1),
e3 AS (SELECT netuid, uid, min(t) AS t_start, max(t) AS t_end FROM e2 GROUP BY netuid, uid, s),
e4 AS (SELECT e3.*, b.mean_share AS b_share, b.mean_support AS b_support, b.mean_agreed AS b_agreed, b.mean_breadth AS b_breadth, (SELECT c.t FROM ce c WHERE c.netuid = e3.netuid AND c.uid = e3.uid AND c.t BETWEEN t_start AND t_end ORDER BY c.share DESC, c.t LIMIT 1) AS t_peak FROM e3 JOIN ce b ON b.netuid = e3.netuid AND b.uid = e3.uid AND b.t = t_start),
e5 AS (SELECT e4.*, p.share, p.support, p.agreed, p.breadth, p.z, p.n_miners, (SELECT max(t) FROM tm WHERE tm.netuid = e4.netuid) AS last FROM e4 JOIN ce p ON p.netuid = e4.netuid AND p.uid = e4.uid AND p.t = t_peak),
ev AS (SELECT e5.*, e5.share - b_share AS de, e5.support - b_support AS dm, a.occupant, coalesce(z.occupant = a.occupant AND cz.share - b_share >= 0.5 * (e5.share - b_share), false) AS sustained,
  (SELECT sum(greatest(c.share - b_share, 0) * alpha) FROM ce c JOIN fw USING (netuid, t) WHERE c.netuid = e5.netuid AND c.uid = e5.uid AND c.t BETWEEN t_start AND t_end) AS excess_alpha,
  (SELECT sum(greatest(c.share - b_share, 0) * tao) FROM ce c JOIN fw USING (netuid, t) WHERE c.netuid = e5.netuid AND c.uid = e5.uid AND c.t BETWEEN t_start AND t_end) AS excess_tao
  FROM e5 LEFT JOIN mb a ON a.netuid = e5.netuid AND a.uid = e5.uid AND a.t = t_start LEFT JOIN mb z ON z.netuid = e5.netuid AND z.uid = e5.uid AND z.t = least(last, t_end + 3) LEFT JOIN (SELECT netuid, uid, t, share FROM ce) cz ON cz.netuid = e5.netuid AND cz.uid = e5.uid AND cz.t = least(last, t_end + 3))"""
BASE = f"{SILVER_SQL}, {TIMED}, {MEMBERS}, {SHARES}, {SCORERS}"


def found(spark, d):
    rows, times, w = frames(spark, d)
    cells = R.spikes(rows, times, w, **SPIKE).cache()
    return R.events(cells, rows, times), rows, times, w


@query(f"WITH {BASE}, {CELLS} SELECT netuid, t, uid, round(share, 9) AS share, round(mean_share, 9) AS mean_share, round(z, 6) AS z, spike FROM ce")
def reward_spikes(spark, d):
    rows, times, w = frames(spark, d)
    cells = R.spikes(rows, times, w, **SPIKE).select(*K, "uid", "share", "mean_share", F.round("z", 6).alias("z"), "spike")
    return nine(cells, "share", "mean_share")


@query(f"""WITH {BASE}, {EVENTS} SELECT ev.netuid, uid, occupant, t_start, t_peak, t_end, round(h.hours, 9) AS hours_start, round(i.hours - h.hours, 9) AS duration_hours, round(z, 6) AS z_peak, round(de, 9) AS emission_gain, round(dm, 9) AS median_support_gain, round(agreed - b_agreed, 9) AS consensus_gain, round(breadth - b_breadth, 9) AS breadth_gain,
round(CASE WHEN de > 0 THEN dm / de END, 6) AS support_ratio, round(share - agreed, 9) AS divergence_consensus_peak, round(share - support, 9) AS divergence_support_peak, de > 0 AND dm < 0.5 * de AS unsupported, sustained, round(excess_alpha, 9) AS excess_alpha, round(excess_tao, 9) AS excess_tao
FROM ev JOIN tm h ON h.netuid = ev.netuid AND h.t = t_start JOIN tm i ON i.netuid = ev.netuid AND i.t = t_end""")
def reward_events(spark, d):
    ev = found(spark, d)[0].drop("length", "n_miners").withColumn("z_peak", F.round("z_peak", 6)).withColumn("support_ratio", F.round("support_ratio", 6))
    plain = {"netuid", "uid", "occupant", "t_start", "t_peak", "t_end", "unsupported", "sustained", "z_peak", "support_ratio"}
    return nine(ev, *[c for c in ev.columns if c not in plain])


@query(f"""WITH {BASE}, {EVENTS}, pt AS (SELECT wt.netuid, wt.t, wt.src, wt.dest AS uid, wt.w / rw."row" AS s FROM wt JOIN rw USING (netuid, t, src)),
a AS (SELECT ev.netuid, ev.uid, t_start, n_miners, sc.src, influence, coalesce(pt.s, 0) AS now, CASE WHEN t_start > 0 THEN coalesce((SELECT sum(s) FROM pt b WHERE b.netuid = ev.netuid AND b.uid = ev.uid AND b.src = sc.src AND b.t < t_start AND b.t >= t_start - 3), 0) / least(t_start, 3) ELSE coalesce(pt.s, 0) END AS base
  FROM ev JOIN sc ON sc.netuid = ev.netuid AND sc.t = t_peak LEFT JOIN pt ON pt.netuid = ev.netuid AND pt.t = t_peak AND pt.src = sc.src AND pt.uid = ev.uid),
bo AS (SELECT *, now - base >= greatest(1 / n_miners, 2 * avg(base) OVER (PARTITION BY netuid, uid, t_start)) AS boost FROM a)
SELECT netuid, uid, t_start, count(*) FILTER (boost) AS boosting_validators, round(coalesce(sum(influence) FILTER (boost), 0) / nullif(sum(influence), 0), 9) AS boosting_stake_share FROM bo GROUP BY 1, 2, 3""")
def reward_boosters(spark, d):
    ev, rows, _, w = found(spark, d)
    return nine(R.boosters(ev, rows, w), "boosting_stake_share")


REPEAT = """rp1 AS (SELECT netuid, occupant, count(*) AS spikes, count(*) FILTER (de > 0 AND dm < 0.5 * de) AS unsupported_spikes, coalesce(sum(excess_alpha) FILTER (de > 0 AND dm < 0.5 * de), 0) AS unsupported_excess_alpha FROM ev GROUP BY 1, 2),
rp AS (SELECT rp1.*, coalesce(n, 0) AS exposure_snapshots FROM rp1 LEFT JOIN (SELECT netuid, occupant, count(*) AS n FROM mb WHERE is_miner GROUP BY 1, 2) USING (netuid, occupant))"""


@query(f"WITH {BASE}, {EVENTS}, {REPEAT} SELECT netuid, occupant, round(unsupported_excess_alpha, 9) AS unsupported_excess_alpha, exposure_snapshots, spikes, unsupported_spikes, unsupported_spikes >= 2 AS repeat_offender FROM rp")
def reward_repetition(spark, d):
    """Events of one slot begin three snapshots apart or more, a day is one, and an occupant holds one slot: all are counted."""
    ev, rows, times, _ = found(spark, d)
    return nine(R.repetition(ev, rows, times), "unsupported_excess_alpha")


@query(f"""WITH {BASE}, {EVENTS}, {REPEAT}, ab AS (SELECT netuid, occupant, count(*) AS n FROM sh WHERE is_miner GROUP BY 1, 2 HAVING count(*) >= 6 AND avg(miner_emi_share) > 0),
k AS (SELECT ab.*, coalesce(unsupported_spikes, 0) AS k FROM ab LEFT JOIN rp USING (netuid, occupant)), e AS (SELECT *, sum(k) OVER (PARTITION BY netuid) / sum(n) OVER (PARTITION BY netuid) * n AS e FROM k)
SELECT netuid, count(*) AS miners, CAST(sum(k) AS BIGINT) AS events, round(CASE WHEN sum(k) >= 5 AND count(*) >= 5 THEN sum((k - e) * (k - e) / nullif(e, 0)) END, 6) AS chi2 FROM e GROUP BY 1""")
def reward_concentration(spark, d):
    ev, rows, times, _ = found(spark, d)
    return R.concentration(R.repetition(ev, rows, times), rows, times).select("netuid", "miners", "events", F.round("chi2", 6).alias("chi2"))


@query(f"""WITH {SILVER_SQL}, {MEMBERS}, {SHARES}, r AS (SELECT *, CASE WHEN count(*) OVER k > 1 THEN (rank() OVER (PARTITION BY netuid, t ORDER BY miner_emi_share) + (count(*) OVER (PARTITION BY netuid, t, miner_emi_share) - 1) / 2 - 1) / (count(*) OVER k - 1) ELSE 0 END AS pct FROM sh WHERE is_miner WINDOW k AS (PARTITION BY netuid, t)),
m AS (SELECT a.netuid, a.t, avg(abs(a.pct - b.pct)) AS c FROM r a JOIN r b ON a.netuid = b.netuid AND a.uid = b.uid AND b.t = a.t - 1 AND NOT a.replaced GROUP BY 1, 2), x AS (SELECT netuid, avg(c) AS rank_churn FROM m GROUP BY 1),
tp AS (SELECT netuid, t, occupant FROM (SELECT *, row_number() OVER (PARTITION BY netuid, t ORDER BY miner_emi_share DESC, uid) AS n FROM sh) WHERE n <= 10), y AS (SELECT d.netuid, d.t, 1 - (SELECT count(DISTINCT q.occupant) FROM tp q JOIN tp p ON p.netuid = q.netuid AND p.t = q.t - 1 AND p.occupant = q.occupant WHERE q.netuid = d.netuid AND q.t = d.t) / 10 AS v FROM (SELECT DISTINCT netuid, t FROM tp WHERE t > 0) d)
SELECT netuid, round(rank_churn, 9) AS rank_churn, round(avg(v), 9) AS topk_turnover FROM x JOIN y USING (netuid) GROUP BY netuid, rank_churn""")
def reward_churn(spark, d):
    return nine(R.churn(frames(spark, d)[0]), "rank_churn", "topk_turnover")


EACH = """ea AS (SELECT netuid, t, count(*) FILTER (is_miner) AS n, max(miner_emi_share) AS a, sum(miner_emi_share) FILTER (i <= 10) AS b, sum(miner_emi_share * miner_emi_share) AS c, coalesce(sum(inc_share) FILTER (uid = owner_uid), 0) AS d FROM (SELECT *, row_number() OVER (PARTITION BY netuid, t ORDER BY miner_emi_share DESC, uid) AS i FROM sh) GROUP BY 1, 2)"""


@query(f"""WITH {SILVER_SQL}, {MEMBERS}, {SHARES}, {EACH}, m AS (SELECT netuid, quantile_cont(a, 0.5) FILTER (c > 0) AS top1_share, quantile_cont(b, 0.5) FILTER (c > 0) AS top10_share, quantile_cont(1 / greatest(c, 1e-12), 0.5) FILTER (c > 0) AS effective_miners, quantile_cont(d, 0.5) AS burn_share FROM ea GROUP BY 1)
SELECT netuid, round(top1_share, 9) AS top1_share, round(top10_share, 9) AS top10_share, round(effective_miners, 9) AS effective_miners, round(burn_share, 9) AS burn_share, CASE WHEN burn_share >= 0.1 THEN 'burn_dominated' WHEN top1_share >= 0.3 THEN 'winner_take_all' WHEN top10_share >= 0.7 THEN 'concentrated' ELSE 'distributed' END AS mechanism_type FROM m""")
def reward_mechanism(spark, d):
    return nine(R.mechanism(frames(spark, d)[0], burn=0.1, top1=0.3), "top1_share", "top10_share", "effective_miners", "burn_share")


@query(f"""WITH {SILVER_SQL}, {MEMBERS}, {SHARES}, {EACH}, k AS (SELECT *, CASE WHEN n = 0 THEN 'no_paid_miners' WHEN d >= 0.1 THEN 'burn_dominated' WHEN a >= 0.3 THEN 'winner_take_all' WHEN b >= 0.7 THEN 'concentrated' ELSE 'distributed' END AS kind FROM ea),
q AS (SELECT netuid, kind, count(*) AS k, count(*) / sum(count(*)) OVER (PARTITION BY netuid) AS part FROM k GROUP BY 1, 2), f AS (SELECT netuid, first(kind ORDER BY k DESC, kind) AS main, first(part ORDER BY k DESC, kind) AS part, string_agg(kind || ' ' || CAST(round_even(part * 100, 0) AS INTEGER) || '%', ' · ' ORDER BY k DESC, kind) AS type_breakdown FROM q GROUP BY 1),
m AS (SELECT netuid, quantile_cont(n, 0.5) AS n, quantile_cont(d, 0.5) AS d, quantile_cont(a, 0.5) FILTER (n > 0) AS a, quantile_cont(b, 0.5) FILTER (n > 0) AS b, quantile_cont(1 / nullif(c, 0), 0.5) FILTER (n > 0) AS e FROM k GROUP BY 1)
SELECT netuid, CASE WHEN part < 0.6 THEN 'mixed' ELSE main END AS mechanism_type, round(part, 2) AS type_stability, main AS main_snapshot_type, type_breakdown, n AS median_working_miners, round(d, 9) AS median_burn_share, round(a, 9) AS median_top1_share, round(b, 9) AS median_top10_share, round(e, 9) AS median_effective_miners FROM f JOIN m USING (netuid)""")
def market_types(spark, d):
    done = R.classify(frames(spark, d)[0], burn=0.1, top1=0.3)
    return nine(done, "median_burn_share", "median_top1_share", "median_top10_share", "median_effective_miners")


@query(f"""WITH {BASE}, {EVENTS}, {REPEAT}, {EACH}, m AS (SELECT netuid, quantile_cont(a, 0.5) FILTER (c > 0) AS x, quantile_cont(b, 0.5) FILTER (c > 0) AS y, quantile_cont(d, 0.5) AS z FROM ea GROUP BY 1),
ty AS (SELECT netuid, CASE WHEN z >= 0.1 THEN 'burn_dominated' WHEN x >= 0.3 THEN 'winner_take_all' WHEN y >= 0.7 THEN 'concentrated' ELSE 'distributed' END AS mechanism_type FROM m),
o AS (SELECT rp.*, mechanism_type, (sum(unsupported_spikes) OVER k - unsupported_spikes + 1) / (sum(spikes) OVER k - spikes + 2) AS q FROM rp JOIN ty USING (netuid) WINDOW k AS (PARTITION BY mechanism_type)),
p AS (SELECT *, CASE WHEN unsupported_spikes <= 0 THEN 1.0 ELSE list_sum(list_transform(range(unsupported_spikes, spikes + 1), lambda i: exp(lgamma(spikes + 1) - lgamma(i + 1) - lgamma(spikes - i + 1) + CASE WHEN i > 0 THEN i * ln(q) ELSE 0 END + CASE WHEN spikes > i THEN (spikes - i) * ln(1 - q) ELSE 0 END))) END AS pv FROM o)
SELECT netuid, occupant, mechanism_type, spikes, unsupported_spikes, round(q, 9) AS others_rate, round(pv, 6) AS systematic_p_value, pv < 0.01 AND unsupported_spikes >= 2 AS systematic_offender FROM p""")
def reward_systematic(spark, d):
    ev, rows, times, _ = found(spark, d)
    done = R.systematic(R.repetition(ev, rows, times), R.mechanism(rows, burn=0.1, top1=0.3))
    return nine(done.select("netuid", "occupant", "mechanism_type", "spikes", "unsupported_spikes", "others_rate", F.round("systematic_p_value", 6).alias("systematic_p_value"), "systematic_offender"), "others_rate")
