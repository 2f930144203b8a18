"""The panel's queries, a group of metrics each, and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import market_panel as M
from ..sources.silver import SILVER_SQL
from .silver_queries import MEMBERS, SCORERS, SHARES, TIMED, K, frames, nine, query

#: The queries' own limits, so that their flags differ from snapshot to snapshot: rows here are noise, which never reaches 0.99.
COPY = {"copy_similarity": 0.6, "copy_persistence": 0.5}

FLAGS = f"""{TIMED}, cp AS (SELECT netuid, t, uid AS dest, consensus AS c, lag(consensus) OVER s AS lc, lag(t) OVER s AS lt FROM mb WINDOW s AS (PARTITION BY netuid, uid ORDER BY t)),
c2 AS (SELECT netuid, t, dest, c, CASE WHEN lt = t - 1 THEN lc WHEN t > 0 THEN 0 ELSE c END AS p FROM cp), nm AS (SELECT netuid, t, sqrt(sum(c * c)) AS nc, sqrt(sum(p * p)) AS np FROM c2 GROUP BY 1, 2),
lk AS (SELECT netuid, t, src, sqrt(sum(w * w)) AS nw, CAST(sum(w * coalesce(c, 0)) AS DOUBLE) AS wc, CAST(sum(w * coalesce(p, 0)) AS DOUBLE) AS wp FROM wt LEFT JOIN c2 USING (netuid, t, dest) GROUP BY 1, 2, 3),
l2 AS (SELECT netuid, t, src, wp / (nw * CASE WHEN np > 0 THEN np ELSE 1 END) AS sp, wc / (nw * CASE WHEN nc > 0 THEN nc ELSE 1 END) AS so FROM lk JOIN nm USING (netuid, t)),
f1 AS (SELECT sc.netuid, sc.t, sc.src, influence, mb.dividends, mb.vtrust, coalesce(block - last_update > 2 * tempo_v, true) AS stale, sp >= 0.6 AND sp > so AND sc.t > 0 AS near, greatest(1, CAST(round_even(2 * 86400.0 / spacing_blocks / 12, 0) AS INTEGER)) AS k,
  coalesce(mb.dividends / nullif(sum(mb.dividends) OVER (PARTITION BY sc.netuid, sc.t), 0), 0) AS dividend_share FROM sc JOIN mb ON mb.netuid = sc.netuid AND mb.t = sc.t AND mb.uid = sc.src JOIN tm ON tm.netuid = sc.netuid AND tm.t = sc.t JOIN l2 ON l2.netuid = sc.netuid AND l2.t = sc.t AND l2.src = sc.src),
fl AS (SELECT *, near AND (SELECT count(*) FILTER (y.near) FROM f1 y WHERE y.netuid = f1.netuid AND y.src = f1.src AND y.t <= f1.t AND y.t > f1.t - f1.k) / least(t + 1, k) >= 0.5 AND least(t + 1, k) >= least(k, 4) AS copying FROM f1)"""


@query(f"""WITH {SILVER_SQL}, {MEMBERS}, {SHARES}, p1 AS (SELECT *, lag(t) OVER s AS pt, lag(last_update) OVER s AS pl, lag(is_miner) OVER s AS pm, lag(incentive) OVER s AS pi, consensus / greatest(sum(consensus) OVER (PARTITION BY netuid, t), 1) AS cs FROM sh WINDOW s AS (PARTITION BY netuid, uid ORDER BY t)),
p2 AS (SELECT *, coalesce(last_update, 0) > CASE WHEN pt = t - 1 THEN coalesce(pl, 0) ELSE 0 END AS moved FROM p1),
m AS (SELECT netuid, t, count(*) FILTER ("exists") AS n_uids, count(*) FILTER (is_miner) AS n_miners, count(*) FILTER (is_registered_miner) AS n_registered_miners, avg(active) FILTER ("exists") AS active_share, avg(CAST(replaced AS INTEGER)) FILTER (is_miner) AS replacement_rate,
  sum(inc_share) FILTER (uid = owner_uid) AS burn_share, sum(abs(cs - inc_share)) / 2 AS cons_inc_gap, CASE WHEN t > 0 THEN count(*) FILTER (moved AND is_miner AND NOT replaced) / greatest(count(*) FILTER (is_miner), 1) END AS setters FROM p2 GROUP BY 1, 2),
g1 AS (SELECT netuid, t, incentive AS x, row_number() OVER (PARTITION BY netuid, t ORDER BY incentive) AS i FROM mb WHERE is_miner),
g AS (SELECT netuid, t, CASE WHEN sum(x) > 0 THEN 2.0 * CAST(sum(x * i) AS DOUBLE) / (count(*) * CAST(sum(x) AS DOUBLE)) - (count(*) + 1) / count(*) END AS gini_inc FROM g1 GROUP BY 1, 2),
e1 AS (SELECT netuid, t, emission AS x, row_number() OVER (PARTITION BY netuid, t ORDER BY emission DESC) AS i FROM mb WHERE "exists"),
e AS (SELECT netuid, t, CAST(sum(x) FILTER (i <= 10) AS DOUBLE) / CAST(sum(x) AS DOUBLE) AS top10_share, CAST(sum(CAST(x AS HUGEINT) * x) AS DOUBLE) / (CAST(sum(x) AS DOUBLE) * CAST(sum(x) AS DOUBLE)) AS hhi_emission FROM e1 GROUP BY 1, 2),
r1 AS (SELECT netuid, t, 2 * rank() OVER (PARTITION BY netuid, t ORDER BY incentive) + count(*) OVER (PARTITION BY netuid, t, incentive) - 1 AS x, 2 * rank() OVER (PARTITION BY netuid, t ORDER BY pi) + count(*) OVER (PARTITION BY netuid, t, pi) - 1 AS y FROM p2 WHERE pt = t - 1 AND pm AND is_miner AND NOT replaced),
r AS (SELECT netuid, t, CASE WHEN count(*) >= 5 AND count(DISTINCT x) > 1 AND count(DISTINCT y) > 1 THEN corr(x, y) END AS rank_corr FROM r1 GROUP BY 1, 2)
SELECT netuid, t, n_uids, n_miners, n_registered_miners, round(active_share, 9) AS active_share, round(replacement_rate, 9) AS replacement_rate, round(coalesce(burn_share, 0), 9) AS burn_share, round(cons_inc_gap, 9) AS cons_inc_gap, round(setters, 9) AS miner_weight_setter_share,
round(gini_inc, 9) AS gini_inc, round(top10_share, 9) AS top10_share, round(hhi_emission, 9) AS hhi_emission, round(rank_corr, 9) AS rank_corr FROM m LEFT JOIN g USING (netuid, t) LEFT JOIN e USING (netuid, t) LEFT JOIN r USING (netuid, t)""")
def market_miners(spark, d):
    done = M.miner_metrics(frames(spark, d)[0])
    return nine(done, *[c for c in done.columns if c not in K and not c.startswith("n_")])


PAIRS = """al AS (SELECT DISTINCT netuid, uid AS dest FROM mb), fw AS (SELECT sc.netuid, sc.t, sc.src, influence, al.dest, coalesce(w, 0) AS w FROM sc JOIN al USING (netuid) LEFT JOIN wt ON wt.netuid = sc.netuid AND wt.t = sc.t AND wt.src = sc.src AND wt.dest = al.dest),
fr AS (SELECT *, rank() OVER (PARTITION BY netuid, t, src ORDER BY w) + (count(*) OVER (PARTITION BY netuid, t, src, w) - 1) / 2 AS r FROM fw),
pp AS (SELECT a.netuid, a.t, a.src AS a, b.src AS b, any_value(a.influence * b.influence) AS influence, sum(a.w * b.w) / sqrt(CAST(sum(a.w * a.w) AS DOUBLE) * CAST(sum(b.w * b.w) AS DOUBLE)) AS cosine, CASE WHEN count(DISTINCT a.r) > 1 AND count(DISTINCT b.r) > 1 THEN corr(a.r, b.r) END AS rank_corr
  FROM fr a JOIN fr b ON a.netuid = b.netuid AND a.t = b.t AND a.dest = b.dest AND a.src < b.src GROUP BY 1, 2, 3, 4)"""


@query(f"""WITH {SILVER_SQL}, {MEMBERS}, {SCORERS}, {PAIRS} SELECT netuid, t, a, b, influence, round(cosine, 9) AS cosine, round(rank_corr, 9) AS rank_corr FROM pp""")
def market_scorer_pairs(spark, d):
    rows, _, w = frames(spark, d)
    return nine(M.scorer_pairs(rows, w), "cosine", "rank_corr")


@query(f"""WITH {SILVER_SQL}, {MEMBERS}, {SCORERS}, {FLAGS} SELECT netuid, t, src, influence, round(dividend_share, 9) AS dividend_share, vtrust, stale, near AS closer_to_previous, copying FROM fl""")
def market_scorer_flags(spark, d):
    rows, times, w = frames(spark, d)
    return nine(M.scorer_flags(rows, times, w, **COPY), "dividend_share")


CONTESTED = """ct AS (SELECT netuid, t, uid, avg(w / "row") AS received, stddev_pop(w / "row") AS sd, count(*) AS n_scorers FROM gr GROUP BY 1, 2, 3),
cn AS (SELECT ct.*, received >= 0.1 / m AND sd > received AND n_scorers >= 2 AS contested FROM ct JOIN (SELECT netuid, t, count(*) AS m FROM mb WHERE is_miner GROUP BY 1, 2) USING (netuid, t))"""


@query(f"""WITH {SILVER_SQL}, {MEMBERS}, {SCORERS}, {CONTESTED} SELECT netuid, t, uid, round(received, 9) AS received, contested, n_scorers FROM cn""")
def market_contested(spark, d):
    rows, _, w = frames(spark, d)
    return nine(M.contested(rows, w), "received")


@query(f"""WITH {SILVER_SQL}, {MEMBERS}, {SHARES}, {SCORERS}, {FLAGS}, {PAIRS}, {CONTESTED},
s1 AS (SELECT *, influence / greatest(sum(influence) OVER (PARTITION BY netuid, t), 1) AS i FROM fl),
s AS (SELECT netuid, t, count(*) AS n_validators, avg(CAST(stale AS INTEGER)) AS stale_validator_share, coalesce(sum(dividend_share) FILTER (stale), 0) AS stale_div_share, sum(i * i) AS stake_concentration, avg(vtrust) AS vtrust_mean, avg(CAST(copying AS INTEGER)) AS copy_validator_share,
  coalesce(sum(dividend_share) FILTER (copying), 0) AS copy_div_share, count(*) FILTER (NOT stale AND NOT copying) AS effective_scorers, 1 / coalesce(nullif(sum(dividend_share * dividend_share), 0), 1) AS div_participation FROM s1 GROUP BY 1, 2),
a AS (SELECT netuid, t, CASE WHEN sum(influence) > 0 THEN sum(cosine * influence) / sum(influence) ELSE avg(cosine) END AS validator_agreement, CASE WHEN count(rank_corr) = count(*) THEN CASE WHEN sum(influence) > 0 THEN sum(rank_corr * influence) / sum(influence) ELSE avg(rank_corr) END END AS validator_rank_agreement FROM pp GROUP BY 1, 2),
o AS (SELECT DISTINCT netuid, t, owner_uid FROM mb), bw AS (SELECT sc.netuid, sc.t, avg(coalesce(wt.w / rw."row", 0)) AS burn_weight_mass FROM sc JOIN o ON o.netuid = sc.netuid AND o.t = sc.t JOIN rw ON rw.netuid = sc.netuid AND rw.t = sc.t AND rw.src = sc.src LEFT JOIN wt ON wt.netuid = sc.netuid AND wt.t = sc.t AND wt.src = sc.src AND wt.dest = o.owner_uid GROUP BY 1, 2),
c AS (SELECT netuid, t, avg(CAST(contested AS INTEGER)) AS contested_share, coalesce(sum(miner_emi_share) FILTER (contested), 0) AS contested_emission_share FROM cn JOIN sh USING (netuid, t, uid) GROUP BY 1, 2)
SELECT netuid, t, n_validators, effective_scorers, round(stale_validator_share, 9) AS stale_validator_share, round(stale_div_share, 9) AS stale_div_share, round(stake_concentration, 9) AS stake_concentration, round(vtrust_mean, 9) AS vtrust_mean, round(copy_validator_share, 9) AS copy_validator_share, round(copy_div_share, 9) AS copy_div_share,
round(div_participation, 9) AS div_participation, round(validator_agreement, 9) AS validator_agreement, round(validator_rank_agreement, 9) AS validator_rank_agreement, round(burn_weight_mass, 9) AS burn_weight_mass, round(contested_share, 9) AS contested_share, round(contested_emission_share, 9) AS contested_emission_share
FROM s LEFT JOIN a USING (netuid, t) LEFT JOIN bw USING (netuid, t) LEFT JOIN c USING (netuid, t)""")
def market_scorers(spark, d):
    rows, times, w = frames(spark, d)
    done = M.scorer_metrics(rows, times, w, **COPY)
    return nine(done, *[c for c in done.columns if c not in (*K, "n_validators", "effective_scorers")])


def panel_frame(spark, d):
    """The whole panel over the adapter's tables."""
    rows, times, w = frames(spark, d)
    return M.build(rows, times, w, **COPY)


@query(f"WITH {SILVER_SQL}, {TIMED} SELECT count(*) AS snapshots, count(DISTINCT netuid) AS markets, CAST(sum(block) AS BIGINT) AS blocks, CAST(sum(tempo) AS BIGINT) AS tempo, CAST(sum(burn_cost) AS BIGINT) AS burn_cost, round(sum(hours), 4) AS hours FROM tm")
def market_panel_totals(spark, d):
    p = panel_frame(spark, d)
    return p.agg(F.count("*").alias("snapshots"), F.count_distinct("netuid").alias("markets"), F.sum("block").alias("blocks"), F.sum("tempo").cast("long").alias("tempo"), F.sum("burn_cost").alias("burn_cost"), F.round(F.sum("hours"), 4).alias("hours"))
