"""Queries over the silver tables, each beside the SQL that says the same. Derived fractions are rounded to nine places in both."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import silver as S
from ..sources import silver as source
from ..sources.silver import SILVER_SQL

K = ["netuid", "t"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Snapshots with their times, and members with their flags, as CTEs.
TIMED = """st AS (SELECT *, block - lag(block) OVER m AS step FROM sn WINDOW m AS (PARTITION BY netuid ORDER BY t)),
tm AS (SELECT * EXCLUDE (step), (block - first_value(block) OVER m) * 12 / 3600 AS hours, coalesce(lead(block) OVER m - block, step, 1) AS interval_blocks,
  coalesce((SELECT quantile_cont(x.step, 0.5) FROM st x WHERE x.netuid = st.netuid), 1.0) AS spacing_blocks,
  (max(block) OVER (PARTITION BY netuid) - min(block) OVER (PARTITION BY netuid)) * 12 / 86400 AS period_days,
  CASE WHEN tempo > 0 THEN CAST(tempo AS DOUBLE) ELSE 360.0 END AS tempo_v, CASE WHEN alpha_in > 0 AND subnet_tao > 0 THEN subnet_tao / alpha_in END AS price FROM st WINDOW m AS (PARTITION BY netuid ORDER BY t))"""
MEMBERS = """u1 AS (SELECT us.*, sn.owner_hotkey, incentive IS NOT NULL AS "exists", vpermit > 0 AS is_validator, incentive IS NOT NULL AND NOT vpermit > 0 AS is_registered_miner FROM us JOIN sn USING (netuid, t)),
u2 AS (SELECT *, coalesce(min(uid) FILTER (hotkey = owner_hotkey) OVER (PARTITION BY netuid, t), 0) AS owner_uid, CAST(sum(incentive) FILTER (is_registered_miner) OVER (PARTITION BY netuid, t) AS DOUBLE) AS earned FROM u1),
u3 AS (SELECT *, uid = owner_uid AND hotkey = owner_hotkey AS is_owner, lag(t) OVER s AS pt, lag(hotkey) OVER s AS ph, lag(reg_block) OVER s AS pr FROM u2 WINDOW s AS (PARTITION BY netuid, uid ORDER BY t)),
mb AS (SELECT * EXCLUDE (earned, pt, ph, pr), is_registered_miner AND CASE WHEN earned > 0 THEN incentive / earned ELSE 0 END >= 0.001 AND NOT is_owner AS is_miner,
  coalesce(pt = t - 1 AND ((hotkey <> ph AND hotkey <> '' AND ph <> '') OR reg_block <> pr), false) AS replaced, hotkey AS occupant FROM u3)"""
SHARES = """sh AS (SELECT *, coalesce(incentive / nullif(sum(incentive) OVER k, 0), 0.0) AS inc_share, coalesce(emission / nullif(sum(emission) OVER k, 0), 0.0) AS emi_share, coalesce(dividends / nullif(sum(dividends) OVER k, 0), 0.0) AS div_share,
  CASE WHEN is_miner THEN coalesce(incentive / nullif(sum(incentive) FILTER (is_miner) OVER k, 0), 0.0) ELSE 0.0 END AS miner_emi_share FROM mb WINDOW k AS (PARTITION BY netuid, t))"""
SCORERS = """sc0 AS (SELECT netuid, t, uid AS src, stake_weight, vtrust, sum(stake_weight) OVER (PARTITION BY netuid, t) AS staked FROM mb WHERE is_validator AND EXISTS (SELECT 1 FROM wt WHERE wt.netuid = mb.netuid AND wt.t = mb.t AND wt.src = mb.uid)),
sc AS (SELECT netuid, t, src, CASE WHEN staked > 0 THEN stake_weight ELSE vtrust END AS influence FROM sc0),
rw AS (SELECT netuid, t, src, sum(w) AS "row" FROM wt GROUP BY 1, 2, 3),
gr AS (SELECT sc.netuid, sc.t, sc.src, influence, mb.uid, coalesce(w, 0) AS w, CAST("row" AS DOUBLE) AS "row" FROM sc JOIN rw USING (netuid, t, src) JOIN mb ON mb.netuid = sc.netuid AND mb.t = sc.t AND is_miner LEFT JOIN wt ON wt.netuid = sc.netuid AND wt.t = sc.t AND wt.src = sc.src AND wt.dest = mb.uid)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def nine(df: DataFrame, *names: str) -> DataFrame:
    """The named columns as doubles rounded to nine places."""
    return df.select(*[F.round(F.col(c).cast("double"), 9).alias(c) if c in names else F.col(c) for c in df.columns])


def frames(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, timed snapshots, weights)."""
    snapshots = source.snapshots(spark, d)
    return S.members(source.uid_state(spark, d), snapshots), S.timed(snapshots), source.weights(spark, d)


def as_number(x: Column) -> Column:
    return x.cast("int")


@query(f"""WITH {SILVER_SQL}, {TIMED} SELECT netuid, t, block, round(hours, 9) AS hours, interval_blocks, spacing_blocks, round(period_days, 9) AS period_days, tempo_v, round(price, 9) AS price,
greatest(1, CAST(round_even(2 * 86400.0 / spacing_blocks / 12, 0) AS INTEGER)) AS snaps_2, greatest(1, CAST(round_even(7 * 86400.0 / spacing_blocks / 12, 0) AS INTEGER)) AS snaps_7 FROM tm""")
def silver_times(spark, d):
    rows = S.timed(source.snapshots(spark, d)).select(*K, "block", "hours", "interval_blocks", "spacing_blocks", "period_days", "tempo_v", "price", S.snaps(2).alias("snaps_2"), S.snaps(7).alias("snaps_7"))
    return nine(rows, "hours", "period_days", "price")


@query(f"""WITH {SILVER_SQL}, {MEMBERS} SELECT netuid, t, uid, "exists", is_validator, is_registered_miner, owner_uid, is_owner, is_miner, replaced, occupant FROM mb""")
def silver_members(spark, d):
    return frames(spark, d)[0].select(*K, "uid", "exists", "is_validator", "is_registered_miner", "owner_uid", "is_owner", "is_miner", "replaced", "occupant")


@query(f"""WITH {SILVER_SQL}, {MEMBERS}, {SHARES} SELECT netuid, t, uid, round(inc_share, 9) AS inc_share, round(emi_share, 9) AS emi_share, round(div_share, 9) AS div_share, round(miner_emi_share, 9) AS miner_emi_share FROM sh""")
def silver_shares(spark, d):
    names = ["inc_share", "emi_share", "div_share", "miner_emi_share"]
    return nine(S.shares(frames(spark, d)[0]).select(*K, "uid", *names), *names)


@query(f"""WITH {SILVER_SQL}, {TIMED}, {MEMBERS}, f AS (SELECT netuid, t, is_miner, emission / 1e9 * (interval_blocks / (tempo_v + 1)) AS a, emission / 1e9 * (interval_blocks / (tempo_v + 1)) * coalesce(price, 0) AS p FROM mb JOIN tm USING (netuid, t))
SELECT netuid, t, round(sum(a), 9) AS subnet_alpha_flow, round(sum(p), 9) AS subnet_tao_flow, round(coalesce(sum(a) FILTER (is_miner), 0), 9) AS miner_alpha_flow, round(coalesce(sum(p) FILTER (is_miner), 0), 9) AS miner_tao_flow FROM f GROUP BY 1, 2""")
def silver_flows(spark, d):
    rows, times, _ = frames(spark, d)
    miner = lambda c: F.sum(F.when(F.col("is_miner"), F.col(c)).otherwise(0.0)).alias(f"miner_{c}")
    done = S.flows(rows, times).groupBy(*K).agg(F.sum("alpha_flow").alias("subnet_alpha_flow"), F.sum("tao_flow").alias("subnet_tao_flow"), miner("alpha_flow"), miner("tao_flow"))
    return nine(done, *done.columns[2:])


@query(f"""WITH {SILVER_SQL}, {MEMBERS}, {SCORERS} SELECT netuid, t, src, dest, w, round(w / "row", 9) AS share, influence FROM wt JOIN rw USING (netuid, t, src) JOIN sc USING (netuid, t, src)""")
def silver_weights(spark, d):
    rows, _, w = frames(spark, d)
    done = S.normalized(w).join(S.scorers(rows, w), [*K, "src"]).select(*K, "src", "dest", "w", "share", "influence")
    return nine(done, "share")


@query(f"WITH {SILVER_SQL} SELECT netuid, bool_or(hotkey <> '') AS has_hotkeys, bool_or(reg_block IS NOT NULL) AS has_reg_block, sum(stake_weight) > 0 AS has_stake_weight FROM us GROUP BY 1")
def silver_flags(spark, d):
    return S.flags(source.uid_state(spark, d))


@query(f"""WITH {SILVER_SQL}, {MEMBERS}, {SCORERS}, g1 AS (SELECT netuid, t, src, uid, w / greatest(CAST(sum(w) OVER r AS DOUBLE), 1e-12) AS s, count(*) OVER r AS n FROM gr WINDOW r AS (PARTITION BY netuid, t, src)),
g2 AS (SELECT netuid, t, uid, quantile_cont(s, 0.5) AS median, avg(s) AS mean, avg(CASE WHEN s >= 1 / n THEN 1.0 ELSE 0.0 END) AS breadth, stddev_pop(s) AS sd FROM g1 GROUP BY 1, 2, 3),
g3 AS (SELECT g2.*, consensus FROM g2 JOIN mb USING (netuid, t, uid))
SELECT netuid, t, uid, round(coalesce(median / nullif(sum(median) OVER k, 0), 0), 9) AS median, round(coalesce(mean / nullif(sum(mean) OVER k, 0), 0), 9) AS mean, round(breadth, 9) AS breadth, round(CASE WHEN mean > 0 THEN sd / mean ELSE 0 END, 9) AS cv,
round(coalesce(consensus / nullif(sum(consensus) OVER k, 0), 0), 9) AS consensus FROM g3 WINDOW k AS (PARTITION BY netuid, t)""")
def silver_support(spark, d):
    rows, _, w = frames(spark, d)
    return nine(S.support(rows, w), "median", "mean", "breadth", "cv", "consensus")


@query(f"""WITH {SILVER_SQL}, {MEMBERS}, {SHARES}, l AS (SELECT netuid, t, uid, ln(miner_emi_share + 1e-6) AS l FROM sh WHERE is_miner), m AS (SELECT netuid, t, quantile_cont(l, 0.5) AS m FROM l GROUP BY 1, 2) SELECT netuid, t, uid, round(l - m, 9) AS level FROM l JOIN m USING (netuid, t)""")
def silver_trajectories(spark, d):
    return nine(S.trajectories(S.shares(frames(spark, d)[0])), "level")


@query(f"""WITH {SILVER_SQL}, {MEMBERS}, {SCORERS}, l AS (SELECT netuid, t, src, uid, ln(w / "row" + 1e-6) AS l FROM gr), c AS (SELECT netuid, src, uid, l - avg(l) OVER k AS c, count(*) OVER k AS n FROM l WINDOW k AS (PARTITION BY netuid, t, uid))
SELECT netuid, src, uid, round(avg(c), 9) AS preference FROM c WHERE n >= 2 GROUP BY 1, 2, 3""")
def silver_preferences(spark, d):
    rows, _, w = frames(spark, d)
    return nine(S.preferences(rows, w), "preference")
