"""Exploits: which occupants gain where a market's rewards shift, what answers, and what is at risk until it unwinds.

rows: silver.members(); times: silver.timed(); panel: market_panel.build() or its columns used here. Windows are counted in
snapshots, from days and each market's spacing; a snapshot meets at most twice a window's snapshots.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .incidents import split_points, spaced_peaks
from .silver import K, flows, shares, snaps

SIGNALS = ["gini_inc", "top10_share", "rank_corr"]
START = ["netuid", "t0"]


def windows(times: DataFrame, days: float = 3.0, segment_days: float = 2.0) -> DataFrame:
    """(netuid, w, min_seg, n): a window's and a segment's snapshots, and how many a market has."""
    return times.groupBy("netuid").agg(F.first(snaps(days)).alias("w"), F.first(snaps(segment_days)).alias("min_seg"), (F.max("t") + 1).alias("n"))


def candidates(times: DataFrame, **days) -> DataFrame:
    """(netuid, t0, w, min_seg, n): every third of a window, from one window after the start to half a window before the end."""
    w = windows(times, **days)
    last = F.col("n") - F.greatest(F.lit(2), F.floor(F.col("w") / 2)) - 1
    starts = F.when(last >= F.col("w"), F.sequence(F.col("w").cast("long"), last.cast("long"), F.greatest(F.lit(1), F.floor(F.col("w") / 3)).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return w.withColumn("t0", F.explode(starts)).select(*START, "w", "min_seg", "n")


def cohorts(rows: DataFrame, starts: DataFrame, fraction: float = 0.5, most: float = 0.2) -> DataFrame:
    """(netuid, t0, occupant, share_gain, before): the occupants whose mean share rose most from the window before t0 to the one from it on.

    Taken from the largest gain down (ties: by name) until they hold `fraction` of all gains, at most `most` of the miners
    at t0 but one at least. starts: (netuid, t0, w, n). Unnamed occupants are left out.
    """
    own = shares(rows).filter("occupant <> ''").groupBy(*K, "occupant").agg(F.sum(F.when(F.col("is_miner"), F.col("miner_emi_share")).otherwise(0.0)).alias("v"))
    met = starts.join(own, "netuid").filter((F.col("t") >= F.col("t0") - F.col("w")) & (F.col("t") < F.col("t0") + F.col("w")))
    late = F.col("t") >= F.col("t0")
    span = lambda a, b: F.greatest(b - a, F.lit(1))
    sums = met.groupBy(*START, "w", "n", "occupant").agg(F.sum(F.when(late, F.col("v")).otherwise(0.0)).alias("a"), F.sum(F.when(~late, F.col("v")).otherwise(0.0)).alias("b"))
    sums = sums.withColumn("before", F.col("b") / span(F.greatest(F.col("t0") - F.col("w"), F.lit(0)), F.col("t0")))
    sums = sums.withColumn("share_gain", F.round(F.col("a") / span(F.col("t0"), F.least(F.col("t0") + F.col("w"), F.col("n"))) - F.col("before"), 12)).filter("share_gain > 0")
    miners = rows.groupBy("netuid", F.col("t").alias("t0")).agg(F.greatest(F.count_if("is_miner"), F.lit(1)).alias("m"))
    order = Window.partitionBy(*START).orderBy(F.desc("share_gain"), "occupant")
    ranked = sums.join(miners, START).withColumn("nth", F.row_number().over(order)).withColumn("held", F.coalesce(F.sum("share_gain").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)) / F.sum("share_gain").over(Window.partitionBy(*START)))
    return ranked.filter((F.col("nth") <= F.greatest(F.lit(1), F.floor(F.col("m") * most))) & (F.col("held") < fraction)).select(*START, "occupant", "share_gain", "before", "m")


def capture_scan(rows: DataFrame, times: DataFrame, least: float = 0.15, min_miners: float = 3.0, **days) -> DataFrame:
    """(netuid, t0, min_seg, gain): candidates whose cohort gained `least` or more, with min_miners working miners on average in the window before."""
    starts = candidates(times, **days)
    gained = cohorts(rows, starts).groupBy(*START).agg(F.sum("share_gain").alias("gain"))
    miners = rows.groupBy(*K).agg(F.count_if("is_miner").alias("k"))
    busy = starts.join(miners, "netuid").filter((F.col("t") >= F.col("t0") - F.col("w")) & (F.col("t") < F.col("t0"))).groupBy(*START, "min_seg").agg(F.avg("k").alias("k")).filter(F.col("k") >= min_miners)
    return busy.join(gained, START).filter(F.col("gain") >= least).select(*START, "min_seg", "gain")


def shifts(panel: DataFrame, times: DataFrame, scale: float = 3.0, min_effect: float = 1.0, **days) -> DataFrame:
    """(netuid, t0): change points of the three signals together."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("t0")
        x = group[SIGNALS].to_numpy(float)
        at = split_points(x, int(group["min_seg"].iloc[0]), scale * len(SIGNALS) * np.log(max(len(x), 2)), min_effect)
        return group.iloc[at][START]

    some = panel.select("netuid", F.col("t").cast("long").alias("t0"), *[F.col(s).cast("double") for s in SIGNALS]).join(windows(times, **days).select("netuid", "min_seg"), "netuid")
    return some.groupBy("netuid").applyInPandas(run, StructType([some.schema[c] for c in START]))


def detect(rows: DataFrame, panel: DataFrame, times: DataFrame, least: float = 0.15, **options) -> DataFrame:
    """(netuid, t0, detector): spaced captures and shifts. A shift within a segment of a capture turns the strongest such capture into `both`; any other is a distribution_shift."""
    kept = spaced_peaks(capture_scan(rows, times, least), ["netuid", "min_seg"], "t0", "gain", "min_seg")
    found = shifts(panel, times, **options).withColumnRenamed("t0", "at")
    near = found.join(kept, "netuid", "left").withColumn("hit", F.abs(F.col("t0") - F.col("at")) < F.col("min_seg"))
    near = near.groupBy("netuid", "at").agg(F.max(F.when(F.col("hit"), F.struct("gain", "t0"))).alias("x")).select("netuid", F.coalesce(F.col("x.t0"), F.col("at")).alias("t0"), F.when(F.col("x").isNull(), "distribution_shift").otherwise("both").alias("detector"))
    alone = kept.select(*START).join(near, START, "left_anti").withColumn("detector", F.lit("capture"))
    return near.distinct().unionByName(alone)


def incidents(events: DataFrame, rows: DataFrame, panel: DataFrame, times: DataFrame, hyperparameters: list[str], burn_rise: float = 0.05, unwind: float = 0.75, consecutive: int = 3, **days) -> DataFrame:
    """The record of each event (netuid, t0, detector): signals before and after, who gained, what answered, when it unwound and what was at risk until then."""
    w = windows(times, **days)
    starts = events.select(*START, "detector").join(w, "netuid")
    gained = cohorts(rows, starts.select(*START, "w", "n"))
    first = rows.filter("occupant <> ''").groupBy("netuid", "occupant").agg(F.min("t").alias("seen"))
    gained = gained.join(first, ["netuid", "occupant"]).join(starts.select(*START, "w"), START)
    who = gained.groupBy(*START).agg(F.count("*").alias("cohort_size"), (F.count("*") / F.first("m")).alias("cohort_uid_share"), F.sum("share_gain").alias("cohort_excess_share"), F.avg((F.col("seen") >= F.col("t0") - F.col("w")).cast("double")).alias("cohort_new_frac"))
    near = starts.join(panel.select(*K, *SIGNALS, "burn_share", *hyperparameters), "netuid")
    before, after = (F.col("t") >= F.col("t0") - F.col("w")) & (F.col("t") < F.col("t0")), (F.col("t") >= F.col("t0")) & (F.col("t") < F.col("t0") + F.col("w"))
    ahead = (F.col("t") >= F.col("t0")) & (F.col("t") < F.col("t0") + 2 * F.col("w"))
    reference = F.col("t") == F.greatest(F.col("t0") - 1, F.lit(0))
    one = Window.partitionBy(*START)
    near = near.withColumn("burn_before", F.avg(F.when(before, F.col("burn_share"))).over(one))
    for h in hyperparameters:
        near = near.withColumn(f"_{h}", F.max(F.when(reference, F.col(h))).over(one))
    moved = lambda h: ahead & (F.col(h) != F.col(f"_{h}"))
    rise = ahead & (F.col("burn_share") - F.col("burn_before") >= burn_rise)
    any_moved = F.coalesce(F.greatest(*[moved(h).cast("int") for h in hyperparameters], F.lit(0)), F.lit(0)) > 0
    facts = near.groupBy(*START).agg(
        *[F.avg(F.when(when, F.col(s))).alias(f"{s}_{name}") for s in SIGNALS for name, when in (("before", before), ("after", after))],
        F.max(F.when(ahead, F.col("burn_share") - F.col("burn_before"))).alias("burn_rise"),
        F.coalesce(F.bool_or(rise), F.lit(False)).alias("burn_response"),
        F.concat_ws(",", *[F.when(F.bool_or(moved(h)), h) for h in hyperparameters]).alias("hyperparams_changed"),
        F.min(F.when(F.coalesce(rise, F.lit(False)) | any_moved, F.col("t"))).alias("response_t"),
    )
    back = unwinding(starts, gained, rows, times, unwind, consecutive)
    total = flows(rows, times).groupBy("netuid").agg(F.sum("alpha_flow").alias("_all"))
    spacing = times.groupBy("netuid").agg(F.first("spacing_blocks").alias("_s"))
    out = starts.drop("min_seg", "n").join(times.select("netuid", F.col("t").alias("t0"), "block", "hours"), START).join(facts, START).join(who, START, "left").fillna(0, ["cohort_size", "cohort_uid_share", "cohort_excess_share"]).join(back, START, "left").join(total, "netuid").join(spacing, "netuid")
    out = out.withColumn("hyperparam_response", F.col("hyperparams_changed") != "").withColumn("response_hours", (F.col("response_t") - F.col("t0")) * F.col("_s") * 12 / 3600)
    return out.withColumn("at_risk_subnet_share", F.when(F.col("_all") > 0, F.col("at_risk_alpha") / F.when(F.col("_all") > 0, F.col("_all")))).drop("_all", "_s")


def unwinding(starts: DataFrame, gained: DataFrame, rows: DataFrame, times: DataFrame, unwind: float, consecutive: int) -> DataFrame:
    """(netuid, t0, base, t_peak, recovered, recovery_hours, at_risk_alpha, at_risk_tao).

    The cohort's share is followed from its first maximum within a window of t0 until `consecutive` snapshots have `unwind` of
    its excess undone. Its base is the sum of what each member held before, or the market's median then if that is more.
    """
    own = shares(rows).filter("is_miner")
    before = starts.join(own.select(*K, "miner_emi_share"), "netuid").filter((F.col("t") >= F.col("t0") - F.col("w")) & (F.col("t") < F.col("t0")))
    typical = before.groupBy(*START).agg(F.percentile("miner_emi_share", 0.5).alias("typical"))
    base = gained.join(typical, START, "left").groupBy(*START).agg(F.sum(F.greatest("before", F.coalesce("typical", F.lit(0.0)))).alias("base"))
    held = gained.select(*START, "occupant").join(own.select(*K, "occupant", "miner_emi_share"), ["netuid", "occupant"]).groupBy(*START, "t").agg(F.sum("miner_emi_share").alias("cs"))
    paid = flows(rows, times).groupBy(*K).agg(F.sum(F.when(F.col("is_miner"), F.col("alpha_flow")).otherwise(0.0)).alias("alpha"), F.sum(F.when(F.col("is_miner"), F.col("tao_flow")).otherwise(0.0)).alias("tao"))
    path = starts.join(base, START).join(times.select(*K, "hours"), "netuid").filter(F.col("t") >= F.col("t0")).join(held, [*START, "t"], "left").fillna(0, ["cs"]).join(paid, K)
    one, order = Window.partitionBy(*START), Window.partitionBy(*START).orderBy("t")
    top = F.max(F.when(F.col("t") < F.col("t0") + F.col("w"), F.struct("cs", (-F.col("t")).alias("t")))).over(one)
    path = path.withColumn("_top", top).withColumn("t_peak", -F.col("_top.t")).withColumn("level", F.col("base") + (1 - unwind) * (F.col("_top.cs") - F.col("base")))
    low = (F.col("cs") <= F.col("level")).cast("int")
    run = order.rowsBetween(0, consecutive - 1)
    path = path.withColumn("_run", (F.sum(low).over(run) == consecutive) & (F.col("t") >= F.col("t_peak")))
    path = path.withColumn("_rec", F.min(F.when(F.col("_run"), F.col("t"))).over(one)).withColumn("_end", F.coalesce("_rec", F.max("t").over(one)))
    excess = F.when(F.col("t") <= F.col("_end"), F.greatest(F.col("cs") - F.col("base"), F.lit(0.0))).otherwise(0.0)
    return path.groupBy(*START).agg(F.first("base").alias("base"), F.first("t_peak").alias("t_peak"), F.max(F.col("_rec").isNotNull()).alias("recovered"), (F.max(F.when(F.col("t") == F.col("_end"), F.col("hours"))) - F.max(F.when(F.col("t") == F.col("t0"), F.col("hours")))).alias("recovery_hours"), F.sum(excess * F.col("alpha")).alias("at_risk_alpha"), F.sum(excess * F.col("tao")).alias("at_risk_tao"))


def recurrence(events: DataFrame, times: DataFrame, rows: DataFrame) -> DataFrame:
    """(netuid, period_days, n_incidents, n_capture_events, recurring, median_interval_days, share_intervals_14_28d, totals) of every market, those without events too."""
    at = events.join(times.select("netuid", F.col("t").alias("t0"), "hours"), START)
    at = at.withColumn("gap", (F.col("hours") - F.lag("hours").over(Window.partitionBy("netuid").orderBy("t0"))) / 24)
    each = at.groupBy("netuid").agg(F.count("*").alias("n_incidents"), F.count_if(F.col("detector") != "distribution_shift").alias("n_capture_events"), F.percentile("gap", 0.5).alias("median_interval_days"), F.avg(F.col("gap").between(14, 28).cast("double")).alias("share_intervals_14_28d"))
    total = flows(rows, times).groupBy("netuid").agg(F.sum("tao_flow").alias("subnet_tao_flow_total"), F.sum("alpha_flow").alias("subnet_alpha_flow_total"))
    all_ = times.groupBy("netuid").agg(F.first("period_days").alias("period_days"))
    return all_.join(each, "netuid", "left").fillna(0, ["n_incidents", "n_capture_events"]).withColumn("recurring", F.col("n_incidents") >= 2).join(total, "netuid", "left")


def summary(markets: DataFrame, found: DataFrame) -> DataFrame:
    """One row: how common events are, how regular, who gains, what answers and how long they last. markets: recurrence(); found: incidents()."""
    rate = lambda c: F.avg(c.cast("double"))
    one = markets.agg(F.count("*").alias("subnets"), rate(F.col("n_incidents") > 0).alias("share_subnets_with_incident"), rate(F.col("recurring")).alias("share_subnets_recurring"), F.percentile("median_interval_days", 0.5).alias("median_interval_days"), F.avg(F.when(F.col("recurring"), F.col("median_interval_days").between(14, 28).cast("double"))).alias("share_recurring_with_2_4_week_cadence"))
    half = lambda c, name: F.percentile(c, 0.5).alias(name)
    two = found.agg(F.count("*").alias("total_incidents"), rate(F.col("detector") != "distribution_shift").alias("share_incidents_capture"), half("cohort_uid_share", "median_cohort_uid_share"), half("cohort_excess_share", "median_cohort_excess_share"), half("cohort_new_frac", "median_new_member_frac"), rate(F.col("burn_response")).alias("share_incidents_burn_response"), rate(F.col("hyperparam_response")).alias("share_incidents_hyperparam_response"), rate(F.col("response_t").isNull()).alias("share_incidents_no_response"), half("response_hours", "median_response_hours"), half("recovery_hours", "median_recovery_hours"), rate(~F.col("recovered")).alias("share_unrecovered"), F.sum("at_risk_tao").alias("total_at_risk_tao"))
    return one.crossJoin(two)  # one row each
