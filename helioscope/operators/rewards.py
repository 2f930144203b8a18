"""Reward spikes: where a miner's share jumps, whether its scorers' support follows, and whether it happens to the same miners again.

rows: silver.members(); times: silver.timed(); weights: the sparse weights. Windows whose length differs from market to
market are made by sending each value to the snapshots that look back at it: length times the rows, by slot.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import stats
from .silver import K, flows, scorers, shares, snaps, support

SLOT = ["netuid", "uid"]


@F.pandas_udf(DoubleType())
def chi2_p(x: pd.Series, freedom: pd.Series) -> pd.Series:
    return pd.Series([stats.chi2_tail(a, max(b, 1.0)) for a, b in zip(x, freedom, strict=True)])


@F.pandas_udf(DoubleType())
def binomial_p(k: pd.Series, n: pd.Series, rate: pd.Series) -> pd.Series:
    return pd.Series([stats.binomial_tail(int(a), int(b), float(c)) for a, b, c in zip(k, n, rate, strict=True)])


def dense(rows: DataFrame, times: DataFrame, values: DataFrame, names: list[str], days: float) -> DataFrame:
    """(netuid, t, uid, names, n_miners, length): every slot that the market ever had at every snapshot, values 0 where there is none; length: the snapshots that `days` last."""
    miners = rows.groupBy(*K).agg(F.greatest(F.count_if("is_miner"), F.lit(1)).alias("n_miners"))
    cells = times.select(*K, snaps(days).alias("length")).join(rows.select(*SLOT).distinct(), "netuid")
    return cells.join(miners, K).join(values.select(*K, "uid", *names), [*K, "uid"], "left").fillna(0, names)


def trailing(cells: DataFrame, names: list[str], spread: str | None = None) -> DataFrame:
    """(netuid, uid, t, mean_<name>..., sd): over the `length` snapshots before t; null with fewer than max(3, length // 2) of them. spread: the value whose sample deviation is wanted."""
    ahead = cells.select("netuid", "uid", "length", *names, F.explode(F.sequence(F.col("t") + 1, F.col("t") + F.col("length"))).alias("t"))
    enough = F.count("*") >= F.greatest(F.lit(3), F.floor(F.first("length") / 2))
    out = [F.when(enough, F.avg(n)).alias(f"mean_{n}") for n in names]
    if spread:
        out.append(F.when(enough, F.stddev_samp(spread)).alias("sd"))
    return ahead.groupBy("netuid", "uid", "t").agg(*out)


def spikes(rows: DataFrame, times: DataFrame, weights: DataFrame, days: float = 3.0, z: float = 3.0, gain: float = 1.0, floor: float = 0.1) -> DataFrame:
    """Every cell with share, its trailing mean, z and spike, beside the shares of support, consensus and breadth and their trailing means.

    A spike is z deviations and gain / miners above the mean; the deviation counts as floor / miners at least. A slot that got a new
    occupant in this or the `length` snapshots before has none.
    """
    backing = support(rows, weights).select(*K, "uid", F.col("median").alias("support"), F.col("consensus").alias("agreed"), "breadth")
    own = shares(rows).select(*K, "uid", F.col("miner_emi_share").alias("share"), F.col("is_miner").cast("int").alias("miner"), F.col("replaced").cast("int").alias("new")).join(backing, [*K, "uid"], "left")
    names = ["share", "miner", "new", "support", "agreed", "breadth"]
    cells = dense(rows, times, own, names, days)
    back = trailing(cells, ["share", "support", "agreed", "breadth"], "share")
    recent = cells.select("netuid", "uid", "new", F.explode(F.sequence(F.col("t"), F.col("t") + F.col("length"))).alias("t")).groupBy("netuid", "uid", "t").agg(F.sum("new").alias("resets"))
    cells = cells.join(back, [*SLOT, "t"], "left").join(recent, [*SLOT, "t"])
    rise = F.col("share") - F.col("mean_share")
    cells = cells.withColumn("z", rise / F.greatest(F.coalesce("sd", F.lit(0.0)), floor / F.col("n_miners")))
    flag = (F.col("z") >= z) & (rise >= gain / F.col("n_miners")) & (F.col("resets") == 0) & (F.col("miner") == 1)
    return cells.withColumn("spike", F.coalesce(flag, F.lit(False)))


def events(cells: DataFrame, rows: DataFrame, times: DataFrame, gap: int = 2, ratio: float = 0.5) -> DataFrame:
    """A row a spike event: spikes of a slot with at most `gap` snapshots between are one. Gains are against the means at its start; cells: spikes().

    Unsupported: the median support rose by less than `ratio` of what the share did. Sustained: `length` snapshots after its end the
    same occupant keeps half the gain.
    """
    order = Window.partitionBy(*SLOT).orderBy("t")
    hit = cells.filter("spike").withColumn("_g", F.coalesce((F.col("t") - F.lag("t").over(order) > gap).cast("int"), F.lit(1)))
    hit = hit.withColumn("_s", F.sum("_g").over(order))
    runs = hit.groupBy(*SLOT, "_s").agg(F.min("t").alias("t_start"), F.max("t").alias("t_end")).drop("_s")
    inside = runs.join(cells, SLOT).filter(F.col("t").between(F.col("t_start"), F.col("t_end")))
    paid = flows(rows, times).groupBy(*K).agg(F.sum(F.when(F.col("is_miner"), F.col("alpha_flow")).otherwise(0.0)).alias("alpha"), F.sum(F.when(F.col("is_miner"), F.col("tao_flow")).otherwise(0.0)).alias("tao"))
    start = cells.select(*SLOT, F.col("t").alias("t_start"), "length", *[F.col(f"mean_{c}").alias(f"base_{c}") for c in ("share", "support", "agreed", "breadth")])
    inside = inside.drop("length").join(start, [*SLOT, "t_start"]).join(paid, K)
    excess = F.greatest(F.col("share") - F.col("base_share"), F.lit(0.0))
    peak = F.max(F.struct("share", (-F.col("t")).alias("t"), "z", "support", "agreed", "breadth", "n_miners"))
    out = inside.groupBy(*SLOT, "t_start", "t_end").agg(peak.alias("p"), F.first("length").alias("length"), *[F.first(f"base_{c}").alias(f"base_{c}") for c in ("share", "support", "agreed", "breadth")], F.sum(excess * F.col("alpha")).alias("excess_alpha"), F.sum(excess * F.col("tao")).alias("excess_tao"))
    last = times.groupBy("netuid").agg(F.max("t").alias("_last"))
    who = rows.select(*K, "uid", "occupant")
    out = out.join(last, "netuid").withColumn("_after", F.least(F.col("_last"), F.col("t_end") + F.col("length")))
    out = out.join(who.withColumnRenamed("t", "t_start"), [*SLOT, "t_start"], "left")
    out = out.join(who.select(*SLOT, F.col("t").alias("_after"), F.col("occupant").alias("_then")), [*SLOT, "_after"], "left")
    out = out.join(cells.select(*SLOT, F.col("t").alias("_after"), F.col("share").alias("_share")), [*SLOT, "_after"], "left")
    hours = times.select(*K, "hours")
    out = out.join(hours.select("netuid", F.col("t").alias("t_start"), F.col("hours").alias("hours_start")), ["netuid", "t_start"]).join(hours.select("netuid", F.col("t").alias("t_end"), F.col("hours").alias("_h")), ["netuid", "t_end"])
    gained, backed = F.col("p.share") - F.col("base_share"), F.col("p.support") - F.col("base_support")
    return out.select(
        *SLOT,
        "occupant",
        "t_start",
        (-F.col("p.t")).alias("t_peak"),
        "t_end",
        "length",
        F.col("p.n_miners").alias("n_miners"),
        "hours_start",
        (F.col("_h") - F.col("hours_start")).alias("duration_hours"),
        F.col("p.z").alias("z_peak"),
        gained.alias("emission_gain"),
        backed.alias("median_support_gain"),
        (F.col("p.agreed") - F.col("base_agreed")).alias("consensus_gain"),
        (F.col("p.breadth") - F.col("base_breadth")).alias("breadth_gain"),
        F.when(gained > 0, backed / gained).alias("support_ratio"),
        (F.col("p.share") - F.col("p.agreed")).alias("divergence_consensus_peak"),
        (F.col("p.share") - F.col("p.support")).alias("divergence_support_peak"),
        ((gained > 0) & (backed < ratio * gained)).alias("unsupported"),
        F.coalesce((F.col("_then") == F.col("occupant")) & (F.col("_share") - F.col("base_share") >= 0.5 * gained), F.lit(False)).alias("sustained"),
        "excess_alpha",
        "excess_tao",
    )


def boosters(found: DataFrame, rows: DataFrame, weights: DataFrame) -> DataFrame:
    """(netuid, uid, t_start, boosting_validators, boosting_stake_share): the scorers whose share for the miner at the event's peak is 1 / miners, and twice what scorers gave it before, above their own mean of the `length` snapshots ahead of it. found: events()."""
    event = found.select(*SLOT, "t_start", "t_peak", "length", "n_miners")
    rowsum = weights.groupBy(*K, "src").agg(F.sum("w").alias("_row"))
    part = weights.join(rowsum, [*K, "src"]).select("netuid", F.col("t").alias("_t"), "src", F.col("dest").alias("uid"), (F.col("w") / F.col("_row")).alias("s"))
    at = event.join(scorers(rows, weights).select("netuid", F.col("t").alias("t_peak"), "src", "influence"), ["netuid", "t_peak"])
    now = at.join(part.select("netuid", F.col("_t").alias("t_peak"), "src", "uid", F.col("s").alias("now")), ["netuid", "t_peak", "src", "uid"], "left").fillna(0, ["now"])
    before = event.join(part, SLOT).filter((F.col("_t") < F.col("t_start")) & (F.col("_t") >= F.col("t_start") - F.col("length"))).groupBy(*SLOT, "t_start", "src").agg(F.sum("s").alias("_sum"))
    both = now.join(before, [*SLOT, "t_start", "src"], "left").withColumn("base", F.when(F.col("t_start") > 0, F.coalesce("_sum", F.lit(0.0)) / F.least("t_start", "length")).otherwise(F.col("now")))
    mean = F.avg("base").over(Window.partitionBy(*SLOT, "t_start"))
    both = both.withColumn("boost", F.col("now") - F.col("base") >= F.greatest(1 / F.col("n_miners"), 2 * mean))
    total = F.sum("influence")
    return both.groupBy(*SLOT, "t_start").agg(F.count_if("boost").alias("boosting_validators"), F.when(total > 0, F.sum(F.when(F.col("boost"), F.col("influence")).otherwise(0)) / F.when(total > 0, total)).alias("boosting_stake_share"))


def separated(times: Column, gap: Column) -> Column:
    """How many of the sorted times count if each counted one lies at least `gap` after the one counted before it."""
    start = F.struct(F.lit(0).alias("n"), F.lit(-(10**9)).cast("long").alias("last"))
    step = lambda a, x: F.when(x - a["last"] >= gap, F.struct((a["n"] + 1).alias("n"), x.cast("long").alias("last"))).otherwise(a)
    return F.aggregate(F.array_sort(times), start, step, lambda a: a["n"])


def repetition(found: DataFrame, rows: DataFrame, times: DataFrame, days: float = 1.0, least: int = 2) -> DataFrame:
    """A row an occupant with events: spikes, unsupported ones, snapshots as a miner, unsupported excess, whether it is a repeat offender."""
    gap = times.groupBy("netuid").agg(F.first(snaps(days)).alias("_gap"))
    seen = rows.filter("is_miner").groupBy("netuid", "occupant").agg(F.count("*").alias("exposure_snapshots"))
    bare = F.when(F.col("unsupported"), F.col("t_start"))
    done = found.groupBy("netuid", "occupant").agg(F.collect_list("t_start").alias("_all"), F.collect_list(bare).alias("_uns"), F.sum(F.when(F.col("unsupported"), F.col("excess_alpha")).otherwise(0.0)).alias("unsupported_excess_alpha"))
    done = done.join(gap, "netuid").join(seen, ["netuid", "occupant"], "left").fillna(0, ["exposure_snapshots"])
    done = done.withColumn("spikes", separated(F.col("_all"), F.col("_gap"))).withColumn("unsupported_spikes", separated(F.col("_uns"), F.col("_gap")))
    return done.withColumn("repeat_offender", F.col("unsupported_spikes") >= least).drop("_all", "_uns", "_gap")


def concentration(miners: DataFrame, rows: DataFrame, times: DataFrame, days: float = 3.0) -> DataFrame:
    """(netuid, miners, events, chi2, p_value): are unsupported spikes spread as the miners' time is? Null below five events or miners. miners: repetition()."""
    seen = shares(rows).filter("is_miner").groupBy("netuid", "occupant").agg(F.count("*").alias("n"), F.avg("miner_emi_share").alias("s"))
    able = seen.join(times.groupBy("netuid").agg(F.first(snaps(days)).alias("_l")), "netuid").filter("n >= 2 * _l and s > 0")
    able = able.join(miners.select("netuid", "occupant", F.col("unsupported_spikes").alias("k")), ["netuid", "occupant"], "left").fillna(0, ["k"])
    market = Window.partitionBy("netuid")
    able = able.withColumn("e", F.sum("k").over(market) / F.sum("n").over(market) * F.col("n"))
    out = able.groupBy("netuid").agg(F.count("*").alias("miners"), F.sum("k").alias("events"), F.sum(F.when(F.col("e") > 0, (F.col("k") - F.col("e")) * (F.col("k") - F.col("e")) / F.when(F.col("e") > 0, F.col("e")))).alias("chi2"))
    return out.withColumn("chi2", F.when((F.col("events") >= 5) & (F.col("miners") >= 5), F.col("chi2"))).withColumn("p_value", F.when(F.col("chi2").isNotNull(), chi2_p(F.coalesce("chi2", F.lit(0.0)), (F.col("miners") - 1).cast("double"))))


def churn(rows: DataFrame, top: int = 10) -> DataFrame:
    """(netuid, rank_churn, topk_turnover): the mean change of percentile rank of miners that stay, and the mean part of the top k occupants that is new (ties: the lower slot first)."""
    own = shares(rows)
    m = Window.partitionBy(*K)
    miner = own.filter("is_miner").withColumn("_r", F.rank().over(m.orderBy("miner_emi_share")) + (F.count("*").over(Window.partitionBy(*K, "miner_emi_share")) - 1) / 2)
    n = F.count("*").over(m)
    miner = miner.withColumn("pct", F.when(n > 1, (F.col("_r") - 1) / F.when(n > 1, n - 1)).otherwise(0.0))
    slot = Window.partitionBy(*SLOT).orderBy("t")
    moved = miner.withColumn("_d", F.when((F.lag("t").over(slot) == F.col("t") - 1) & ~F.col("replaced"), F.abs(F.col("pct") - F.lag("pct").over(slot))))
    rank = moved.groupBy(*K).agg(F.avg("_d").alias("_c")).groupBy("netuid").agg(F.avg("_c").alias("rank_churn"))
    best = own.withColumn("_n", F.row_number().over(m.orderBy(F.desc("miner_emi_share"), "uid"))).filter(F.col("_n") <= top).groupBy(*K).agg(F.collect_set("occupant").alias("names"))
    market = Window.partitionBy("netuid").orderBy("t")
    turn = best.withColumn("_t", F.when(F.lag("t").over(market) == F.col("t") - 1, 1 - F.size(F.array_intersect("names", F.lag("names").over(market))) / top)).groupBy("netuid").agg(F.avg("_t").alias("topk_turnover"))
    return rank.join(turn, "netuid", "full")


def mechanism(rows: DataFrame, burn: float = 0.5, top1: float = 0.5, top10: float = 0.7) -> DataFrame:
    """(netuid, top1_share, top10_share, effective_miners, burn_share, mechanism_type) from medians over snapshots that pay miners."""
    own = shares(rows)
    ranked = own.withColumn("_n", F.row_number().over(Window.partitionBy(*K).orderBy(F.desc("miner_emi_share"), "uid")))
    each = ranked.groupBy(*K).agg(F.max("miner_emi_share").alias("a"), F.sum(F.when(F.col("_n") <= 10, F.col("miner_emi_share"))).alias("b"), F.sum(F.col("miner_emi_share") * F.col("miner_emi_share")).alias("c"), F.coalesce(F.sum(F.when(F.col("uid") == F.col("owner_uid"), F.col("inc_share"))), F.lit(0.0)).alias("d"))
    live = lambda x: F.percentile(F.when(F.col("c") > 0, x), 0.5)
    out = each.groupBy("netuid").agg(live(F.col("a")).alias("top1_share"), live(F.col("b")).alias("top10_share"), live(1 / F.greatest(F.col("c"), F.lit(1e-12))).alias("effective_miners"), F.percentile("d", 0.5).alias("burn_share"))
    kind = F.when(F.col("burn_share") >= burn, "burn_dominated").when(F.col("top1_share") >= top1, "winner_take_all").when(F.col("top10_share") >= top10, "concentrated").otherwise("distributed")
    return out.withColumn("mechanism_type", kind)


def classify(rows: DataFrame, burn: float = 0.5, top1: float = 0.5, top10: float = 0.7, stable: float = 0.6, root: str = "0") -> DataFrame:
    """(netuid, mechanism_type, type_stability, main_snapshot_type, median_working_miners, ..., type_breakdown): each snapshot is judged, the most common type wins (ties: the first by name); below `stable` the market is mixed."""
    own = shares(rows)
    ranked = own.withColumn("_n", F.row_number().over(Window.partitionBy(*K).orderBy(F.desc("miner_emi_share"), "uid")))
    each = ranked.groupBy(*K).agg(F.count_if("is_miner").alias("n"), F.max("miner_emi_share").alias("a"), F.sum(F.when(F.col("_n") <= 10, F.col("miner_emi_share"))).alias("b"), F.sum(F.col("miner_emi_share") * F.col("miner_emi_share")).alias("c"), F.coalesce(F.sum(F.when(F.col("uid") == F.col("owner_uid"), F.col("inc_share"))), F.lit(0.0)).alias("d"))
    kind = F.when(F.col("n") == 0, "no_paid_miners").when(F.col("d") >= burn, "burn_dominated").when(F.col("a") >= top1, "winner_take_all").when(F.col("b") >= top10, "concentrated").otherwise("distributed")
    each = each.withColumn("kind", kind)
    paid = lambda x: F.percentile(F.when(F.col("n") > 0, x), 0.5)
    medians = each.groupBy("netuid").agg(F.percentile("n", 0.5).alias("median_working_miners"), F.percentile("d", 0.5).alias("median_burn_share"), paid(F.col("a")).alias("median_top1_share"), paid(F.col("b")).alias("median_top10_share"), paid(1 / F.when(F.col("c") > 0, F.col("c"))).alias("median_effective_miners"))
    counts = each.groupBy("netuid", "kind").agg(F.count("*").alias("k")).withColumn("part", F.col("k") / F.sum("k").over(Window.partitionBy("netuid")))
    sorted_ = F.array_sort(F.collect_list(F.struct((-F.col("k")).alias("k"), "kind", "part")))
    told = counts.groupBy("netuid").agg(sorted_.alias("x"))
    main, share = F.col("x")[0]["kind"], F.col("x")[0]["part"]
    text = F.concat_ws(" · ", F.transform("x", lambda y: F.concat_ws(" ", y["kind"], F.concat(F.bround(y["part"] * 100).cast("int").cast("string"), F.lit("%")))))
    told = told.select("netuid", F.when(F.col("netuid").cast("string") == root, "root").when(share < stable, "mixed").otherwise(main).alias("mechanism_type"), F.round(share, 2).alias("type_stability"), main.alias("main_snapshot_type"), text.alias("type_breakdown"))
    return told.join(medians, "netuid")


def systematic(miners: DataFrame, kinds: DataFrame, p: float = 0.01, least: int = 2) -> DataFrame:
    """miners (repetition()) with their market's mechanism_type, the rate of unsupported spikes of all others of that type, smoothed, the exact one-sided binomial p-value, and the flag."""
    both = miners.join(kinds.select("netuid", "mechanism_type"), "netuid", "left")
    kind = Window.partitionBy("mechanism_type")
    rate = (F.sum("unsupported_spikes").over(kind) - F.col("unsupported_spikes") + 1) / (F.sum("spikes").over(kind) - F.col("spikes") + 2)
    both = both.withColumn("others_rate", rate).withColumn("_n", F.greatest("spikes", "unsupported_spikes"))
    both = both.withColumn("systematic_p_value", F.when(F.col("_n") > 0, binomial_p("unsupported_spikes", "_n", "others_rate"))).drop("_n")
    return both.withColumn("systematic_offender", (F.col("systematic_p_value") < p) & (F.col("unsupported_spikes") >= least))
