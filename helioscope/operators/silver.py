"""Columns derived from the silver tables: time, membership, identity, shares, value, weights and support.

All are windows or aggregations by (netuid, t) or (netuid, uid), whose groups are bounded by the members of a market or
its snapshots. A missing incentive means that the slot doesn't exist.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = ["netuid", "t"]
SECONDS_PER_BLOCK, RAO, EPS = 12, 1e9, 1e-6


def share(x: Column, keys: list[str] = K) -> Column:
    """x over its sum within keys; nulls count 0, and where the sum is 0 all shares are."""
    own, total = F.coalesce(x, F.lit(0)), F.sum(F.coalesce(x, F.lit(0))).over(Window.partitionBy(*keys))
    return F.when(total != 0, own / total).otherwise(F.lit(0.0))


def timed(snapshots: DataFrame) -> DataFrame:
    """Adds hours, interval_blocks, spacing_blocks, period_days, tempo_v and price to each snapshot."""
    market, order = Window.partitionBy("netuid"), Window.partitionBy("netuid").orderBy("t")
    block = F.col("block")
    price = F.try_divide(F.col("subnet_tao").cast("double"), F.col("alpha_in").cast("double"))
    rows = snapshots.withColumn("_step", block - F.lag("block").over(order))
    return rows.select(
        *snapshots.columns,
        ((block - F.first("block").over(order)) * SECONDS_PER_BLOCK / 3600).alias("hours"),
        F.coalesce(F.lead("block").over(order) - block, F.col("_step"), F.lit(1)).alias("interval_blocks"),
        F.coalesce(F.percentile("_step", 0.5).over(market), F.lit(1.0)).alias("spacing_blocks"),
        ((F.max("block").over(market) - F.min("block").over(market)) * SECONDS_PER_BLOCK / 86400).alias("period_days"),
        F.when(F.col("tempo") > 0, F.col("tempo").cast("double")).otherwise(360.0).alias("tempo_v"),
        F.when(price > 0, price).alias("price"),
    )


def snaps(days: float, spacing: Column | str = "spacing_blocks") -> Column:
    """How many snapshots `days` last, one at least; halves go to the even number."""
    return F.greatest(F.lit(1), F.bround(F.lit(days * 86400.0) / (F.col(spacing) if isinstance(spacing, str) else spacing) / SECONDS_PER_BLOCK).cast("int"))


def flags(states: DataFrame) -> DataFrame:
    """(netuid, has_hotkeys, has_reg_block, has_stake_weight): what a market's table has at all."""
    return states.groupBy("netuid").agg(F.bool_or(F.coalesce(F.col("hotkey") != "", F.lit(False))).alias("has_hotkeys"), F.bool_or(F.col("reg_block").isNotNull()).alias("has_reg_block"), (F.sum(F.coalesce("stake_weight", F.lit(0))) > 0).alias("has_stake_weight"))


def members(states: DataFrame, snapshots: DataFrame, min_share: float = 0.001) -> DataFrame:
    """states with exists, is_validator, is_registered_miner, owner_uid, is_owner, is_miner, replaced and occupant.

    A working miner is a registered one with min_share of what the registered ones earn, the owner included in
    that sum and then left out. A member is replaced where its name or its registration block differ from those of the
    snapshot just before; a name is its occupant, or in a market without names its slot and number of replacements.
    """
    market = Window.partitionBy("netuid")
    slot = Window.partitionBy("netuid", "uid").orderBy("t")
    hotkey = F.coalesce(F.col("hotkey"), F.lit(""))
    rows = states.join(snapshots.select(*K, F.coalesce("owner_hotkey", F.lit("")).alias("_owner")), K)
    rows = rows.withColumn("exists", F.col("incentive").isNotNull()).withColumn("is_validator", F.coalesce(F.col("vpermit") > 0, F.lit(False)))
    rows = rows.withColumn("is_registered_miner", F.col("exists") & ~F.col("is_validator"))
    named = F.bool_or(hotkey != "").over(market) & F.bool_or(F.col("_owner") != "").over(market)
    rows = rows.withColumn("_named", named).withColumn("_has", F.bool_or(hotkey != "").over(market))
    rows = rows.withColumn("owner_uid", F.when(F.col("_named"), F.coalesce(F.min(F.when(hotkey == F.col("_owner"), F.col("uid"))).over(Window.partitionBy(*K)), F.lit(0))).otherwise(0))
    rows = rows.withColumn("is_owner", F.col("_named") & (F.col("uid") == F.col("owner_uid")) & (hotkey == F.col("_owner")))
    working = F.col("is_registered_miner") & (share(F.when(F.col("is_registered_miner"), F.col("incentive"))) >= min_share) & ~F.col("is_owner")
    before = F.lag("t").over(slot) == F.col("t") - 1
    old = F.lag(hotkey).over(slot)
    changed = ((hotkey != old) & (hotkey != "") & (old != "")) | F.coalesce(F.col("reg_block") != F.lag("reg_block").over(slot), F.lit(False))
    rows = rows.withColumn("is_miner", working).withColumn("replaced", F.coalesce(before & changed, F.lit(False)))
    epoch = F.concat_ws(":", "uid", F.sum(F.col("replaced").cast("int")).over(slot))
    return rows.withColumn("occupant", F.when(F.col("_has"), hotkey).otherwise(epoch)).drop("_owner", "_named", "_has")


def shares(rows: DataFrame) -> DataFrame:
    """members() with inc_share, emi_share, div_share and miner_emi_share, the miners' shares of what they earn."""
    return rows.withColumn("inc_share", share(F.col("incentive"))).withColumn("emi_share", share(F.col("emission"))).withColumn("div_share", share(F.col("dividends"))).withColumn("miner_emi_share", share(F.when(F.col("is_miner"), F.col("incentive"))))


def flows(rows: DataFrame, snapshots: DataFrame) -> DataFrame:
    """members() with alpha_flow and tao_flow: what a slot is paid over the interval that its snapshot stands for. snapshots: timed()."""
    rows = rows.join(snapshots.select(*K, "interval_blocks", "tempo_v", "price"), K)
    rows = rows.withColumn("alpha_flow", F.coalesce(F.col("emission"), F.lit(0)) / RAO * (F.col("interval_blocks") / (F.col("tempo_v") + 1)))
    return rows.withColumn("tao_flow", F.col("alpha_flow") * F.coalesce("price", F.lit(0.0)))


def normalized(weights: DataFrame) -> DataFrame:
    """weights with share, a weight's part of its row."""
    return weights.withColumn("share", F.col("w") / F.sum("w").over(Window.partitionBy(*K, "src")))


def scorers(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """(netuid, t, src, influence): validators with a permit and a row of weights. Influence is the stake weight, or the trust where no scorer of the snapshot has stake weight."""
    own = rows.filter("is_validator").select(*K, F.col("uid").alias("src"), F.coalesce("stake_weight", F.lit(0)).alias("_s"), F.coalesce("vtrust", F.lit(0)).alias("_v"))
    own = own.join(weights.filter("w > 0").select(*K, "src").distinct(), [*K, "src"], "left_semi")
    return own.select(*K, "src", F.when(F.sum("_s").over(Window.partitionBy(*K)) > 0, F.col("_s")).otherwise(F.col("_v")).alias("influence"))


def grid(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """(netuid, t, src, influence, uid, w, row): every scorer with every miner, weight 0 where none is given; row: the scorer's whole row."""
    sources = scorers(rows, weights).join(weights.groupBy(*K, "src").agg(F.sum("w").alias("row")), [*K, "src"])
    pairs = sources.join(rows.filter("is_miner").select(*K, "uid"), K)
    return pairs.join(weights.withColumnRenamed("dest", "uid"), [*K, "src", "uid"], "left").fillna(0, ["w"])


def support(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """(netuid, t, uid, median, mean, breadth, cv, consensus) of each miner's weights, each scorer's row taken over miners alone; median, mean and consensus as shares among miners. Snapshots without scorers are left out."""
    row = Window.partitionBy(*K, "src")
    given = grid(rows, weights).withColumn("n", F.count("*").over(row)).withColumn("s", F.col("w") / F.greatest(F.sum("w").over(row).cast("double"), F.lit(1e-12)))
    found = given.groupBy(*K, "uid").agg(F.percentile("s", 0.5).alias("median"), F.avg("s").alias("mean"), F.avg((F.col("s") >= 1 / F.col("n")).cast("double")).alias("breadth"), F.stddev_pop("s").alias("_sd"))
    found = found.join(rows.select(*K, "uid", "consensus"), [*K, "uid"])
    return found.select(*K, "uid", share(F.col("median")).alias("median"), share(F.col("mean")).alias("mean"), "breadth", F.when(F.col("mean") > 0, F.col("_sd") / F.col("mean")).otherwise(0.0).alias("cv"), share(F.col("consensus")).alias("consensus"))


def trajectories(rows: DataFrame) -> DataFrame:
    """(netuid, t, uid, level) of miners: the logarithm of a miner's share less the snapshot's median of it. rows: shares()."""
    log = F.log(F.col("miner_emi_share") + EPS)
    return rows.filter("is_miner").select(*K, "uid", log.alias("_l")).select(*K, "uid", (F.col("_l") - F.percentile("_l", 0.5).over(Window.partitionBy(*K))).alias("level"))


def preferences(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """(netuid, src, uid, preference): the mean over time of the logarithm of a scorer's share for a miner, less the mean over that snapshot's scorers; snapshots with one scorer say nothing."""
    given = grid(rows, weights).withColumn("_l", F.log(F.col("w") / F.col("row") + EPS))
    member = Window.partitionBy(*K, "uid")
    centred = given.withColumn("_n", F.count("*").over(member)).withColumn("_c", F.col("_l") - F.avg("_l").over(member)).filter("_n >= 2")
    return centred.groupBy("netuid", "src", "uid").agg(F.avg("_c").alias("preference"))
