"""What is said of whole markets: completeness checks, scoring, observability, the ranking of problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .incidents import band
from .silver import K, flags, flows, shares, snaps, trajectories

SIZE_BANDS, IMPACT_BANDS = [0.05, 0.15, 0.3, 0.5], [0.1, 0.5, 1.0, 3.0]


def completeness(states: DataFrame, times: DataFrame, weights: DataFrame) -> DataFrame:
    """A row a market: what its tables hold and whether its weights look complete (half as many rows as permits, at least)."""
    market = Window.partitionBy("netuid").orderBy("t")
    slots = states.groupBy(*K).agg(F.count_if(F.col("incentive").isNotNull()).alias("n"), F.sum(F.coalesce("vpermit", F.lit(0))).alias("p"), F.sum(F.coalesce("emission", F.lit(0))).alias("e"))
    slots = slots.withColumn("changed", F.coalesce(F.col("n") != F.lag("n").over(market), F.lit(False)))
    of_slots = slots.groupBy("netuid").agg(F.count_if("changed").alias("uid_count_changes"), F.max("p").cast("int").alias("max_validator_permits"), F.count_if(F.col("e") == 0).alias("zero_emission_snapshots"))
    steps = times.withColumn("gap", F.col("block") - F.lag("block").over(market))
    of_times = steps.groupBy("netuid").agg(F.count("*").alias("snapshots"), F.first("spacing_blocks").alias("median_spacing_blocks"), F.coalesce(F.max("gap"), F.lit(0)).alias("max_gap_blocks"), (F.count("price") > 0).alias("has_price"), F.bool_or(F.coalesce(F.col("owner_hotkey") != "", F.lit(False))).alias("has_owner_hotkey"), F.max_by("subnet_tao", "t").alias("last_subnet_tao"))
    of_weights = weights.groupBy("netuid").agg(F.count_distinct("src").alias("weight_rows_seen"))
    out = of_times.join(of_slots, "netuid", "left").join(of_weights, "netuid", "left").fillna(0, ["weight_rows_seen", "max_validator_permits"]).join(flags(states), "netuid", "left")
    out = out.join(states.groupBy("netuid").agg((F.max("uid") + 1).alias("max_uids")), "netuid", "left")
    return out.withColumn("weights_look_complete", (F.col("max_validator_permits") > 0) & (F.col("weight_rows_seen") >= 0.5 * F.col("max_validator_permits")))


def issues(checked: DataFrame) -> DataFrame:
    """(issue, markets): how many markets lack each thing; only what some market lacks. checked: completeness()."""
    lacks = {"Keys missing": ~F.col("has_hotkeys"), "BlockAtRegistration missing": ~F.col("has_reg_block"), "SubnetTAO/SubnetAlphaIn missing": ~F.col("has_price"), "StakeWeight missing": ~F.col("has_stake_weight"), "SubnetOwnerHotkey missing": ~F.col("has_owner_hotkey"), "Far fewer weight rows than validator permits": ~F.col("weights_look_complete"), "Snapshots without emission": F.col("zero_emission_snapshots") > 0, "Number of uids changes": F.col("uid_count_changes") > 0}
    told = F.explode(F.array(*[F.struct(F.lit(name).alias("issue"), flag.cast("int").alias("hit")) for name, flag in lacks.items()]))
    return checked.select(told.alias("x")).groupBy("x.issue").agg(F.sum("x.hit").alias("markets")).filter("markets > 0")


def replacement_gap(rows: DataFrame, times: DataFrame, flagged: DataFrame, days: float = 7.0, least: float = 0.1) -> DataFrame:
    """(netuid, replace_rate_contested, replace_rate_uncontested, replace_rate_gap): are contested miners replaced more often in the days after, among miners of like consensus?

    Every half of that span, the miners that receive `least` of a fair share are dealt into five bins by consensus (ties: by
    slot), if there are five; rates are means over the bins that have miners of both kinds. flagged: market_panel.contested().
    """
    span = times.groupBy("netuid").agg(F.first(snaps(days)).alias("h"), (F.max("t") + 1).alias("n"))
    slot = rows.select("netuid", "t", "uid", "replaced")
    own = flagged.join(rows.filter("is_miner").select(*K, "uid", F.coalesce("consensus", F.lit(0)).alias("c")), [*K, "uid"]).join(span, "netuid")
    own = own.withColumn("m", F.count("*").over(Window.partitionBy(*K)))
    step = F.greatest(F.lit(1), F.floor(F.col("h") / 2))
    own = own.filter((F.col("t") >= 1) & ((F.col("t") - 1) % step == 0) & (F.col("t") < F.col("n") - F.col("h")) & (F.col("received") >= F.lit(least) / F.col("m")))
    own = own.withColumn("k", F.count("*").over(Window.partitionBy(*K))).filter("k >= 5").withColumn("r", F.row_number().over(Window.partitionBy(*K).orderBy("c", "uid")))
    own = own.withColumn("bin", F.greatest(F.lit(0), F.ceil((F.col("r") - 1) * 5 / (F.col("k") - 1)) - 1))
    later = own.select(*K, "uid", "h").join(slot.select("netuid", "uid", F.col("t").alias("_t"), "replaced"), ["netuid", "uid"]).filter((F.col("_t") > F.col("t")) & (F.col("_t") <= F.col("t") + F.col("h"))).groupBy(*K, "uid").agg(F.max("replaced").alias("gone"))
    both = own.join(later, [*K, "uid"], "left").withColumn("gone", F.coalesce(F.col("gone"), F.lit(False)).cast("double"))
    bins = both.groupBy("netuid", "bin").agg(F.avg(F.when(F.col("contested"), F.col("gone"))).alias("a"), F.avg(F.when(~F.col("contested"), F.col("gone"))).alias("b")).filter("a is not null and b is not null")
    out = bins.groupBy("netuid").agg(F.avg("a").alias("replace_rate_contested"), F.avg("b").alias("replace_rate_uncontested"))
    return out.withColumn("replace_rate_gap", F.col("replace_rate_contested") - F.col("replace_rate_uncontested"))


def scoring(panel: DataFrame, rows: DataFrame, times: DataFrame, flagged: DataFrame, low: float = 0.7) -> DataFrame:
    """A row a market: how scorers agree, how independent they are, what goes to contested miners. panel: scorer_metrics()."""
    independent = F.least(F.col("stale_div_share") + F.col("copy_div_share"), F.lit(1.0))
    names = ["validator_agreement", "validator_rank_agreement", "contested_share", "stake_concentration", "stale_validator_share", "copy_validator_share", "stale_div_share", "copy_div_share", "effective_scorers", "contested_emission_share"]
    base = panel.groupBy("netuid").agg(F.avg("n_validators").alias("mean_validators"), *[F.avg(n).alias(n) for n in names], F.avg(independent).alias("non_independent_div_share"), F.avg(F.col("effective_scorers") / F.when(F.col("n_validators") > 0, F.col("n_validators"))).alias("effective_scorer_ratio"))
    paid = flows(rows, times).join(flagged.filter("contested").select(*K, "uid", F.lit(1).alias("_c")), [*K, "uid"], "left")
    hit = F.col("is_miner") & F.col("_c").isNotNull()
    value = paid.groupBy("netuid").agg(F.sum(F.when(hit, F.col("tao_flow")).otherwise(0.0)).alias("contested_tao"), F.sum(F.when(hit, F.col("alpha_flow")).otherwise(0.0)).alias("contested_alpha"), F.sum("alpha_flow").alias("_all"))
    out = base.join(value, "netuid").withColumn("contested_subnet_share", F.col("contested_alpha") / F.when(F.col("_all") > 0, F.col("_all"))).drop("_all")
    return out.withColumn("low_agreement", F.coalesce(F.col("validator_agreement") < low, F.lit(False))).join(replacement_gap(rows, times, flagged), "netuid", "left")


def likeness(rows: DataFrame, times: DataFrame, days: float = 14.0, least: float = 0.1) -> DataFrame:
    """(netuid, window, a, b, similarity) of pairs of stable miners in tumbling windows: the cosine of their centred share trajectories.

    Stable: a miner in every snapshot of the window, never replaced within, with `least` of a fair share. A window's last part counts
    from max(10, half a window) snapshots on, and with three such miners. Pairs are bounded by a market's members.
    """
    span = times.groupBy("netuid").agg(F.first(snaps(days)).alias("w"))
    sized = times.select(*K).join(span, "netuid").withColumn("window", F.floor(F.col("t") / F.col("w"))).withColumn("n", F.count("*").over(Window.partitionBy("netuid", "window"))).filter(F.col("n") >= F.greatest(F.lit(10), F.floor(F.col("w") / 2)))
    own = shares(rows).filter("is_miner").join(sized, K).withColumn("_new", (F.col("replaced") & (F.col("t") > F.col("window") * F.col("w"))).cast("int"))
    stable = own.groupBy("netuid", "window", "uid").agg(F.count("*").alias("k"), F.first("n").alias("n"), F.sum("_new").alias("new"), F.avg("miner_emi_share").alias("s")).filter("k = n and new = 0")
    stable = stable.withColumn("m", F.count("*").over(Window.partitionBy("netuid", "window"))).filter(F.col("s") >= F.lit(least) / F.col("m"))
    stable = stable.withColumn("m", F.count("*").over(Window.partitionBy("netuid", "window"))).filter("m >= 3").select("netuid", "window", "uid")
    level = own.select(*K, "uid", "window").join(stable, ["netuid", "window", "uid"]).join(trajectories(shares(rows)), [*K, "uid"])
    level = level.withColumn("x", F.col("level") - F.avg("level").over(Window.partitionBy("netuid", "window", "uid"))).select(*K, "window", "uid", "x")
    a, b = level.withColumnsRenamed({"uid": "a", "x": "x"}), level.withColumnsRenamed({"uid": "b", "x": "y"})
    norm = F.sqrt(F.sum(F.col("x") * F.col("x")) * F.sum(F.col("y") * F.col("y")))
    met = a.join(b, ["netuid", "t", "window"]).filter("a < b")
    return met.groupBy("netuid", "window", "a", "b").agg(F.when(norm > 0, F.sum(F.col("x") * F.col("y")) / F.when(norm > 0, norm)).otherwise(0.0).alias("similarity"))


def observability(pairs: DataFrame, same: float = 0.99) -> DataFrame:
    """(netuid, indistinguishable_share, observability): the mean over windows of the part of miners that have a double. pairs: likeness()."""
    both = pairs.select("netuid", "window", F.explode(F.array("a", "b")).alias("uid"), "similarity").groupBy("netuid", "window", "uid").agg(F.max("similarity").alias("s"))
    each = both.groupBy("netuid", "window").agg(F.avg((F.col("s") >= same).cast("double")).alias("d"))
    return each.groupBy("netuid").agg(F.avg("d").alias("indistinguishable_share")).withColumn("observability", 1 - F.col("indistinguishable_share"))


def ranking(problems: DataFrame) -> DataFrame:
    """problems (problem, size_value, impact_pct) with size_score, impact_score, priority and rank; the highest priority first, then the impact, then the name."""
    out = problems.withColumn("size_score", band(F.col("size_value"), SIZE_BANDS)).withColumn("impact_score", band(F.col("impact_pct"), IMPACT_BANDS))
    out = out.withColumn("priority", F.col("size_score") * F.col("impact_score"))
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc_nulls_last("priority"), F.desc_nulls_last("impact_pct"), "problem")))  # a row a problem

