"""The panel of a market: one row a snapshot. rows: silver.members(); times: silver.timed(); weights: the sparse weights.

Pairs are made only of a snapshot's scorers, whose number the market's permits bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import panel as P
from .silver import K, flows, grid, scorers, shares, snaps

HYPERPARAMETERS = ["tempo", "kappa", "immunity_period", "max_validators", "burn_cost"]


def mean_of(flag: Column) -> Column:
    return F.avg(flag.cast("double"))


def miner_metrics(rows: DataFrame) -> DataFrame:
    """Counts, concentration, turnover and burn of each snapshot. Without miners what is said of them is null."""
    rows = shares(rows)
    slot = Window.partitionBy("netuid", "uid").orderBy("t")
    fresh = F.lag("t").over(slot) == F.col("t") - 1
    rows = rows.withColumn("_moved", F.coalesce(F.coalesce("last_update", F.lit(0)) > F.when(fresh, F.coalesce(F.lag("last_update").over(slot), F.lit(0))), F.coalesce("last_update", F.lit(0)) > 0))
    rows = rows.withColumn("prev_incentive", F.when(fresh & F.lag("is_miner").over(slot) & F.col("is_miner") & ~F.col("replaced"), F.lag("incentive").over(slot)))
    miner = F.col("is_miner")
    total = F.sum(F.coalesce("consensus", F.lit(0))).over(Window.partitionBy(*K))
    rows = rows.withColumn("_gap", F.abs(F.coalesce("consensus", F.lit(0)) / F.greatest(total, F.lit(1)) - F.col("inc_share")))
    out = rows.groupBy(*K).agg(
        F.count_if("exists").alias("n_uids"),
        F.count_if(miner).alias("n_miners"),
        F.count_if("is_registered_miner").alias("n_registered_miners"),
        F.avg(F.when(F.col("exists"), F.col("active"))).alias("active_share"),
        F.avg(F.when(miner, F.col("replaced").cast("double"))).alias("replacement_rate"),
        F.coalesce(F.sum(F.when(F.col("uid") == F.col("owner_uid"), F.col("inc_share"))), F.lit(0.0)).alias("burn_share"),  # an empty slot earns nothing
        (F.sum("_gap") / 2).alias("cons_inc_gap"),
        F.when(F.first("t") > 0, F.count_if(F.col("_moved") & miner & ~F.col("replaced")) / F.greatest(F.count_if(miner), F.lit(1))).alias("miner_weight_setter_share"),
    )
    earned = P.concentration(rows.filter("is_miner"), K, "incentive").select(*K, F.col("gini").alias("gini_inc"))
    paid = P.concentration(rows.filter("exists"), K, "emission").select(*K, F.col("top_share").alias("top10_share"), F.col("hhi").alias("hhi_emission"))
    ranks = P.rank_correlation(rows.filter("prev_incentive is not null"), K, "incentive", "prev_incentive").select(*K, F.col("r").alias("rank_corr"))
    return out.join(earned, K, "left").join(paid, K, "left").join(ranks, K, "left")


def scorer_pairs(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """(netuid, t, a, b, influence, cosine, rank_corr) of each pair of a snapshot's scorers; rank_corr over all slots of the market, those without a weight at 0."""
    own = scorers(rows, weights)
    slots = rows.select("netuid", F.col("uid").alias("dest")).distinct()
    full = own.join(slots, "netuid").join(weights, [*K, "src", "dest"], "left").fillna(0, ["w"])
    row = Window.partitionBy(*K, "src")
    ties = F.count("*").over(Window.partitionBy(*K, "src", "w"))
    full = full.withColumn("r", 2 * F.rank().over(row.orderBy("w")) + ties - 1).select(*K, "src", "dest", "influence", "w", "r")
    a, b = (full.select(*K, "dest", *(F.col(c).alias(f"{c}_{x}") for c in ("src", "influence", "w", "r"))) for x in "ab")
    met = a.join(b, [*K, "dest"]).filter("src_a < src_b")
    n = F.count("*")
    spread = lambda x, y: n * F.sum(F.col(x) * F.col(y)) - F.sum(x) * F.sum(y)
    done = met.groupBy(*K, F.col("src_a").alias("a"), F.col("src_b").alias("b")).agg(
        F.first(F.col("influence_a") * F.col("influence_b")).alias("influence"),
        (F.sum(F.col("w_a") * F.col("w_b")) / F.sqrt(F.sum(F.col("w_a") * F.col("w_a")).cast("double") * F.sum(F.col("w_b") * F.col("w_b")).cast("double"))).alias("cosine"),
        spread("r_a", "r_b").cast("double").alias("_c"),
        spread("r_a", "r_a").cast("double").alias("_a"),
        spread("r_b", "r_b").cast("double").alias("_b"),
    )
    return done.withColumn("rank_corr", F.when((F.col("_a") > 0) & (F.col("_b") > 0), F.col("_c") / F.sqrt(F.col("_a") * F.col("_b")))).drop("_a", "_b", "_c")


def weighted_pair_mean(value: str, weight: str) -> Column:
    """The mean of a value over pairs, weighted; plain where all weights are 0; null where a pair has none."""
    some = F.sum(weight) > 0
    mean = F.when(some, F.sum(F.col(value) * F.col(weight)) / F.when(some, F.sum(weight))).otherwise(F.avg(value))
    return F.when(F.count(value) == F.count("*"), mean)


def contested(rows: DataFrame, weights: DataFrame, least_share: float = 0.1, cv: float = 1.0) -> DataFrame:
    """(netuid, t, uid, received, contested, n_scorers): a miner is contested if two scorers or more give it a fair share on average, with a spread above cv times the mean."""
    given = grid(rows, weights).withColumn("s", F.col("w") / F.col("row"))
    miners = rows.filter("is_miner").groupBy(*K).agg(F.count("*").alias("_n"))
    found = given.groupBy(*K, "uid").agg(F.avg("s").alias("received"), F.stddev_pop("s").alias("_sd"), F.count("*").alias("n_scorers")).join(miners, K)
    flag = (F.col("received") >= F.lit(least_share) / F.col("_n")) & (F.col("_sd") > cv * F.col("received")) & (F.col("n_scorers") >= 2)
    return found.select(*K, "uid", "received", flag.alias("contested"), "n_scorers")


def scorer_flags(rows: DataFrame, times: DataFrame, weights: DataFrame, stale_tempos: float = 2.0, copy_similarity: float = 0.99, copy_persistence: float = 0.8, copy_days: float = 2.0) -> DataFrame:
    """(netuid, t, src, influence, dividend_share, vtrust, stale, closer_to_previous, copying) of each scorer.

    Stale: no update for stale_tempos tempos. Closer to previous: its row resembles the consensus of the snapshot before, and
    more than that of its own. Copying: so now, and in copy_persistence of the last copy_days' snapshots, those without a row included.
    """
    own = scorers(rows, weights).join(rows.select(*K, F.col("uid").alias("src"), "dividends", "vtrust", "last_update"), [*K, "src"])
    own = own.join(times.select(*K, "block", "tempo_v", snaps(copy_days).alias("_k")), K)
    old = F.coalesce(F.col("block") - F.col("last_update") > stale_tempos * F.col("tempo_v"), F.lit(True))
    paid = F.sum("dividends").over(Window.partitionBy(*K))
    own = own.withColumn("stale", old).withColumn("dividend_share", F.when(paid != 0, F.col("dividends") / paid).otherwise(0.0))
    slot = Window.partitionBy("netuid", "uid").orderBy("t")
    now = rows.select(*K, "uid", F.coalesce("consensus", F.lit(0)).alias("c"))
    now = now.withColumn("p", F.when(F.lag("t").over(slot) == F.col("t") - 1, F.lag("c").over(slot)).otherwise(F.when(F.col("t") > 0, 0).otherwise(F.col("c"))))
    norms = now.groupBy(*K).agg(F.sqrt(F.sum(F.col("c") * F.col("c")).cast("double")).alias("nc"), F.sqrt(F.sum(F.col("p") * F.col("p")).cast("double")).alias("np"))
    like = weights.join(now.withColumnRenamed("uid", "dest"), [*K, "dest"], "left").fillna(0, ["c", "p"])
    like = like.groupBy(*K, "src").agg(F.sqrt(F.sum(F.col("w") * F.col("w")).cast("double")).alias("nw"), F.sum(F.col("w") * F.col("c")).cast("double").alias("wc"), F.sum(F.col("w") * F.col("p")).cast("double").alias("wp")).join(norms, K)
    near = lambda dot, norm: F.col(dot) / (F.col("nw") * F.when(F.col(norm) > 0, F.col(norm)).otherwise(1.0))
    like = like.select(*K, "src", ((near("wp", "np") >= copy_similarity) & (near("wp", "np") > near("wc", "nc")) & (F.col("t") > 0)).alias("closer_to_previous"))
    own = own.join(like, [*K, "src"])
    recent = own.select(*K, "src", "_k", "closer_to_previous").alias("x").join(own.select("netuid", "src", F.col("t").alias("_t"), F.col("closer_to_previous").cast("int").alias("_f")).alias("y"), ["netuid", "src"])
    recent = recent.filter((F.col("_t") <= F.col("t")) & (F.col("_t") > F.col("t") - F.col("_k"))).groupBy(*K, "src").agg(F.sum("_f").alias("_sum"))
    window = F.least(F.col("t") + 1, F.col("_k"))
    copying = F.col("closer_to_previous") & (F.col("_sum") / window >= copy_persistence) & (window >= F.least(F.col("_k"), F.lit(4)))
    return own.join(recent, [*K, "src"]).select(*K, "src", "influence", "dividend_share", "vtrust", "stale", "closer_to_previous", copying.alias("copying"))


def scorer_metrics(rows: DataFrame, times: DataFrame, weights: DataFrame, **options) -> DataFrame:
    """What the panel says of scorers and of what they give, a row a snapshot that has any."""
    found = scorer_flags(rows, times, weights, **options)
    share = F.col("influence") / F.greatest(F.sum("influence").over(Window.partitionBy(*K)), F.lit(1))
    base = found.withColumn("_i", share).groupBy(*K).agg(
        F.count("*").alias("n_validators"),
        mean_of(F.col("stale")).alias("stale_validator_share"),
        F.sum(F.when(F.col("stale"), F.col("dividend_share")).otherwise(0.0)).alias("stale_div_share"),
        F.sum(F.col("dividend_share") * F.col("dividend_share")).alias("_d"),
        F.sum(F.col("_i") * F.col("_i")).alias("stake_concentration"),
        F.avg("vtrust").alias("vtrust_mean"),
        mean_of(F.col("copying")).alias("copy_validator_share"),
        F.sum(F.when(F.col("copying"), F.col("dividend_share")).otherwise(0.0)).alias("copy_div_share"),
        F.count_if(~F.col("stale") & ~F.col("copying")).alias("effective_scorers"),
    )
    base = base.withColumn("div_participation", 1 / F.when(F.col("_d") > 0, F.col("_d")).otherwise(1.0)).drop("_d")
    pairs = scorer_pairs(rows, weights).groupBy(*K).agg(weighted_pair_mean("cosine", "influence").alias("validator_agreement"), weighted_pair_mean("rank_corr", "influence").alias("validator_rank_agreement"))
    owner = rows.select(*K, F.col("owner_uid").alias("dest")).distinct()
    given = weights.withColumn("s", F.col("w") / F.sum("w").over(Window.partitionBy(*K, "src"))).join(owner, [*K, "dest"], "left_semi").join(found.select(*K, "src"), [*K, "src"], "left_semi")
    burn = base.select(*K, "n_validators").join(given.groupBy(*K).agg(F.sum("s").alias("_s")), K, "left").select(*K, (F.coalesce("_s", F.lit(0.0)) / F.col("n_validators")).alias("burn_weight_mass"))
    flag = contested(rows, weights).join(shares(rows).select(*K, "uid", "miner_emi_share"), [*K, "uid"])
    flag = flag.groupBy(*K).agg(mean_of(F.col("contested")).alias("contested_share"), F.sum(F.when(F.col("contested"), F.col("miner_emi_share")).otherwise(0.0)).alias("contested_emission_share"))
    return base.join(pairs, K, "left").join(burn, K).join(flag, K, "left")


def value_metrics(rows: DataFrame, times: DataFrame) -> DataFrame:
    """price and the four flows of each snapshot."""
    paid = flows(rows, times)
    of = lambda c, miners: F.sum(F.when(F.col("is_miner") | F.lit(not miners), F.col(c)).otherwise(0.0))
    done = paid.groupBy(*K).agg(F.first("price").alias("price"), of("tao_flow", False).alias("subnet_tao_flow"), of("alpha_flow", False).alias("subnet_alpha_flow"), of("tao_flow", True).alias("miner_tao_flow"), of("alpha_flow", True).alias("miner_alpha_flow"))
    return done


def build(rows: DataFrame, times: DataFrame, weights: DataFrame, **options) -> DataFrame:
    """The whole panel: keys, block and hours, then all metrics; null where a snapshot has no scorers or no miners."""
    base = times.select(*K, "block", "hours", *HYPERPARAMETERS)
    return base.join(miner_metrics(rows), K).join(scorer_metrics(rows, times, weights, **options), K, "left").join(value_metrics(rows, times), K).fillna(0, ["n_validators"])
