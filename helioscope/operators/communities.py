"""Groups of members that behave alike: sliding windows, candidates, layers of likeness between pairs, their mean, and components.

Pairs are made of one window's candidates only, whose number a market's members bound. rows: silver.shares(); times: silver.timed().
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .silver import K, snaps, trajectories

WINDOW = ["netuid", "window"]
FLAT = 1e-12


def windows(times: DataFrame, days: float, step_days: float) -> DataFrame:
    """(netuid, window, a, b): snapshots [a, b) of each sliding window; a market shorter than one, but of ten snapshots or more, is one window."""
    of = times.groupBy("netuid").agg(F.first(snaps(days)).alias("w"), F.first(snaps(step_days)).alias("s"), (F.max("t") + 1).alias("n"))
    starts = F.when(F.col("n") >= F.col("w"), F.sequence(F.lit(0), F.col("n") - F.col("w"), F.col("s"))).when(F.col("n") >= 10, F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
    return of.select("netuid", F.posexplode(starts).alias("window", "a"), F.col("w"), F.col("n")).select("netuid", "window", "a", F.least(F.col("a") + F.col("w"), "n").alias("b"))


def presences(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """rows within each window, with present: a miner that is the named occupant of its slot at the window's end."""
    met = rows.join(spans, "netuid").filter("t >= a and t < b")
    last = met.filter("t = b - 1").select(*WINDOW, "uid", F.col("occupant").alias("_last"))
    return met.join(last, [*WINDOW, "uid"]).withColumn("present", F.coalesce(F.col("is_miner") & (F.col("occupant") == F.col("_last")) & (F.col("_last") != ""), F.lit(False))).drop("_last")


def candidates(rows: DataFrame, spans: DataFrame, presence: float = 0.6, least: float = 0.1) -> DataFrame:
    """(netuid, window, uid, presence, mean_share): members present in that part of a window, with `least` of a fair share of its last snapshot's miners."""
    here = presences(rows, spans)
    own = here.groupBy(*WINDOW, "uid").agg(F.sum(F.col("present").cast("int")).alias("k"), F.first(F.col("b") - F.col("a")).alias("n"), F.sum(F.when(F.col("present"), F.col("miner_emi_share")).otherwise(0.0)).alias("s"))
    at_end = rows.join(spans, "netuid").filter("t = b - 1").groupBy(*WINDOW).agg(F.greatest(F.count_if("is_miner"), F.lit(1)).alias("m"))
    own = own.join(at_end, WINDOW).select(*WINDOW, "uid", (F.col("k") / F.col("n")).alias("presence"), (F.col("s") / F.greatest("k", F.lit(1))).alias("mean_share"), "m")
    return own.filter((F.col("presence") >= presence) & (F.col("mean_share") >= least / F.col("m"))).drop("m")


def correlation(a: str, b: str) -> Column:
    """Pearson's correlation within a group; 0 where a side is flat."""
    flat = (F.var_pop(a) <= FLAT) | (F.var_pop(b) <= FLAT)
    return F.when(flat, 0.0).otherwise(F.covar_pop(a, b) / F.sqrt(F.when(flat, 1.0).otherwise(F.var_pop(a) * F.var_pop(b))))


def share_layers(rows: DataFrame, times: DataFrame, spans: DataFrame, chosen: DataFrame) -> DataFrame:
    """(netuid, window, a, b, trajectory, emission_change) of each pair of candidates.

    trajectory correlates their logarithmic shares less the snapshot's median, their own mean where they are absent;
    emission_change the steps of these, 0 unless a member is present on both sides of a step.
    """
    here = presences(rows, spans).filter("present").join(trajectories(rows), [*K, "uid"]).select(*WINDOW, "t", "uid", "level")
    full = chosen.select(*WINDOW, "uid").join(spans.select(*WINDOW, F.explode(F.sequence("a", F.col("b") - 1)).alias("t")), WINDOW).join(here, [*WINDOW, "t", "uid"], "left")
    member = Window.partitionBy(*WINDOW, "uid")
    full = full.withColumn("x", F.coalesce("level", F.avg("level").over(member)))
    in_time = member.orderBy("t")
    both = F.col("level").isNotNull() & F.lag("level").over(in_time).isNotNull()
    step = F.when(F.lag("t").over(in_time).isNotNull(), F.when(both, F.col("x") - F.lag("x").over(in_time)).otherwise(0.0))
    full = full.withColumn("d", step).select(*WINDOW, "t", "uid", "x", "d")
    one, two = (full.withColumnsRenamed({"uid": n, "x": f"x{n}", "d": f"d{n}"}) for n in "ab")
    return one.join(two, [*WINDOW, "t"]).filter("a < b").groupBy(*WINDOW, "a", "b").agg(correlation("xa", "xb").alias("trajectory"), correlation("da", "db").alias("emission_change"))


def chance_corrected(pairs: DataFrame, layer: str) -> DataFrame:
    """pairs with the layer as its excess over the window's mean, a part of what is left to 1, cut to 0 .. 1; windows of one pair stay as they are."""
    w = Window.partitionBy(*WINDOW)
    mean = F.avg(layer).over(w)
    excess = F.when(mean >= 1, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(layer) - mean) / F.when(mean < 1, 1 - mean))))
    return pairs.withColumn(layer, F.when(F.count("*").over(w) == 1, F.col(layer)).otherwise(excess))


def combined(pairs: DataFrame, weights: dict[str, float], strong: float = 0.8) -> DataFrame:
    """pairs with similarity, the weighted mean of the layers cut to 0 .. 1, and strong, how many of them reach that."""
    cut = {n: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(n))) for n, w in weights.items() if w > 0}
    mean = sum((c * weights[n] for n, c in cut.items()), F.lit(0.0)) / sum(weights[n] for n in cut)
    return pairs.withColumn("similarity", mean).withColumn("strong", sum(((c >= strong).cast("int") for c in cut.values()), F.lit(0)))


def components(nodes: DataFrame, edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, uid, root): root is the least uid that edges (keys, a, b) reach within a group; edges to what is no node count for nothing. nodes: (keys, uid), each once. Groups must be bounded, as a market's members are; one group is one task's work."""
    keys = list(keys)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.select(*keys, "uid").schema) + f", root {nodes.schema['uid'].dataType.simpleString()}"

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        alone = rows["b"].isna()
        root = {x: x for x in rows["a"][alone]}

        def find(x):
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        for a, b in zip(rows["a"][~alone], rows["b"][~alone].astype(rows["a"].dtype), strict=True):
            if a in root and b in root:
                low, high = sorted((find(a), find(b)))
                root[high] = low
        members = rows[alone].rename(columns={"a": "uid"})
        return members.assign(root=[find(x) for x in members["uid"]])[[*keys, "uid", "root"]]

    both = nodes.select(*keys, F.col("uid").alias("a"), F.lit(None).cast(nodes.schema["uid"].dataType).alias("b")).unionByName(edges.select(*keys, "a", "b"))
    return both.groupBy(*keys).applyInPandas(join, schema)
