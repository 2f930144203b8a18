"""Incident operators: where a market's level shifts, which peaks stand apart, how soon something answers and how long the excess lasts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .sequences import ordered


def split_points(x: np.ndarray, min_size: int, penalty: float, min_effect: float) -> list[int]:
    """Rows at which the mean of x (T rows, d columns) shifts, by repeated halving.

    Columns are standardized. A segment is cut where n1 * n2 / n * |mean1 - mean2|^2, the squared error saved, is
    largest (the first such row); it must exceed penalty, and one column's means must differ by min_effect.
    Rows with a missing value are left out, and places refer to the rows given.
    """
    place = np.flatnonzero(np.isfinite(x).all(1))
    x = x[place]
    if len(x) < 2 * min_size:
        return []
    spread = x.std(0)
    z = (x - x.mean(0)) / np.where(spread > 0, spread, 1)
    before = np.vstack([np.zeros(z.shape[1]), z.cumsum(0)])
    found, todo = [], [(0, len(z))]
    while todo:
        a, b = todo.pop()
        cuts = np.arange(a + min_size, b - min_size + 1)
        if not len(cuts):
            continue
        n1, n2 = (cuts - a)[:, None], (b - cuts)[:, None]
        shift = (before[b] - before[cuts]) / n2 - (before[cuts] - before[a]) / n1
        saved = (n1 * n2 / (b - a) * shift**2).sum(1)
        at = int(saved.argmax())
        if saved[at] > max(penalty, 0.0) and np.abs(shift[at]).max() >= min_effect:
            found.append(int(cuts[at]))
            todo += [(a, found[-1]), (found[-1], b)]
    return sorted(place[found].tolist())


def change_points(rows: DataFrame, keys: list[str], t: str, values: list[str], min_size: int = 4, scale: float = 1.0, min_effect: float = 0.5) -> DataFrame:
    """(keys, t) of each shift in the joint series of values; the penalty is scale * d * ln(max(T, 2)). A group is one market's snapshots."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(t)
        x = group[values].to_numpy(float)
        at = split_points(x, min_size, scale * len(values) * np.log(max(len(x), 2)), min_effect)
        return group.iloc[at][[*keys, t]]

    some = rows.select(*keys, t, *[F.col(v).cast("double").alias(v) for v in values])
    return some.groupBy(*keys).applyInPandas(run, StructType([some.schema[c] for c in (*keys, t)]))


def spaced_peaks(rows: DataFrame, keys: list[str], t: str, score: str, gap: int) -> DataFrame:
    """Rows taken from the highest score down (later t first at a tie), each at least `gap` from all taken before: (keys, t, score)."""
    held = rows.filter(F.col(score).isNotNull()).groupBy(*keys).agg(F.reverse(F.array_sort(F.collect_list(F.struct(F.col(score).alias("score"), F.col(t).cast("long").alias("t"))))).alias("c"))
    kept = F.expr(f"aggregate(c, slice(c, 1, 0), (k, x) -> case when exists(k, y -> abs(y.t - x.t) < {gap}) then k else concat(k, array(x)) end)")
    return held.select(*keys, F.explode(kept).alias("x")).select(*keys, F.col("x.t").alias(t), F.col("x.score").alias(score))


def run_starts(condition: Column, keys: list[str], t: str, length: int) -> Column:
    """True where the condition holds in this and the next length - 1 rows."""
    f = ordered(keys, t).rowsBetween(0, length - 1)
    return (F.sum(F.when(condition, 1).otherwise(0)).over(f) == length) & (F.count(F.lit(1)).over(f) == length)


def recovery(panel: DataFrame, starts: DataFrame, key: str, t: str, value: str, before: int, peak_within: int, unwind: float = 0.75, run: int = 2) -> DataFrame:
    """(key, start, base, peak, peak_t, recovered_t) of each start: base is the mean of the `before` snapshots ahead of it, peak the first
    maximum of the next `peak_within`; recovered_t opens the first `run` snapshots from the peak on with `unwind` of peak - base undone.
    """
    s = starts.select(F.col(key).alias("_k"), F.col(t).alias("start"))
    met = s.join(panel.select(key, t, value), (F.col("_k") == F.col(key)) & (F.col(t) >= F.col("start") - before)).drop("_k")
    ahead, near = F.col(t) < F.col("start"), (F.col(t) >= F.col("start")) & (F.col(t) < F.col("start") + peak_within)
    top = F.max(F.when(near, F.struct(F.col(value).alias("v"), (-F.col(t)).alias("t"))))
    facts = met.groupBy(key, "start").agg((F.sum(F.when(ahead, F.col(value))) / F.count(F.when(ahead, F.col(value)))).alias("base"), top.alias("top"))
    facts = facts.select(key, "start", "base", F.col("top.v").alias("peak"), (-F.col("top.t")).alias("peak_t"))
    later = met.join(facts, [key, "start"]).filter(F.col(t) >= F.col("peak_t"))
    low = F.col(value) <= F.col("base") + (1 - unwind) * (F.col("peak") - F.col("base"))
    back = later.withColumn("_b", run_starts(low, [key, "start"], t, run)).groupBy(key, "start").agg(F.min(F.when(F.col("_b"), F.col(t))).alias("recovered_t"))
    return facts.join(back, [key, "start"], "left")


def first_rise(panel: DataFrame, starts: DataFrame, key: str, t: str, value: str, before: int, horizon: int, rise: float) -> DataFrame:
    """(key, start, response_t): the first snapshot of [start, start + horizon) at least `rise` above the mean of the `before` ones ahead; null if none answers."""
    s = starts.select(F.col(key).alias("_k"), F.col(t).alias("start"))
    met = s.join(panel.select(key, t, value), (F.col("_k") == F.col(key)) & F.col(t).between(F.col("start") - before, F.col("start") + horizon - 1)).drop("_k")
    w = Window.partitionBy(key, "start")
    ahead = F.when(F.col(t) < F.col("start"), F.col(value))
    met = met.withColumn("_m", F.sum(ahead).over(w) / F.nullif(F.count(ahead).over(w), F.lit(0)))
    return met.groupBy(key, "start").agg(F.min(F.when((F.col(t) >= F.col("start")) & (F.col(value) - F.col("_m") >= rise), F.col(t))).alias("response_t"))


def gap_profile(starts: DataFrame, keys: list[str], t: str, low: int, high: int) -> DataFrame:
    """Per group: events n, median gap between consecutive ones, and the share of gaps in [low, high]; both null without a gap."""
    g = starts.withColumn("_g", F.col(t) - F.lag(t).over(ordered(keys, t)))
    return g.groupBy(*keys).agg(F.count("*").alias("n"), F.expr("percentile(_g, 0.5)").alias("median_gap"), (F.count(F.when(F.col("_g").between(low, high), 1)) / F.nullif(F.count("_g"), F.lit(0))).alias("regular_share"))


def spikes(rows: DataFrame, keys: list[str], t: str, value: str, length: int, z: float = 3.0, least: float = 0.0, floor: float = 0.0) -> DataFrame:
    """Adds mean and spike: the value is `least` or more above the mean of the `length` rows before it, and z sample deviations, taken as `floor` at least.

    Without max(3, length // 2) known rows there is no mean and no spike. Whole values keep sums exact.
    """
    f = ordered(keys, t).rowsBetween(-length, -1)
    x = F.col(value)
    n, s, q = F.count(value).over(f), F.sum(value).over(f), F.sum(x.cast("decimal(19,0)") * x.cast("decimal(19,0)")).over(f)
    known = rows.select("*", n.alias("_n"), s.cast("double").alias("_s"), q.cast("double").alias("_q")).withColumn("mean", F.when(F.col("_n") >= max(3, length // 2), F.col("_s") / F.col("_n")))
    spread = F.sqrt(F.greatest(F.col("_n") * F.col("_q") - F.col("_s") * F.col("_s"), F.lit(0.0)) / F.nullif(F.col("_n") * (F.col("_n") - 1), F.lit(0)))
    rise = x - F.col("mean")
    return known.withColumn("spike", F.coalesce((rise >= z * F.greatest(spread, F.lit(floor))) & (rise >= least), F.lit(False))).drop("_n", "_s", "_q")


def dilate(flag: Column, keys: list[str], t: str, back: int, ahead: int) -> Column:
    """True if the flag holds in any of the rows from `back` before to `ahead` after this one."""
    return F.coalesce(F.bool_or(flag).over(ordered(keys, t).rowsBetween(-back, ahead)), F.lit(False))


def variation_distance(rows: DataFrame, keys: list[str], p: str, q: str) -> DataFrame:
    """(keys, gap): half the summed difference of the shares of p and of q within each group; null if either sums to 0."""
    w = Window.partitionBy(*keys)
    part = rows.select(*keys, F.col(p).alias("p"), F.col(q).alias("q"), F.sum(p).over(w).alias("sp"), F.sum(q).over(w).alias("sq"))
    big = lambda c: F.col(c).cast("decimal(19,0)")
    g = part.groupBy(*keys).agg(F.sum(F.abs(big("p") * big("sq") - big("q") * big("sp"))).cast("double").alias("d"), F.max("sp").cast("double").alias("sp"), F.max("sq").cast("double").alias("sq"))
    return g.select(*keys, F.when((F.col("sp") > 0) & (F.col("sq") > 0), F.col("d") / (2.0 * F.col("sp") * F.col("sq"))).alias("gap"))


def band(value: Column, edges: list[float]) -> Column:
    """1 plus the number of edges that the value reaches; null for null."""
    return sum((F.when(value >= e, 1).when(value < e, 0) for e in edges), F.lit(1))
