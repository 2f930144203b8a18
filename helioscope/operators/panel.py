"""Panel operators: concentration, shares, ranks and turnover of members within (market, snapshot) groups.

All take a table of states and the names of its columns; amounts are whole numbers, so sums don't depend on their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def share(value: str, over: list[str]) -> Column:
    """A row's share of its group's sum; 0 where the value is missing or the sum is 0."""
    total = F.sum(value).over(Window.partitionBy(*over))
    return F.coalesce(F.coalesce(F.col(value), F.lit(0)) / F.nullif(total, F.lit(0)), F.lit(0.0))


def average_rank(value: str, over: list[str]) -> Column:
    """Rank from 1 with ties at the mean of their places."""
    return F.rank().over(Window.partitionBy(*over).orderBy(value)) + (F.count("*").over(Window.partitionBy(*over, value)) - 1) / 2


def percent_rank(value: str, over: list[str]) -> Column:
    """(average rank - 1) / (m - 1); 0 in a group of one."""
    n = F.count("*").over(Window.partitionBy(*over))
    return F.when(n > 1, (average_rank(value, over) - 1) / (n - 1)).otherwise(0.0)


def concentration(states: DataFrame, keys: list[str], value: str, k: int = 10) -> DataFrame:
    """Gini, top-k share, Herfindahl index and effective number of each group; null where nothing is held."""
    up, down = Window.partitionBy(*keys).orderBy(value), Window.partitionBy(*keys).orderBy(F.desc(value))
    rows = states.select(*keys, F.coalesce(value, F.lit(0)).alias("x"))
    rows = rows.withColumn("up", F.row_number().over(up.orderBy("x"))).withColumn("down", F.row_number().over(down.orderBy(F.desc("x"))))
    g = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("up")).alias("w"), F.sum(F.when(F.col("down") <= k, F.col("x"))).alias("top"), F.sum(F.col("x").cast("decimal(19,0)") * F.col("x").cast("decimal(19,0)")).alias("q"))
    s, q = F.col("s").cast("double"), F.col("q").cast("double")
    held = lambda c: F.when(F.col("s") > 0, c)
    return g.select(*keys, "n", held(2.0 * F.col("w") / (F.col("n") * s) - (F.col("n") + 1) / F.col("n")).alias("gini"), held(F.col("top") / s).alias("top_share"), held(q / (s * s)).alias("hhi"), held(s * s / q).alias("effective_n"))


def previous(states: DataFrame, keys: list[str], t: str, *values: str) -> DataFrame:
    """Adds prev_<value>: the value one snapshot before, null if that snapshot lacks the member."""
    w = Window.partitionBy(*keys).orderBy(t)
    lagged = [F.when(F.lag(t).over(w) == F.col(t) - 1, F.lag(v).over(w)).alias(f"prev_{v}") for v in values]
    return states.select("*", *lagged)


def rank_correlation(rows: DataFrame, keys: list[str], a: str, b: str, least: int = 5) -> DataFrame:
    """Spearman's correlation of a and b over complete pairs; null under `least` pairs or if one side is constant. Doubled ranks keep all sums whole."""
    full = rows.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    ranked = full.select(*keys, (2 * average_rank(a, keys)).cast("long").alias("x"), (2 * average_rank(b, keys)).cast("long").alias("y"))
    s = ranked.groupBy(*keys).agg(F.count("*").alias("n"), *[F.sum(e).alias(n) for n, e in (("sx", F.col("x")), ("sy", F.col("y")), ("sxy", F.col("x") * F.col("y")), ("sxx", F.col("x") * F.col("x")), ("syy", F.col("y") * F.col("y")))])
    vx, vy, c = (F.col("n") * F.col(q) - F.col(p) * F.col(r) for q, p, r in (("sxx", "sx", "sx"), ("syy", "sy", "sy"), ("sxy", "sx", "sy")))
    return s.select(*keys, "n", F.when((F.col("n") >= least) & (vx > 0) & (vy > 0), c.cast("double") / F.sqrt(vx.cast("double") * vy.cast("double"))).alias("r"))


def auc(rows: DataFrame, keys: list[str], score: str, label: str) -> DataFrame:
    """Area under the ROC curve from average ranks; null if a class is empty, rows without score left out."""
    ranked = rows.filter(F.col(score).isNotNull()).select(*keys, (2 * average_rank(score, keys)).cast("long").alias("r"), label)
    g = ranked.groupBy(*keys).agg(F.count(F.when(F.col(label), 1)).alias("pos"), F.count(F.when(~F.col(label), 1)).alias("neg"), F.sum(F.when(F.col(label), F.col("r"))).alias("s"))
    p, n = F.col("pos"), F.col("neg")
    return g.select(*keys, F.when((p > 0) & (n > 0), (F.col("s") - p * (p + 1)) / (2.0 * p * n)).alias("auc"))


def smallest_cover(rows: DataFrame, keys: list[str], value: str, tie: str, cover: float = 0.5, cap: float = 0.2) -> DataFrame:
    """The fewest largest gainers that hold `cover` of all gains, at most floor(cap * group), at least one."""
    n = F.count("*").over(Window.partitionBy(*keys))
    gains = rows.withColumn("group_n", n).filter(F.col(value) > 0)
    w = Window.partitionBy(*keys).orderBy(F.desc(value), tie)
    before = F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, -1))
    ranked = gains.withColumn("place", F.row_number().over(w)).withColumn("before", F.coalesce(before, F.lit(0))).withColumn("gains", F.sum(value).over(Window.partitionBy(*keys)))
    return ranked.filter((F.col("before") < cover * F.col("gains")) & (F.col("place") <= F.greatest(F.floor(F.col("group_n") * cap), F.lit(1)))).drop("group_n", "before", "gains")
