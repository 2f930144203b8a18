"""Sequence operators over one member's or market's snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def ordered(keys: list[str], t: str) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(t)


def trailing_mean(value: str, w: WindowSpec, length: int) -> Column:
    """Mean of the `length` rows before this one; null with fewer than max(3, length // 2) values."""
    f = w.rowsBetween(-length, -1)
    return F.when(F.count(value).over(f) >= max(3, length // 2), F.sum(value).over(f) / F.count(value).over(f))


def trailing_robust_z(rows: DataFrame, keys: list[str], t: str, value: str, length: int) -> DataFrame:
    """Adds median, mad and z = (x - median) / (1.4826 * MAD) over the `length` rows before.

    At MAD 0 the population deviation of those rows stands in, at least 1e-9. z is null in the first `length`
    rows and with fewer than max(3, length // 2) values; NaN counts as missing.
    """
    w = ordered(keys, t)
    held = rows.withColumn("_b", F.collect_list(F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double"))).over(w.rowsBetween(-length, -1))).withColumn("_at", F.row_number().over(w))
    middle = lambda a: f"(get(array_sort({a}), int((size({a}) - 1) div 2)) + get(array_sort({a}), int(size({a}) div 2))) / 2.0D"
    total = lambda e: f"aggregate(_b, 0D, (s, v) -> s + {e})"
    held = held.withColumn("median", F.expr(f"case when size(_b) >= {max(3, length // 2)} then {middle('_b')} end"))
    held = held.withColumn("_d", F.expr("transform(_b, v -> abs(v - median))")).withColumn("mad", F.expr(f"case when median is not null then {middle('_d')} end"))
    held = held.withColumn("_m", F.expr(f"{total('v')} / nullif(size(_b), 0)"))
    spread = F.expr(f"case when array_min(_b) < array_max(_b) then greatest(sqrt({total('(v - _m) * (v - _m)')} / nullif(size(_b), 0)), 1e-9D) else 1e-9D end")
    z = (F.col(value) - F.col("median")) / F.when(F.col("mad") > 0, 1.4826 * F.col("mad")).otherwise(spread)
    return held.withColumn("z", F.when((F.col("_at") > length) & F.col("mad").isNotNull(), z)).drop("_b", "_d", "_m", "_at")


def sessions(rows: DataFrame, keys: list[str], t: str, gap: int) -> DataFrame:
    """Runs of events at most `gap` apart: (keys, session, first, last, n)."""
    w = ordered(keys, t)
    new = F.when(F.col(t) - F.lag(t).over(w) <= gap, 0).otherwise(1)
    runs = rows.select(*keys, t, new.alias("new")).withColumn("session", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*keys, "session").agg(F.min(t).alias("first"), F.max(t).alias("last"), F.count("*").alias("n"))


def separated_count(rows: DataFrame, keys: list[str], t: str, gap: int) -> DataFrame:
    """How many events count if each must come `gap` or more after the last counted one."""
    fold = f"aggregate(array_sort(ts), named_struct('n', 0L, 'last', -1000000000L), (s, x) -> case when x - s.last >= {gap} then named_struct('n', s.n + 1L, 'last', cast(x as bigint)) else s end, s -> s.n)"
    return rows.groupBy(*keys).agg(F.collect_list(t).alias("ts")).select(*keys, F.expr(fold).alias("n"))


def row_windows(rows: DataFrame, keys: list[str], t: str, width: int, step: int) -> DataFrame:
    """A row for each window [a, a + width) of snapshots that a row lies in; starts are multiples of step and windows end within the data."""
    last = F.max(t).over(Window.partitionBy(*keys))
    low = F.greatest(F.ceil((F.col(t) - width + 1) / step), F.lit(0)).cast("int")
    high = F.least(F.floor(F.col(t) / step), F.floor((last + 1 - width) / step)).cast("int")
    placed = rows.withColumn("_lo", low).withColumn("_hi", high).filter("_hi >= _lo")
    return placed.withColumn("start", F.explode(F.transform(F.sequence("_lo", "_hi"), lambda x: x * step))).drop("_lo", "_hi")


def forward_fill(rows: DataFrame, keys: list[str], t: str, value: str) -> DataFrame:
    """Adds filled: the last known value up to this row."""
    return rows.withColumn("filled", F.last(value, ignorenulls=True).over(ordered(keys, t).rowsBetween(Window.unboundedPreceding, 0)))


def quintile(value: str, tie: str, keys: list[str]) -> Column:
    """Five bins of equal rank width, as interpolated quantile edges cut them; ties broken by `tie`."""
    w = Window.partitionBy(*keys)
    r, n = F.row_number().over(w.orderBy(value, tie)), F.count("*").over(w)
    return F.greatest(F.lit(0), F.ceil((r - 1) * 5 / F.nullif(n - 1, F.lit(0))) - 1).cast("long")
