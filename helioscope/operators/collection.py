"""What a collector needs to know of its tables: due items, the largest markets, remembered owners, expected hours."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def due(blocks: DataFrame, every: Mapping[str, int], index: str = "index") -> DataFrame:
    """blocks with item: a row for each item that is fetched at a block, which is when the block's index divides by the item's cadence."""
    items = F.array(*[F.struct(F.lit(name).alias("item"), F.lit(n).alias("n")) for name, n in every.items()])
    return blocks.withColumn("_i", F.explode(items)).filter(F.col(index) % F.col("_i.n") == 0).withColumn("item", F.col("_i.item")).drop("_i")


def top_markets(rows: DataFrame, value: str, cutoff: int) -> DataFrame:
    """(netuid, total, place) of the `cutoff` markets with the greatest sums; one without any value comes last, ties go by netuid."""
    sums = rows.groupBy("netuid").agg(F.sum(value).alias("total"))
    order = [F.desc_nulls_last("total"), F.asc("netuid")]
    return sums.orderBy(*order).limit(cutoff).withColumn("place", F.row_number().over(Window.orderBy(*order)))  # a window of `cutoff` rows


def last_known(rows: DataFrame, keys: list[str], value: str, *order: str) -> DataFrame:
    """(keys, value): the value of each key's last row that has one."""
    return rows.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value))


def remember(known: DataFrame, seen: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, new): known pairs stay as they are; of keys not known yet the least value seen is added. Null and empty keys are passed over."""
    fresh = seen.filter(F.coalesce(F.col(key) != "", F.lit(False))).join(known, key, "left_anti").groupBy(key).agg(F.min(value).alias(value))
    return known.select(key, value, F.lit(False).alias("new")).unionByName(fresh.withColumn("new", F.lit(True)))


def expected_hours(seconds: Column, blocks: int, every: Column) -> Column:
    """Hours that an item takes over so many blocks, each call taking `seconds`."""
    return seconds * F.ceil(F.lit(blocks) / every) / 3600
