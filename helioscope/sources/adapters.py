"""Views of the driver's tables in the shape of market snapshots; SQL twins are in plans.queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(netuid, t, uid, incentive, last_update, first_seen, n): members of 15 slots of each event type, by day."""
    e = table(spark, sf_dir, "events")
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    return e.groupBy(F.col("event_type").alias("netuid"), day.alias("t"), (F.col("user_id") % 15).alias("uid")).agg(F.sum(F.floor(F.col("value") * 100).cast("long")).alias("incentive"), F.max("event_id").alias("last_update"), F.min("event_id").alias("first_seen"), F.count("*").alias("n"))


def weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(netuid, t, src, dest, w): sparse scorer-to-member weights from line items by quarter."""
    l = table(spark, sf_dir, "lineitem")
    quarter = ((F.year("l_shipdate") - 1992) * 4 + F.quarter("l_shipdate") - 1).alias("t")
    return l.groupBy(F.col("l_returnflag").alias("netuid"), quarter, (F.col("l_suppkey") % 20).alias("src"), (F.col("l_partkey") % 40).alias("dest")).agg(F.sum(F.floor("l_quantity").cast("long")).alias("w"))
