"""The driver's events in the shape of the silver tables: snapshots, uid_state and weights. SILVER_SQL is the SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .adapters import states, table

#: Fixed values of the adapter: members 0-4 have a permit, 0-3 earn nothing, 13 has no name, 14 is missing on every sixth day.
SILVER_SQL = """b AS (SELECT event_type AS netuid, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS t, user_id % 15 AS uid,
  CAST(sum(CAST(floor(value * 100) AS BIGINT)) AS BIGINT) AS inc, count(*) AS n, min(event_id) AS first, max(event_id) AS last FROM events GROUP BY 1, 2, 3),
us AS (SELECT netuid, t, uid, CASE WHEN uid = 14 AND t % 6 = 5 THEN NULL WHEN uid < 4 THEN 0 ELSE inc END AS incentive, inc + 1000 * (uid % 3) AS emission,
  CASE WHEN uid < 5 THEN n ELSE 0 END AS dividends, CASE WHEN uid < 4 THEN 0 ELSE first % 1000 END AS consensus, n AS vtrust, n % 2 AS active, CASE WHEN uid < 5 THEN 1 ELSE 0 END AS vpermit,
  CASE WHEN t % 7 = 2 THEN 0 ELSE (uid + 1) * 100 + last % 100 END AS stake_weight, CASE WHEN uid = 3 AND t % 4 = 1 THEN NULL ELSE t * 7200 - last % 3000 END AS last_update,
  CASE WHEN uid % 5 = 0 THEN t // 10 * 72000 + uid ELSE uid END AS reg_block,
  CASE WHEN uid = 13 THEN '' WHEN uid % 4 = 1 THEN 'h' || uid || '-' || (t // 8) ELSE 'h' || uid END AS hotkey FROM b),
sn AS (SELECT netuid, t, t * 7200 + t % 3 * 10 AS block, CASE WHEN t % 9 <> 4 THEN 300 + 60 * (t // 10) END AS tempo, t // 10 AS kappa, 100 + t // 15 AS immunity_period, 5 AS max_validators,
  CAST(sum(inc) AS BIGINT) // 100 AS subnet_tao, CASE WHEN t % 8 = 3 THEN 0 ELSE count(*) * 100 END AS alpha_in, CAST(sum(inc) AS BIGINT) % 1000 AS burn_cost,
  CASE WHEN t % 11 = 10 THEN 'gone' ELSE 'h6' END AS owner_hotkey FROM b GROUP BY netuid, t),
wt AS (SELECT event_type AS netuid, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS t, user_id % 5 AS src, event_id % 10 + 5 AS dest,
  CAST(sum(CAST(floor(value * 10) AS BIGINT)) AS BIGINT) AS w FROM events GROUP BY 1, 2, 3, 4 HAVING sum(CAST(floor(value * 10) AS BIGINT)) > 0)"""


def uid_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(netuid, t, uid, incentive, emission, dividends, consensus, vtrust, active, vpermit, stake_weight, last_update, reg_block, hotkey)."""
    t, uid, n = F.col("t"), F.col("uid"), F.col("n")
    named = F.concat(F.lit("h"), uid)
    return states(spark, sf_dir).select(
        "netuid",
        "t",
        "uid",
        F.when((uid == 14) & (t % 6 == 5), None).when(uid < 4, F.lit(0).cast("long")).otherwise(F.col("incentive")).alias("incentive"),
        (F.col("incentive") + 1000 * (uid % 3)).alias("emission"),
        F.when(uid < 5, n).otherwise(0).alias("dividends"),
        F.when(uid < 4, 0).otherwise(F.col("first_seen") % 1000).alias("consensus"),
        n.alias("vtrust"),
        (n % 2).alias("active"),
        F.when(uid < 5, 1).otherwise(0).alias("vpermit"),
        F.when(t % 7 == 2, 0).otherwise((uid + 1) * 100 + F.col("last_update") % 100).alias("stake_weight"),
        F.when((uid == 3) & (t % 4 == 1), None).otherwise(t * 7200 - F.col("last_update") % 3000).alias("last_update"),
        F.when(uid % 5 == 0, F.expr("t div 10 * 72000") + uid).otherwise(uid).alias("reg_block"),
        F.when(uid == 13, "").when(uid % 4 == 1, F.concat(named, F.lit("-"), F.expr("t div 8"))).otherwise(named).alias("hotkey"),
    )


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(netuid, t, block, tempo, kappa, immunity_period, max_validators, subnet_tao, alpha_in, burn_cost, owner_hotkey)."""
    t, total = F.col("t"), F.sum("incentive")
    rows = states(spark, sf_dir).groupBy("netuid", "t").agg(total.alias("total"), F.count("*").alias("members"))
    return rows.select(
        "netuid",
        "t",
        (t * 7200 + t % 3 * 10).cast("long").alias("block"),
        F.when(t % 9 != 4, 300 + 60 * F.expr("t div 10")).alias("tempo"),
        F.expr("t div 10").alias("kappa"),
        (100 + F.expr("t div 15")).alias("immunity_period"),
        F.lit(5).alias("max_validators"),
        F.expr("total div 100").alias("subnet_tao"),
        F.when(t % 8 == 3, 0).otherwise(F.col("members") * 100).alias("alpha_in"),
        (F.col("total") % 1000).alias("burn_cost"),
        F.when(t % 11 == 10, "gone").otherwise("h6").alias("owner_hotkey"),
    )


def weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(netuid, t, src, dest, w): only w > 0."""
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    e = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("netuid"), day.alias("t"), (F.col("user_id") % 5).alias("src"), (F.col("event_id") % 10 + 5).alias("dest"))
    return e.agg(F.sum(F.floor(F.col("value") * 10).cast("long")).alias("w")).filter("w > 0")
