"""JSON snapshots: one document a block, or an array of them; tolerant parsers of their fields, in built-in functions only.

Fields are read as raw JSON text, so that no layout makes the scan fail; what can't be understood is null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LIST = "array<string>"
BLOCK_NAME = r"block_(\d+)\.json(?:\.gz)?$"


def read_blocks(spark: SparkSession, path: str | Sequence[str], fields: Sequence[str]) -> DataFrame:
    """(block, ts, file, netuid, *fields) of JSON documents or arrays of documents; fields and netuid as raw text, null where missing."""
    schema = "block_info struct<number:bigint,hash:string,timestamp:string>, netuid string" + "".join(f", `{x}` string" for x in fields)
    rows = spark.read.schema(schema).option("multiLine", True).json(path if isinstance(path, str) else list(path))
    return rows.select(F.col("block_info.number").alias("block"), F.expr("try_to_timestamp(block_info.timestamp)").alias("ts"), F.col("_metadata.file_name").alias("file"), "netuid", *fields)


def collected_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(block) of the files block_<n>.json(.gz) below path; other names are passed over, contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    n = F.regexp_extract("path", BLOCK_NAME, 1)
    return files.filter(n != "").select(n.cast("long").alias("block")).distinct()


def pending(wanted: DataFrame, done: DataFrame) -> DataFrame:
    """Wanted blocks that are not done yet."""
    return wanted.join(done, "block", "left_anti")


def spaced_blocks(spark: SparkSession, amount: int, current: int, months: float, block_seconds: int = 12) -> DataFrame:
    """(block): amount + 1 evenly spaced blocks over the months before `current`, oldest first."""
    step = int(months * 30 * 24 * 3600 / block_seconds / amount)
    return spark.range(amount + 1).select((F.lit(current) - (F.lit(amount) - F.col("id")) * step).alias("block"))


def write_blocks(df: DataFrame, path: str) -> None:
    """Gzipped JSON, a folder a block; the job's commit makes a block visible whole or not at all."""
    df.write.mode("append").partitionBy("block").option("compression", "gzip").json(path)


def fill_sampled(blocks: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Fields sampled every so many blocks take the last value seen, only while the list of markets is that of the block it came from.

    The order of blocks is one sequence over all markets, but of documents, not members: one row a block reaches the window.
    """
    w = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    for x in fields:
        held = F.last(F.when(F.col(x).isNotNull(), F.struct(F.col(x).alias("v"), F.col("netuid").alias("of"))), ignorenulls=True).over(w)
        blocks = blocks.withColumn("_held", held).withColumn(x, F.when(F.col("_held.of").eqNullSafe(F.col("netuid")), F.col("_held.v"))).drop("_held")
    return blocks


def by_market(blocks: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(block, ts, netuid, *fields): a row a market; a single number as netuid is a list of one."""
    ids = F.coalesce(F.from_json("netuid", "array<int>"), F.array(F.expr("try_cast(netuid as int)")))
    rows = blocks.select("block", "ts", F.posexplode(ids).alias("_at", "_id"), *[F.from_json(x, LIST).alias(x) for x in fields])
    return rows.filter("_id is not null").select("block", "ts", F.col("_id").alias("netuid"), *[F.get(x, F.col("_at")).alias(x) for x in fields])


def _listed(c: Column) -> Column:
    return F.from_json(c, LIST)


def _is_list(c: Column) -> Column:
    return F.coalesce(c.startswith("["), F.lit(False))


def unwrapped(c: Column, depth: int = 3) -> Column:
    """JSON text without up to `depth` outer lists of one list each."""
    for _ in range(depth):
        c = F.when(_is_list(c) & (F.size(_listed(c)) == 1) & _is_list(F.get(_listed(c), F.lit(0))), F.get(_listed(c), F.lit(0))).otherwise(c)
    return c


def scalar(c: Column) -> Column:
    """A number from JSON text: plain, true or false, the first of a list, or under "value", else "bits"; otherwise null."""
    one = F.when(_is_list(c), F.get(_listed(c), F.lit(0))).otherwise(c)
    inner = F.when(one.startswith("{"), F.coalesce(F.get_json_object(one, "$.value"), F.get_json_object(one, "$.bits"))).otherwise(one)
    return F.when(inner == "true", 1.0).when(inner == "false", 0.0).otherwise(inner.try_cast("double"))


def account(c: Column) -> Column:
    """An account name: text as it is, or under ss58, address, hotkey or value; empty is null."""
    named = F.coalesce(*[F.get_json_object(c, f"$.{k}") for k in ("ss58", "address", "hotkey", "value")])
    return F.nullif(F.when(c.startswith("{"), named).otherwise(c), F.lit(""))


def vector(df: DataFrame, field: str, keys: Sequence[str], read=scalar) -> DataFrame:
    """(*keys, uid, value) of a field: a dense list, pairs [uid, value], or either in outer lists of one. Gaps and nulls give no row.

    One pair in one list can't be told from a wrapped list of two; it counts as the latter. Of equal uids the last one counts.
    """
    cells = df.select(*keys, F.posexplode(_listed(unwrapped(F.col(field)))).alias("_at", "_x"))
    pair = _is_list(F.col("_x")) & (F.size(_listed(F.col("_x"))) == 2)
    part = lambda k: F.get(_listed(F.col("_x")), F.lit(k))
    rows = cells.select(*keys, "_at", F.when(pair, part(0).try_cast("int")).otherwise(F.col("_at")).alias("uid"), read(F.when(pair, part(1)).otherwise(F.col("_x"))).alias("value"))
    return rows.filter("uid >= 0 and value is not null").groupBy(*keys, "uid").agg(F.max_by("value", "_at").alias("value"))


def matrix(df: DataFrame, field: str, keys: Sequence[str], n: str) -> DataFrame:
    """(*keys, src, dest, w) of a field: rows [src, [[dest, w], ...]], rows of pairs, or dense rows. src or dest outside 0 .. n - 1 is dropped; of equal cells the last one counts."""
    rows = df.select(*keys, F.col(n).alias("_n"), F.posexplode(_listed(F.col(field))).alias("_at", "_row"))
    of = lambda k: F.get(_listed(F.col("_row")), F.lit(k))
    keyed = (F.size(_listed(F.col("_row"))) == 2) & _is_list(of(1)) & ~_is_list(of(0))
    rows = rows.select(*keys, "_n", "_at", F.when(keyed, of(0).try_cast("int")).otherwise(F.col("_at")).alias("src"), F.posexplode(_listed(F.when(keyed, of(1)).otherwise(F.col("_row")))).alias("_col", "_x"))
    cell = lambda k: F.get(_listed(F.col("_x")), F.lit(k))
    pair = _is_list(F.col("_x"))
    cells = rows.select(*keys, "_n", F.struct("_at", "_col").alias("_order"), "src", F.when(pair, cell(0).try_cast("int")).otherwise(F.col("_col")).alias("dest"), F.when(pair, scalar(cell(1))).otherwise(scalar(F.col("_x"))).alias("w"))
    return cells.filter("src >= 0 and src < _n and dest >= 0 and dest < _n and w is not null").groupBy(*keys, "src", "dest").agg(F.max_by("w", "_order").alias("w"))
