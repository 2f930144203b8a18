"""Sharding by longest processing time: units sorted by size go to the least-loaded shard through a heap."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize, small_batches

LOCAL = "doc_id long, size long, text_crc32 long, shard int, part int, local long"


def schedule(sizes: list[tuple[int, object]], shards: int) -> dict[object, int]:
    """Longest first, each to the shard with the least load (ties: the lowest number; equal sizes by name)."""
    heap = [(0, k) for k in range(shards)]
    placed = {}
    for size, unit in sorted(sizes, key=lambda x: (-x[0], str(x[1]))):
        load, k = heap[0]
        placed[unit] = k
        heapq.heapreplace(heap, (load + size, k))
    return placed


def shard(docs: DataFrame, shards: int = 16, units: int = 1 << 15) -> DataFrame:
    """Deals all documents to `shards` shards of near equal bytes; equal texts stay together.

    Size: the text's UTF-8 bytes plus 1. The scheduler's units are bounded whatever the input: a group of
    equal texts with more than total / units bytes is one by itself (at most `units` of them), the others are
    joined by hash into `units` bundles. Both lists are bounded, so they are scheduled on the driver and broadcast.
    Null and empty texts form one group of size 1 each. Repeated rows count each; a null doc_id stays null; other
    columns are ignored; an empty table gives no rows. Texts of any length are one document, never split, so one group larger than a shard's share makes that shard larger. Units of equal size go in the order of their names.
    Slots follow the order of reading; they are gapless in each shard.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    base = materialize(base, "sizes")
    groups = materialize(base.groupBy("h").agg(F.sum("size").alias("bytes")), "groups")
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    least = total // units + 1
    bundle = F.pmod(F.col("h"), F.lit(units)).cast("int")
    large = [(r["bytes"], ("group", r["h"])) for r in groups.filter(F.col("bytes") >= least).collect()]
    small = [(r["bytes"], ("bundle", r["b"])) for r in groups.filter(F.col("bytes") < least).groupBy(bundle.alias("b")).agg(F.sum("bytes").alias("bytes")).collect()]
    placed = schedule(large + small, shards)
    own = spark.createDataFrame([(u, k) for (kind, u), k in placed.items() if kind == "group"], "h long, own int")
    bundles = spark.createDataFrame([(u, k) for (kind, u), k in placed.items() if kind == "bundle"], "b int, joint int")
    dealt = base.withColumn("b", bundle).join(F.broadcast(own), "h", "left").join(F.broadcast(bundles), "b", "left")
    dealt = dealt.select("doc_id", "size", "text_crc32", F.coalesce("own", "joint").alias("shard"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(shards, np.int64)
        for batch in batches:
            k = batch.column("shard").to_numpy(zero_copy_only=False)
            order = np.argsort(k, kind="stable")
            count = np.bincount(k, minlength=shards)
            local = np.empty(len(k), np.int64)
            local[order] = np.arange(len(k)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(seen, count)
            seen += count
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(k), part, np.int32)), pa.array(local)], [*batch.schema.names, "part", "local"])

    small_batches(spark)
    table = materialize(dealt.mapInArrow(number, LOCAL), "dealt")
    counts = sorted((r["shard"], r["part"], r["count"]) for r in table.groupBy("shard", "part").count().collect())
    first = []
    for k in range(shards):
        mine = [(p, n) for s, p, n in counts if s == k]
        first += [(k, p, at) for (p, _), at in zip(mine, accumulate((n for _, n in mine), initial=0), strict=False)]
    offsets = spark.createDataFrame(first, "shard int, part int, first long")
    return table.join(F.broadcast(offsets), ["shard", "part"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("local")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
