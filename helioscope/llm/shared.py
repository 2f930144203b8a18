"""What the operators share: tables in the shared folder, batch limits, joins that a hot key doesn't stop."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys that hold more than this share of all rows are joined by broadcast: there can be at most 1 / share of them.
HEAVY_SHARE = 1 / 2000
#: No task joins more rows of one key than about this many.
ROWS_A_TASK = 1_000_000
#: Paths of the tables written so far in this process.
WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only a local master may go without that setting; it then gets a folder of its own."""
    conf = spark.sparkContext.getConf()
    found = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not conf.get("spark.master", "local").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    made = f"file://{tempfile.mkdtemp(prefix='shared-')}"
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes df as a table of the shared folder and reads it back: lineage ends there, so a lost executor costs no recomputation, and two passes see the same rows in the same order."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    WRITTEN.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release_tables(spark: SparkSession) -> int:
    """Deletes the tables that materialize() wrote in this process, and says how many. To be called once no DataFrame over them is needed any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    gone = 0
    while WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(WRITTEN.pop())
        gone += bool(path.getFileSystem(conf).delete(path, True))
    return gone


def column(name: str) -> Column:
    """A column by its plain name, whatever signs that has."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores after it as no column of df has: own columns never clash with given ones."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches that go to Python by rows and bytes: the same bounds for every operator, so the order of calls doesn't matter."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def trim() -> None:
    """Gives freed memory back to the system: idle Python workers and the driver would otherwise keep their peak."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: nothing to give back this way
        return


def heavy_join(rows: DataFrame, keyed: DataFrame, keys: list[str], count: str, total: int, how: str = "inner") -> DataFrame:
    """Joins rows with keyed (one row a key; column `count` has the key's number of rows in `rows`, of `total`).

    Keys above HEAVY_SHARE of the total, of which there are at most 1 / HEAVY_SHARE, are broadcast; the rest
    is shuffled. Where one of those could still hold more than ROWS_A_TASK rows, all are salted: their rows are dealt
    over as many salts as that takes, and each key's row is repeated for each. `count` is dropped.
    """
    least = max(1000, int(total * HEAVY_SHARE))
    heavy = keyed.filter(F.col(count) > least).drop(count)
    light = keyed.filter(F.col(count) <= least).drop(count)
    rest = rows.join(F.broadcast(heavy.select(*keys)), keys, "left_anti")
    if (salts := -(-least // ROWS_A_TASK)) > 1:
        light = light.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        salted = rest.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int"))
        return rows.join(F.broadcast(heavy), keys, "inner").unionByName(salted.join(light, [*keys, "_salt"], how).drop("_salt"))
    return rows.join(F.broadcast(heavy), keys, "inner").unionByName(rest.join(light, keys, how))


def bitmaps(ids: DataFrame) -> DataFrame:
    """(chunk, bits): the numbers (long, not negative) of ids' only column as bitmaps: 4096 numbers a chunk, 64 a word; chunks without any have no row."""
    (name,) = ids.columns
    words = ids.select(F.shiftright(name, 6).alias("word"), F.expr(f"shiftleft(1L, cast({name} & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    entry = F.struct(F.expr("cast(word & 63 as int)").alias("word"), "bits")
    packed = words.groupBy(F.shiftright("word", 6).alias("chunk")).agg(F.map_from_entries(F.collect_list(entry)).alias("m"))
    return packed.select("chunk", F.expr("transform(sequence(0, 63), w -> coalesce(m[w], 0L))").alias("bits"))


def among(rows: DataFrame, number: str, maps: DataFrame) -> DataFrame:
    """The rows whose column `number` is in `maps` (of bitmaps()), which is broadcast, about 540 bytes a chunk: rows stay where they lie."""
    chunk, bits = fresh(rows, "_chunk", "_bits")
    met = rows.withColumn(chunk, F.shiftright(number, 12)).join(F.broadcast(maps.toDF(chunk, bits)), chunk)
    return met.filter(f"bit_get(get({bits}, cast(({number} >> 6) & 63 as int)), cast({number} & 63 as int)) = 1").drop(chunk, bits)


def pieces(batch: pa.Array, most: int = 4 << 20) -> Iterator[tuple[int, pa.Array]]:
    """Cuts a string array into runs of about `most` bytes, so that a batch of long texts takes bounded memory; yields (start, run)."""
    sizes = np.zeros(len(batch), np.int64)
    if len(batch):
        import pyarrow.compute as pc

        sizes = pc.fill_null(pc.binary_length(batch), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    at = 0
    while at < len(batch):
        n = max(1, int(np.searchsorted(np.cumsum(sizes[at:]), most)))
        yield at, batch.slice(at, n)
        at += n
    trim()


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[i] .. starts[i] + lengths[i] - 1 for each i, one after another."""
    lengths = lengths.astype(np.int64)
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts.astype(np.int64) - (ends - lengths), lengths)
