"""Line dedup without Python workers: hashes of line keys, range-partitioned and sorted by document and position, decide which lines go; a bitmap a document carries the decision."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import column, heavy_join, materialize

SPACE = " \t\n\x0b\x0c\r"
KEYS = ["_dn", "_d", "_t"]


def line_key(line: Column) -> Column:
    """White space of ASCII stripped at both ends, A-Z lower-cased. lower() is exact for ASCII lines and fast; others go letter by letter."""
    bare = F.btrim(line, F.lit(SPACE))
    return F.when(F.length(bare) == F.octet_length(bare), F.lower(bare)).otherwise(F.translate(bare, string.ascii_uppercase, string.ascii_lowercase))


def keyed(docs: DataFrame, *columns: str) -> DataFrame:
    """(_dn, _d, _t, _text, own): a row's key is its doc_id, null apart, and its text's hash; own holds the other `columns` of docs, so that their names don't matter."""
    rest = [column(c) for c in columns if c != "text"]
    own = F.struct(*rest) if rest else F.lit(None)
    return docs.select(F.col("doc_id").isNull().alias("_dn"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("_d"), F.xxhash64("text").alias("_t"), F.col("text").alias("_text"), own.alias("own"))


def drop_bitmaps(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """(_dn, _d, _t, bits): 64 lines a word, bit i set where line i goes. Documents that lose no line have no row.

    A key of min_chars code points or more found in min_docs documents or more (by doc_id; null ones count as one)
    loses its lines everywhere, or with keep_first everywhere but at its first place by doc_id and position.
    Texts are split and hashed once. The hashes are sorted by key, document and position in ranges, which may cut
    one key's run anywhere between documents, so a line that every document holds fills no single task; over the sorted
    runs a window streams the first occurrence in each document, and only those are counted.
    """
    lines = keyed(docs).select(*KEYS, F.posexplode(F.split(F.coalesce("_text", F.lit("")), "\n", -1)).alias("pos", "line")).withColumn("k", line_key("line"))
    lines = materialize(lines.filter(F.length("k") >= min_chars).select(F.xxhash64("k").alias("h"), F.hash("k").alias("g"), *KEYS, "pos"), "lines")
    run = ["h", "g", "_dn", "_d"]
    placed = lines.repartitionByRange(*run).sortWithinPartitions(*run, "pos", "_t")
    placed = placed.withColumn("nth", F.row_number().over(Window.partitionBy(*run).orderBy("pos", "_t")))
    first = F.min(F.struct("_dn", "_d", "pos", "_t")).alias("first")
    common = placed.groupBy("h", "g").agg(F.count_if(F.col("nth") == 1).alias("docs"), F.count("*").alias("n"), *[first] * keep_first)
    common = materialize(common.filter(F.col("docs") >= min_docs).drop("docs"), "common")
    gone = heavy_join(lines, common, ["h", "g"], "n", lines.count())
    if keep_first:
        gone = gone.filter(F.struct("_dn", "_d", "pos", "_t") != F.col("first"))
    gone = gone.select(*KEYS, F.expr("pos div 64").cast("int").alias("word"), F.expr("shiftleft(1L, pos % 64)").alias("bit"))
    words = gone.groupBy(*KEYS, "word").agg(F.bit_or("bit").alias("bits"))
    packed = words.groupBy(*KEYS).agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("m"), F.max("word").alias("last"))
    return packed.select(*KEYS, F.expr("transform(sequence(0, last), w -> coalesce(m[w], 0L))").alias("bits"))


def dedup_lines(docs: DataFrame, **rules) -> DataFrame:
    """All rows and columns of docs with `text` cut, and n_lines, n_dropped and bits (null: nothing dropped) beside.

    Lines are split at \\n; a null or empty text is one empty line and becomes the empty text if it loses
    any, else it stays as it is. Keys without a code point are never dropped. Repeated rows get the same decision.
    Texts of any length are cut whole. An empty table gives no rows. Columns of docs named n_lines, n_dropped or bits are
    replaced; any other name is free.
    """
    own = [c for c in docs.columns if c not in ("n_lines", "n_dropped", "bits")]
    out = keyed(docs, *own).join(drop_bitmaps(docs, **rules).hint("shuffle_hash"), KEYS, "left")
    kept = F.expr(r"array_join(filter(split(coalesce(_text, ''), '\n', -1), (x, i) -> coalesce(bit_get(get(bits, i div 64), cast(i % 64 as int)), 0) = 0), '\n')")
    return out.select(
        *[F.when(F.col("bits").isNull(), F.col("_text")).otherwise(kept).alias(c) if c == "text" else F.col("own")[c].alias(c) for c in own],
        F.size(F.split(F.coalesce("_text", F.lit("")), "\n", -1)).cast("long").alias("n_lines"),
        F.coalesce(F.expr("aggregate(bits, 0L, (n, w) -> n + bit_count(w))"), F.lit(0)).cast("long").alias("n_dropped"),
        "bits",
    )
