"""A training corpus from raw documents: each stage works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helioscope.llm.decontaminate import without_leaks
from helioscope.llm.line_dedup import dedup_lines
from helioscope.llm.near_dedup import near_duplicates
from helioscope.llm.packing import pack
from helioscope.llm.quality import judge
from helioscope.llm.queries import END_ID, table, tokenizer
from helioscope.llm.shared import among, bitmaps, column, fresh, materialize

#: A stage's bitmap is broadcast up to so many chunks of 4096 rows: 70 MB, for some 500 million rows.
MOST_CHUNKS = 1 << 17


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, with the columns they came with. Null and empty texts have no words and go; repeated rows share a verdict; without labels the base rules alone decide; an empty table stays empty."""
    return judge(docs, table(spark, sf_dir, "labels"), docs.columns, keep_only=True)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents without lines whose key ten documents share; n_chars follows the text. A document that loses all its lines stays, with the empty text; null texts stay null; repeated rows are cut alike."""
    own = [f"c{i}" for i in range(len(docs.columns))]  # names that the operator's own columns can't clash with
    named = docs.select(*[column(c).alias(c if c in ("doc_id", "text") else o) for c, o in zip(docs.columns, own, strict=True)])
    cut = dedup_lines(named, min_docs=10, min_chars=1)
    now = [F.when(F.col("bits").isNull(), F.col(o)).otherwise(F.length("text").cast("long")) if c == "n_chars" else F.col(c if c in ("doc_id", "text") else o) for c, o in zip(docs.columns, own, strict=True)]
    return cut.select(*[x.alias(c) for x, c in zip(now, docs.columns, strict=True)])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, that of the least doc_id (null last); of rows that share it, one. Rows without words are no copies, so all stay.

    What is kept is a bit a row, which goes to the rows; only above MOST_CHUNKS the rows are shuffled to meet it.
    """
    (name,) = fresh(docs, "_row")
    numbered = materialize(docs.withColumn(name, F.monotonically_increasing_id()), "numbered")
    groups = near_duplicates(numbered.select(F.col(name).alias("doc_id"), "text")).select(F.col("doc_id").alias(name), "component_id")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").cast("long").alias("id"), name))
    kept = materialize(groups.join(numbered.select(name, "doc_id"), name).groupBy("component_id").agg(least.alias("least")).select(F.col("least")[name].alias(name)), "kept")
    maps = materialize(bitmaps(kept), "kept-bits")
    left = among(numbered, name, maps) if maps.count() <= MOST_CHUNKS else numbered.join(kept, name, "left_semi")
    return left.select(*map(column, docs.columns))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item was found. Null and empty texts match nothing and stay; repeated rows share a verdict; an empty benchmark takes nothing away."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the training sequences with their token ids (binary, little-endian 32 bits). Null and empty texts are one end id; repeated rows are packed each by itself."""
    return pack(docs, tokenizer(), END_ID, with_ids=True)


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
