"""The corpus pipeline: drop toxic documents, near copies and leaks, mix the sources, deal to shards.

``STAGES`` are pairs of a name and a function of ``(spark, docs, sf_dir)``; each works on what the one before kept, and
all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwell.llm import decontamination, jaccard_join, mixing, sharding, toxicity
from maskwell.llm.common import kept, table


def unused(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    while name.lower() in (c.lower() for c in docs.columns):
        name += "_"
    return name


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group (ids that are null come last).

    Documents link if at least 80 percent of their distinct 5-word shingles are shared, unlike in op7. Rows are told
    apart by a stored number, so ids may be null or repeated: only rows linked by their texts are copies. Documents
    without words stay.
    """
    row = unused(docs, "_row")
    stored = kept(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    parts = jaccard_join.join(stored, size=5, percent=80, key=row)
    ranked = parts.join(stored.select(row, F.col("doc_id").alias("_doc")), row)
    best = ranked.groupBy("component_id").agg(F.min(F.struct(F.col("_doc").isNull().alias("_none"), "_doc", row)).alias("_best"))
    return stored.join(best.select(F.col(f"_best.{row}").alias(row)), row, "left_semi").select(docs.columns)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontamination.without_leaks(docs, table(spark, sf_dir, "benchmark"), shortest=1)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes its words, to the nearest whole number; documents without words once."""
    taken = mixing.mix(docs).documents
    times = F.when(F.sum("size") == 0, 1).otherwise(F.round(F.sum("taken") / F.sum("size"))).cast("int")
    ident, count, copy = (unused(docs, x) for x in ("_id", "_times", "_copy"))
    copies = taken.groupBy(F.col("doc_id").alias(ident)).agg(times.alias(count)).where(F.col(count) > 0)
    repeated = docs.join(copies, docs["doc_id"].eqNullSafe(F.col(ident))).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(count))))
    return repeated.select(docs.columns)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every document."""
    return sharding.with_byte_shards(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("near copies", without_near_copies),
    ("decontamination", without_leaks),
    ("mixing", mixed),
    ("sharding", sharded),
]

#: Learned scores and hashes of Spark are not expressible in SQL; tests compare the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
