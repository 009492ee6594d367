"""Contiguous shards of nearly equal bytes, from prefix sums over per-partition totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import kept, text_or_empty


def with_byte_shards(docs: DataFrame, n_shards: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot`` and ``grown_shard`` for each row of ``docs``.

    The rows lie in the order of ``key`` (nulls first; equal keys by checksum, then size). A range sort spreads them
    over partitions, the totals of the partitions give each its offset, and the running sum inside gives each row its
    bytes ``[start, start + size)`` of the whole. A row goes to the shard that holds the middle of its bytes, so shards
    are contiguous and differ from equal size by half a row at either end. ``slot`` counts from 0 inside each shard.

    ``size`` is UTF-8 bytes plus 1; null texts count as empty (size 1, checksum 0). Rows equal in key, checksum and
    size can stand for one another, so a salt spreads them without changing the rows returned. Equal texts are not kept
    together: this law looks at bytes only. An empty table gives an empty result. Only ``key`` and ``text`` are read.
    """
    order = ["_key", "text_crc32", "size", "_salt"]
    sized = docs.select(
        F.col(key).alias("_key"),
        (F.octet_length(text_or_empty(text)) + 1).cast("long").alias("size"),
        F.crc32(text_or_empty(text).cast("binary")).alias("text_crc32"),
        (F.monotonically_increasing_id() % 1024).alias("_salt"),
    )
    placed = kept(sized.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "shards")
    upto = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = placed.withColumns({"_bytes": F.sum("size").over(upto), "_rows": F.count("*").over(upto)})
    totals = placed.groupBy("_part").agg(F.sum("size").alias("_b"), F.count("*").alias("_n"))
    # one row for each partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    offsets = totals.select(
        "_part",
        F.coalesce(F.sum("_b").over(before), F.lit(0)).alias("_b0"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"),
        F.sum("_b").over(everything).alias("_all"),
    )
    cut = f"least({n_shards - 1}, ((2 * (_b0 + _bytes) - size) * {n_shards}) div (2 * _all))"
    rows = inside.join(offsets, "_part").select(
        "_key", "size", "text_crc32", F.expr(cut).cast("int").alias("shard"), (F.col("_n0") + F.col("_rows") - 1).alias("_at")
    )
    # the first row of each shard, from one row for each partition and shard
    firsts = rows.groupBy("shard").agg(F.min("_at").alias("_first"))
    return rows.join(F.broadcast(firsts), "shard").select(  # n_shards rows
        F.col("_key").alias(key),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("_at") - F.col("_first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
