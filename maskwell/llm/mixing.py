"""Mixing sources to target weights with a low-discrepancy schedule of equal-token blocks. Native operations only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import kept, word_count

BUCKETS = 4096
CELL_BITS = 10


@dataclass
class Mix:
    """``documents``: a row for each document with what the mix takes of it; ``slots``: the schedule."""

    documents: DataFrame
    slots: DataFrame
    sources: DataFrame


def targets(sized: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """A row for each source: ``sid``, ``source``, ``source_size``, ``weight``, ``target``.

    Sources by code point, null last, take the weights in turn. The whole size is shared by weight; no target exceeds
    ``cap`` times its source, and what is cut off goes to the others by weight. That level is the point where
    ``sum(least(level * weight, cap * size))`` meets the whole, found in one pass over the sources by their ratio of
    cap to weight. The windows here see one row for each source, not documents.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.col("sid") % len(weights) + 1).cast("int"))
    per = per.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    per = per.withColumn("weight", w).withColumn("_most", F.col("source_size") * cap)
    by_ratio = Window.orderBy(F.col("_most") / F.col("weight"), "sid")
    before, whole = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("_most").over(before), F.lit(0))
    weight_left = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    per = per.withColumn("_level", left / weight_left).withColumn("_free", F.col("_most") / F.col("weight") >= F.col("_level"))
    level = F.max(F.when(F.col("_free"), F.col("_level"))).over(whole)
    target = F.when(F.col("_free"), level * F.col("weight")).otherwise(F.col("_most").cast("double"))
    return per.select("sid", "source", "source_size", "weight", F.coalesce(target, F.lit(0.0)).cast("double").alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, block: int = 4096, key: str = "doc_id", source: str = "source", text: str = "text", seed: int = 17) -> Mix:
    """Mix the documents of ``docs`` so that each source gives its target of words (see :func:`targets`).

    Inside a source, documents are shuffled by a seeded hash and laid end to end; the stream is cut into blocks of
    ``block`` words. Slot ``i`` of the schedule looks up the base-2 van der Corput point of ``i`` in the cumulative
    targets; the rank of a slot among those of its source picks the source's next block, and a source that runs out
    starts again. A source's last slot is trimmed, so it gives its target to the word. Slots beyond a source's need are
    dropped, and the few that discrepancy leaves missing are appended.

    ``documents`` has ``key``, ``size``, ``source_size``, ``target``, ``taken``; ``taken`` is never above ``cap`` times
    ``size``. Words are runs without ASCII white space; null and empty texts have size 0 and nothing is taken from them.
    A null source is a source. Rows equal in key, source and text can stand for one another. Empty tables give empty
    results; columns beyond the three named are not read.
    """
    spark = docs.sparkSession
    sized = kept(
        docs.select(
            F.col(key).alias("_key"),
            F.col(source).alias("source"),
            word_count(text).alias("size"),
            F.xxhash64(F.lit(seed), F.col(key), F.col(text)).alias("_h"),
        ),
        "mix",
    )
    sources = kept(targets(sized, weights, cap), "mix-sources").withColumns(
        {
            "take": F.least(F.round("target").cast("long"), F.col("source_size") * cap),
            "blocks": F.ceil(F.col("source_size") / block).cast("long"),
        }
    )
    sources = sources.withColumn("_rest", F.expr("if(source_size > 0, take % source_size, 0)")).withColumn(
        "quota", F.expr(f"if(source_size > 0, (take div source_size) * blocks, 0) + ceil(_rest / {block})").cast("long")
    )
    slots = schedule(sources)
    # how often each block is used whole, and up to which word its trimmed slot goes
    last = (F.col("rank") == F.col("quota") - 1) & (F.col("_rest") % block > 0)
    used = slots.groupBy("sid", "block").agg(
        F.count_if(~last).alias("times"), F.max(F.when(last, F.col("_rest") % block)).alias("trim")
    )

    own = sized.join(sources.select("sid", F.col("source").alias("_s"), "source_size", "target"), F.col("source").eqNullSafe(F.col("_s")))
    own = own.withColumn("_bucket", F.shiftrightunsigned("_h", 52)).drop("source", "_s")
    fill = own.groupBy("sid", "_bucket").agg(F.sum("size").alias("_n"))
    before = Window.partitionBy("sid").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # BUCKETS rows
    fill = fill.select("sid", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_b0"))
    upto = Window.partitionBy("sid", "_bucket").orderBy("_h", "_key", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = own.withColumn("_end", F.sum("size").over(upto)).join(fill, ["sid", "_bucket"])
    placed = placed.withColumn("_e", F.col("_b0") + F.col("_end")).withColumn("_s", F.col("_e") - F.col("size"))
    pieces = placed.where("size > 0").select(
        "_key", "sid", "size", "source_size", "target", "_s", "_e",
        F.explode(F.expr(f"sequence(_s div {block}, (_e - 1) div {block})")).alias("block"),
    )
    a = F.greatest(F.lit(0), F.col("_s") - F.col("block") * block)
    b = F.least(F.lit(block), F.col("_e") - F.col("block") * block)
    part = (b - a) * F.coalesce(F.col("times"), F.lit(0)) + F.greatest(F.lit(0), F.least(b, F.coalesce("trim", F.lit(0))) - a)
    taken = pieces.join(used, ["sid", "block"], "left").withColumn("_part", part)
    taken = taken.groupBy("_key", "sid", "_s", "size", "source_size", "target").agg(F.sum("_part").cast("long").alias("taken"))
    bare = own.where("size = 0").select("_key", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"))
    out = taken.select(bare.columns).unionByName(bare).withColumnRenamed("_key", key)
    return Mix(out, slots.select("slot", "sid", "rank", "block"), sources.select("sid", "source", "source_size", "weight", "target"))


def schedule(sources: DataFrame, chunk: int = 4096) -> DataFrame:
    """``slot``, ``sid``, ``rank``, ``block``, ``quota``, ``_rest``: which source's block each slot takes.

    The table of sources is cut at a grid of cells, so that points find their source by an equality join on the cell.
    Ranks are counted by chunk of slots first, so no source's slots meet in one task.
    """
    spark = sources.sparkSession
    n = sources.agg(F.coalesce(F.sum("quota"), F.lit(0))).first()[0]
    bits = max(CELL_BITS, int(n).bit_length())
    span = 1 << bits
    upto = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0)  # one row for each source
    edge = (F.sum("quota").over(upto) * F.lit(float(span)) / F.lit(float(max(n, 1)))).cast("long")
    lines = sources.where("quota > 0").withColumn("_hi", edge)
    lines = lines.withColumn("_lo", F.coalesce(F.lag("_hi").over(Window.orderBy("sid")), F.lit(0))).where("_hi > _lo")
    cell = span >> CELL_BITS
    cells = lines.select("sid", "_lo", "_hi", F.explode(F.expr(f"sequence(_lo div {cell}, (_hi - 1) div {cell})")).alias("_cell"))
    point = F.conv(F.reverse(F.lpad(F.bin("slot"), bits, "0")), 2, 10).cast("long")
    points = spark.range(n).withColumnRenamed("id", "slot").withColumn("_p", point)
    found = points.withColumn("_cell", F.expr(f"_p div {cell}")).join(cells, "_cell").where("_p >= _lo and _p < _hi")
    found = found.select("slot", "sid", F.expr(f"slot div {chunk}").alias("_chunk"))
    counts = found.groupBy("sid", "_chunk").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("sid").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("sid", "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_r0"))
    inner = F.row_number().over(Window.partitionBy("sid", "_chunk").orderBy("slot"))
    ranked = found.withColumn("_r", inner).join(counts, ["sid", "_chunk"]).select("slot", "sid", (F.col("_r0") + F.col("_r") - 1).alias("rank"))
    facts = sources.select("sid", "quota", "_rest", "blocks")
    ranked = ranked.join(facts, "sid").where("rank < quota").drop("blocks")
    have = found.groupBy("sid").agg(F.count("*").alias("_have"))
    more = facts.join(have, "sid", "left").where("quota > coalesce(_have, 0)").select(
        F.explode(F.expr("sequence(coalesce(_have, 0), quota - 1)")).alias("rank"), "sid", "quota", "_rest"
    )
    more = more.select((F.lit(n) + F.col("rank")).alias("slot"), "sid", "rank", "quota", "_rest")
    both = ranked.select(more.columns).unionByName(more)
    return both.join(sources.select("sid", "blocks"), "sid").withColumn("block", F.col("rank") % F.col("blocks")).drop("blocks")
