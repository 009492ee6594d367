"""Values too long for one task: scanned in chunks that see a little of their neighbours.

A chunk looks for matches in its own text with a halo of the texts before and
after it, and owns those that start in its own.  Two things cross a border:
the end of a pattern's last match, from where the pattern looks on, and the
end of the last chosen span, from where the sweep goes on.  Both travel as
short rows from chunk to chunk; texts and candidates stay where they are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwell.functions.lists import apply, let
from maskwell.operators import spans as S
from maskwell.operators.scrub import barrier
from maskwell.operators.tokens import assign
from maskwell.plans import scratch
from maskwell.plans.policy import Policy

#: Characters a match, with what its pattern looks at around it, may have.
HALO = 65_536
#: What a pattern may look ahead, or a quarter of the halo: a match that ends closer to the end of what the chunk sees
#: is not trusted.
AHEAD = 64
OVER = "array<struct<rank:int,chars:int>>"


@dataclass(frozen=True)
class Scrubbed:
    """``chunks``: the ids, ``chunk`` and the masked ``text``; ``findings``: positions are those in the whole value."""

    chunks: DataFrame
    findings: DataFrame


def cut(df: DataFrame, column: str, size: int) -> DataFrame:
    """A row for each ``size`` characters of a column, numbered by ``chunk``; null and empty texts are one chunk."""
    pieces = F.regexp_extract_all(F.col(f"`{column}`"), F.lit(rf"(?s).{{1,{size}}}"), F.lit(0))
    rows = df.withColumn("_pieces", F.when(F.length(f"`{column}`") > 0, pieces).otherwise(F.array(F.col(f"`{column}`"))))
    others = [F.col(f"`{c}`") for c in df.columns if c != column]
    return rows.select(*others, F.posexplode("_pieces").alias("chunk", column))


def _neighbours(chunks: DataFrame, ids: list[str], halo: int) -> DataFrame:
    """Chunks with the ``halo`` characters ``_left`` and ``_right`` of them, and the length of the value ``_base`` before them."""
    sizes = chunks.select(*ids, "chunk", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("_size"))
    before = Window.partitionBy(*ids).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    all_of = F.sum("_size").over(Window.partitionBy(*ids))
    base = sizes.select(*ids, "chunk", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_base"), all_of.alias("_total"))
    # two chunks on either side, as one may be short
    ends = chunks.select(*ids, "chunk", F.left("text", F.lit(halo)).alias("_head"), F.right("text", F.lit(halo)).alias("_tail"))
    sides = F.array(*(F.struct((F.col("chunk") + d).alias("chunk"), F.lit(d).alias("d"), F.col("_head" if d < 0 else "_tail").alias("t")) for d in (-2, -1, 1, 2)))
    seen = ends.select(*ids, F.inline(sides)).groupBy(*ids, "chunk").agg(F.map_from_entries(F.collect_list(F.struct("d", "t"))).alias("_by"))
    part = lambda d: F.coalesce(F.col("_by")[F.lit(d)], F.lit(""))
    return (
        chunks.join(base, [*ids, "chunk"])
        .join(seen, [*ids, "chunk"], "left")
        .withColumns({"_left": F.right(F.concat(part(2), part(1)), F.lit(halo)), "_right": F.left(F.concat(part(-1), part(-2)), F.lit(halo))})
        .withColumn("_more", F.col("_base") + F.coalesce(F.length("text"), F.lit(0)) + F.length("_right") < F.col("_total"))
        .drop("_by", "_total")
    )


def _at_core(cands: str, chars: str, octets: str) -> str:
    """Spans with positions counted from the chunk's own first character."""
    return (
        f"transform({cands}, _c -> named_struct('start', _c.start - {chars}, 'neg_len', _c.neg_len, 'rank', _c.rank, 'end', _c.`end` - {chars}, "
        f"'b0', _c.b0 - {octets}, 'b1', _c.b1 - {octets}, 'original', _c.original, 'part', _c.part))"
    )


def _candidates(chunks: DataFrame, ids: list[str], policy: Policy, halo: int, ahead: int) -> DataFrame:
    """Chunks with the candidates near them, those before the border (``start`` below 0) included, and what crosses it."""
    near = _neighbours(chunks, ids, halo)
    wide = F.struct(F.concat("_left", F.coalesce("text", F.lit("")), "_right").alias("w"), F.length("_left").alias("c"), F.octet_length("_left").alias("b"))
    scan = let(S.candidates_sql("_r.w", policy.active()), "_all", _at_core("_all", "_r.c", "_r.b"))
    size = F.coalesce(F.length("text"), F.lit(0))
    # lengths are taken once for a chunk, not for each candidate: they walk the whole text
    found = barrier(near, _cands=apply(wide, "_r", scan), _len=size, _reach=size + F.length("_right") - ahead)
    last = F.filter("_cands", lambda c: (c["start"] >= 0) & (c["start"] < F.col("_len")) & (c["end"] > F.col("_len")))
    over = F.transform(last, lambda c: F.struct(c["rank"].alias("rank"), (c["end"] - F.col("_len")).alias("chars")))
    torn = F.exists("_cands", lambda c: (c["start"] >= 0) & (c["start"] < F.col("_len")) & (c["end"] > F.col("_reach")))
    shown = found.select(*ids, "chunk", "_base", "_len", "_cands", over.alias("_over"), (torn & F.col("_more")).alias("_torn"))
    return scratch.kept(shown)


def _from_left(rows: DataFrame, ids: list[str], *columns: Column) -> DataFrame:
    """Columns of each chunk, as the next one sees them; nothing else is moved."""
    return rows.select(*ids, (F.col("chunk") + 1).alias("chunk"), *columns)


def _own(found: DataFrame, ids: list[str]) -> DataFrame:
    """Each pattern's own matches, as a scan of the whole value finds them, and whether the chunks agree on them.

    A pattern looks on from the end of its last match before the border. From a place that no match of this chunk's scan
    spans, the scan is the same whatever came before; a match that spans it shows that the halo was too small.
    """
    came = _from_left(found, ids, F.col("_over").alias("_in")).where(F.size("_in") > 0)
    rows = found.join(came, [*ids, "chunk"], "left").withColumn("_in", F.coalesce("_in", F.expr(f"cast(array() AS {OVER})")))

    def begin(c: Column) -> Column:
        mine = F.filter("_in", lambda o: o["rank"] == c["rank"])
        return F.coalesce(F.get(mine, F.lit(0))["chars"], F.lit(0))

    spanned = F.exists("_cands", lambda c: (c["start"] < begin(c)) & (c["end"] > begin(c)))
    mine = F.filter("_cands", lambda c: (c["start"] >= begin(c)) & (c["start"] < F.col("_len")))
    return rows.select(*ids, "chunk", "_base", "_len", mine.alias("_cands"), (F.col("_torn") | spanned).alias("_torn"))


def scan(chunks: DataFrame, ids: list[str], policy: Policy, halo: int = HALO) -> DataFrame:
    """Chosen spans of each chunk (``_kept``), the same as in the whole value, and where they reach from (``_from``).

    Each chunk is swept from its own start; where a span chosen before reaches across the border, it is swept again from
    there, until nothing changes: that takes as many rounds as spans in a row reach across borders.
    """
    wide = halo
    while True:
        owned = scratch.kept(_own(_candidates(chunks, ids, policy, wide, min(AHEAD, halo // 4)), ids))
        torn, longest = owned.agg(F.count_if("_torn"), F.max("_len")).first()
        if not torn:
            break
        if wide > 2 * (longest or 0):  # no chunk sees more than two others on either side
            raise ValueError("a match, or a run of matches without a gap, is longer than two chunks; use larger ones")
        wide *= 8
    if policy.allowlist:
        allowed = F.array(*(F.lit(v) for v in sorted(policy.allowlist)))
        owned = owned.withColumn("_cands", F.filter("_cands", lambda c: ~F.array_contains(allowed, c["original"])))
    owned = owned.select(*ids, "chunk", "_base", "_len", "_cands")
    reached = owned.where("false").select(*ids, "chunk", F.lit(0).alias("_from"), F.lit(0).alias("_skip"))
    while True:
        rows = owned.join(reached, [*ids, "chunk"], "left").fillna(0, ["_from", "_skip"])
        packed = F.struct(F.col("_cands").alias("cands"), F.col("_from").alias("pos"))
        swept = barrier(rows, _kept=apply(packed, "_r", S.sweep_sql("_r.cands", "_r.pos"))).drop("_cands")
        swept = scratch.kept(swept)
        end = F.get("_kept", F.size("_kept") - 1)
        over = _from_left(
            swept.where(end["end"] > F.col("_len")), ids, (end["end"] - F.col("_len")).cast("int").alias("_from"), end.alias("_last")
        )
        # bytes of the next chunk that the span covers: its last characters
        tail = F.octet_length(F.right(F.col("_last.original"), F.col("_from"))).alias("_skip")
        over = scratch.kept(over.select(*ids, "chunk", "_from", tail))
        if over.exceptAll(reached).isEmpty() and reached.exceptAll(over).isEmpty():
            return swept
        reached = over


def scrub_chunks(chunks: DataFrame, ids: list[str] | str, policy: Policy | None = None, halo: int = HALO) -> Scrubbed:
    """Scrub values given as chunks: ``ids``, ``chunk`` (0, 1, 2 ...) and ``text``.

    The result is that of the whole value, in chunks again. A match, with what its pattern looks at around it, must be
    no longer than ``halo``; where chunks show that one is, or that one's matches follow each other without a gap, all
    are scanned again with a larger halo, and beyond two chunks the job stops. The token style numbers over the whole
    value. Chunks should be several times as long as the halo.
    """
    policy = policy or Policy()
    ids = [ids] if isinstance(ids, str) else list(ids)
    if S.python_masked(policy) or S.column_masked(policy):
        raise ValueError("masks that are functions need whole values")
    chunks = scratch.kept(chunks.select(*ids, "chunk", "text"))
    swept = scan(chunks, ids, policy, halo)
    patterns = policy.active()
    look = {n: F.get(F.array(*(F.lit(v) for v in vs)), F.col("rank")) for n, vs in {
        "pattern": [p.name for p in patterns], "category": [p.category for p in patterns], "confidence": [float(p.confidence) for p in patterns]}.items()}
    if policy.mask_style == "token":
        spans = swept.select(*ids, "chunk", "_base", F.posexplode("_kept").alias("seq", "_k")).select(*ids, "chunk", "_base", "seq", "_k.*").withColumns(look)
        rows, _ = assign(spans, ["chunk", "seq"], ids, None, scratch.SPLIT_ROWS)
    else:
        masked = swept.withColumn("_masked", S.masks_of(F.col("_kept"), policy))
        zipped = F.arrays_zip(F.col("_kept").alias("k"), F.col("_masked").alias("m"))
        rows = masked.select(*ids, "chunk", "_base", F.posexplode(zipped).alias("seq", "_z")).select(*ids, "chunk", "_base", "seq", "_z.k.*", F.col("_z.m").alias("masked")).withColumns(look)
    rows = scratch.kept(rows)
    lists = rows.groupBy(*ids, "chunk").agg(F.sort_array(F.collect_list(F.struct("b0", "b1", "masked"))).alias("_put"))
    work = chunks.join(swept.select(*ids, "chunk", "_skip"), [*ids, "chunk"]).join(lists, [*ids, "chunk"], "left")
    # what the last span of the chunk before covers is left out; what goes beyond this chunk is the next one's to leave out
    none = F.expr("cast(array() AS array<struct<b0:int,b1:int,masked:string>>)")
    whole = F.octet_length("text")
    inside = F.transform(F.coalesce("_put", none), lambda p: F.struct(p["b0"].alias("b0"), F.least(p["b1"], whole).alias("b1"), p["masked"].alias("masked")))
    lead = F.when(F.col("_skip") > 0, F.array(F.struct(F.lit(0).alias("b0"), F.least("_skip", whole).alias("b1"), F.lit("").alias("masked")))).otherwise(none)
    packed = F.struct(F.col("text").alias("t"), F.concat(lead, inside).alias("kept"))
    text = apply(packed, "_r", let("transform(_r.kept, _k -> _k.masked)", "_new", S.assemble_sql("_r.t", "_r.kept", "_new")))
    place = [(F.col("_base") + F.col(c)).alias(c) for c in ("start", "end")]
    return Scrubbed(work.select(*ids, "chunk", text.alias("text")), rows.select(*ids, "pattern", "category", "confidence", "original", "masked", *place))
