"""Allowlists that are tables: too large, or too changeable, for the plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwell.functions.lists import apply
from maskwell.operators import spans as S
from maskwell.operators.scrub import barrier, present, python_masks
from maskwell.operators.span_tables import ROW, join_by_value, measured, scan, span_rows, splice
from maskwell.plans import scratch
from maskwell.plans.policy import Policy


def union_values(*frames: DataFrame) -> DataFrame:
    """Union of allowlist sources as one distinct ``value`` column."""
    out = None
    for frame in frames:
        values = frame.select(F.trim(F.col("value")).alias("value")).where("value <> ''")
        out = values if out is None else out.unionByName(values)
    return out.distinct()


def held(allow: DataFrame) -> Broadcast[frozenset[str]]:
    """An allowlist table as a set that each worker holds once, if its measured size allows it.

    For ``scrub_columns`` and streams; a larger table needs :func:`exclude_allowed`, batch by batch on a stream.
    """
    values = union_values(allow)
    n, size = values.agg(F.count("*"), F.sum(F.octet_length("value"))).first()
    if n > scratch.BROADCAST_ROWS or (size or 0) > scratch.BROADCAST_CHARS:
        raise ValueError(f"{n} allowed values are too many to hold; use exclude_allowed")
    return allow.sparkSession.sparkContext.broadcast(frozenset(r["value"] for r in values.collect()))


def exclude_allowed(
    df: DataFrame,
    id_cols: Sequence[str] | str,
    fields: Sequence[str] | str,
    allow: DataFrame,
    policy: Policy | None = None,
    ignore_case: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Scrub with an allowlist table; returns ``(rows, findings)``.

    The anti-join runs on candidates, before overlaps are resolved: an allowed
    value must not block a finding it overlaps.
    """
    policy = policy or Policy()
    ids = [id_cols] if isinstance(id_cols, str) else list(id_cols)
    names = present(df, fields)
    routed = scan(df, names, policy, resolved=False)
    cands = span_rows(routed, {c: routed.own(c) for c in ids}, names, policy)
    listed = union_values(allow)
    if ignore_case:
        # one key form on both sides
        cands = cands.withColumn("_key", F.lower("original"))
        listed = listed.select(F.lower("value").alias("_key")).distinct()
    else:
        cands = cands.withColumn("_key", F.col("original"))
        listed = listed.withColumnRenamed("value", "_key")
    in_use = cands.groupBy("_key").agg(F.count("*").alias("uses"))
    allowed = scratch.kept(in_use.join(listed, "_key", "left_semi"))
    left = join_by_value(cands, allowed, ["_key"], "left_anti")

    per_value = left.groupBy(*ids, ROW, "field_at", "field").agg(
        F.sort_array(F.collect_list(F.struct(*S.SPAN_COLUMNS))).alias("_cands")
    )
    swept_col = apply(F.col("_cands"), "_cands", S.sweep_sql("_cands"))
    masked = barrier(per_value, _kept=swept_col).withColumn(
        "_masked", S.masks_of(F.col("_kept"), policy)
    )
    if S.python_masked(policy):
        made = masked.withColumn("_python", python_masks(F.array("_kept"), policy).getItem(0))
        either = F.zip_with("_python", "_masked", lambda p, n: F.coalesce(p, n))
        masked = made.withColumn("_masked", either).drop("_python")
    zipped = F.arrays_zip(
        F.col("_kept").alias("s"),
        F.expr(S.findings_sql("_kept", "_masked", policy)).alias("f"),
    )
    swept = scratch.kept(
        masked.select(*ids, ROW, "field_at", "field", F.posexplode(zipped).alias("seq", "x"))
    )
    put = swept.select(ROW, "field_at", F.col("x.s.b0").alias("b0"), F.col("x.s.b1").alias("b1"), F.col("x.f.masked").alias("masked"))
    return splice(routed, names, put, measured(put, F.octet_length("masked"))), swept.select(*ids, "field", "seq", "x.f.*")
