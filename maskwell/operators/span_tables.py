"""Spans as a table: for work that needs other rows to decide on a mask.

Findings are sparse next to the text they come from.  So the text is scanned
once and its rows are stored two ways; joins and groupings run on the small
span table; and a last join splices the replacements into the rows with
findings.  All others are passed on as they are.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwell.functions.lists import apply, let
from maskwell.operators import spans as S
from maskwell.operators.scrub import barrier, present
from maskwell.plans import scratch
from maskwell.plans.policy import Policy

ROW, SPANS = "_row", "_spans"


@dataclass(frozen=True)
class Routed:
    """A table whose rows were scanned once and stored two ways: rows with findings, and all others."""

    names: list[str]
    untouched: DataFrame
    #: ``_row``, ``_spans`` (spans of each value), extra columns, and the table's own as ``c0``, ``c1`` ...
    hits: DataFrame

    def own(self, name: str) -> Column:
        """A column of the table among the ``hits``."""
        return F.col(f"c{self.names.index(name)}")

    def whole(self, done: DataFrame, texts: Sequence[str]) -> DataFrame:
        """The table again, ``texts`` as strings: rows that were left alone, and the ``done`` ones."""
        own = [F.col(f"c{i}").alias(n) for i, n in enumerate(self.names)]
        alone = [F.col(f"`{n}`").cast("string").alias(n) if n in texts else F.col(f"`{n}`") for n in self.names]
        return self.untouched.select(*alone).unionByName(done.select(*own))


def route(df: DataFrame, made: Mapping[str, Column], spans: Column, stored: Sequence[str] = ()) -> Routed:
    """Scan a table and store its rows two ways, by whether any value holds a span.

    ``spans`` is an array of spans for each value. It may use the columns ``made`` first; of those, the ones named in
    ``stored`` stay among the hits. The input is read once, so it may be one that does not give the same rows twice.
    """
    own = {f"c{i}": F.col(f"`{n}`") for i, n in enumerate(df.columns)}
    work = df.select(*(c.alias(n) for n, c in own.items()), *(c.alias(n) for n, c in made.items()))
    hit = F.coalesce(F.exists(SPANS, lambda x: F.size(x) > 0), F.lit(False))
    laid = barrier(work, **{SPANS: spans}).select(
        F.monotonically_increasing_id().alias(ROW), SPANS, *(F.when(hit, F.col(c)).alias(c) for c in stored), *own, hit.alias("_hit")
    )
    both = scratch.kept(laid, by="_hit")
    alone = both.where("NOT _hit").select(*(F.col(f"c{i}").alias(n) for i, n in enumerate(df.columns)))
    return Routed(df.columns, alone, both.where("_hit").drop("_hit"))


def scan(df: DataFrame, fields: Sequence[str] | str, policy: Policy, resolved: bool = True) -> Routed:
    """:func:`route` by the spans of the named columns; ``resolved=False`` takes candidates, before allowlist and sweep."""
    names = present(df, fields)
    one = S.spans_sql("_t", policy) if resolved else S.candidates_sql("_t", policy.active())
    values = F.array(*(F.col(f"`{f}`").cast("string") for f in names))
    return route(df, {"_values": values}, apply(F.col("_values"), "_vs", f"transform(_vs, _t -> {one})"))


def span_rows(routed: Routed, ids: Mapping[str, Column], fields: Sequence[str], policy: Policy) -> DataFrame:
    """One row per span of the hits: ids, ``_row``, ``field``, ``field_at`` and the span's columns."""
    patterns = policy.active()
    by_rank = {
        "pattern": F.array(*(F.lit(p.name) for p in patterns)),
        "category": F.array(*(F.lit(p.category) for p in patterns)),
        "confidence": F.array(*(F.lit(float(p.confidence)) for p in patterns)),
    }
    return (
        routed.hits.select(*(c.alias(n) for n, c in ids.items()), ROW, F.posexplode(SPANS).alias("field_at", "_of"))
        .select(*ids, ROW, "field_at", F.inline("_of"))
        .select(
            *ids,
            ROW,
            F.get(F.array(*(F.lit(f) for f in fields)), F.col("field_at")).alias("field"),
            "field_at",
            *S.SPAN_COLUMNS,
            *(F.get(lookup, F.col("rank")).alias(name) for name, lookup in by_rank.items()),
        )
    )


def join_keys(rows: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "inner", small: bool = False) -> DataFrame:
    """Join on keys that may be null: a null scope is a scope too, and a finding lost here would come out in the clear."""
    other = table.select(
        *(F.col(f"`{k}`").alias(f"_key{i}") for i, k in enumerate(keys)),
        *(F.col(f"`{c}`") for c in table.columns if c not in keys),
    )
    same = reduce(and_, (F.col(f"`{k}`").eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)))
    return rows.join(F.broadcast(other) if small else other, same, how).drop(*(f"_key{i}" for i in range(len(keys))))


def join_by_value(
    rows: DataFrame,
    table: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    split_rows: int = scratch.SPLIT_ROWS,
) -> DataFrame:
    """Join rows with a keyed table that knows its ``uses`` in those rows.

    One value may occur in a third of all rows.  Keys above a fixed share of
    the rows - of which there can only be a bounded number - are joined by
    broadcast, the rest by shuffle with no key left that is large.  Both
    inputs should be checkpointed: each is read more than once.
    """
    keys = list(keys)
    lean = table.drop("uses")
    total = table.agg(F.sum("uses")).first()[0] or 0
    if total <= split_rows:
        return join_keys(rows, lean, keys, how)
    hot = F.col("uses") > total / scratch.HOT_SHARE
    cold_rows = join_keys(rows, table.where(hot).select(*keys), keys, "left_anti", small=True)
    cold = join_keys(cold_rows, table.where(~hot).drop("uses"), keys, how)
    if how == "left_anti":
        return cold
    return join_keys(rows, table.where(hot).drop("uses"), keys, small=True).unionByName(cold)


def measured(listed: DataFrame, masked: Column | int) -> bool:
    """Whether replacements, one for each of the rows ``listed``, are small enough to broadcast.

    ``masked`` is the size of one, or a bound for it.
    """
    each = F.lit(masked) if isinstance(masked, int) else masked
    n, size = listed.agg(F.count("*"), F.sum(each.cast("long"))).first()
    return n <= scratch.BROADCAST_ROWS and (size or 0) + 48 * n <= scratch.BROADCAST_CHARS


def grouped(replacements: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Replacements by ``keys`` as lists ``_put``, in place order."""
    return replacements.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("field_at", "b0", "b1", "masked"))).alias("_put"))


def put_in(text: Column, put: Column) -> Column:
    """A text with replacements ``put`` in place."""
    packed = F.struct(text.alias("t"), put.alias("kept"))
    return apply(packed, "_r", let("transform(_r.kept, _k -> _k.masked)", "_new", S.assemble_sql("_r.t", "_r.kept", "_new")))


def splice(routed: Routed, fields: Sequence[str], replacements: DataFrame, small: bool = False) -> DataFrame:
    """Put replacements into the texts of the hits.

    ``replacements`` holds ``_row``, ``field_at``, ``b0``, ``b1`` and ``masked``. Their lists are joined by broadcast if
    they are ``small`` (see :func:`measured`), else hit rows meet them by shuffle on the row's number, which no two rows
    share. Rows without a finding meet nothing.
    """
    lists = grouped(replacements, [ROW])
    work = routed.hits.join(F.broadcast(lists) if small else lists, ROW, "left")

    def put(text: Column, at: int) -> Column:
        mine = F.filter(F.col("_put"), lambda x: x["field_at"] == at)
        return F.when(F.col("_put").isNull(), text).otherwise(put_in(text, mine))

    at = {f: i for i, f in enumerate(fields)}
    return routed.whole(
        work.select(
            *(
                put(F.col(f"c{i}").cast("string"), at[n]).alias(f"c{i}") if n in at else F.col(f"c{i}")
                for i, n in enumerate(routed.names)
            )
        ),
        fields,
    )
