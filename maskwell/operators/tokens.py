"""Consistent pseudonyms: number distinct originals, put tokens in, take them out."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from itertools import pairwise
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwell.functions.catalog import PatternSpec
from maskwell.operators.scrub import present
from maskwell.operators.span_tables import ROW, join_by_value, join_keys, measured, scan, span_rows, splice
from maskwell.operators.spans import token_sql
from maskwell.plans import scratch
from maskwell.plans.policy import Policy

TOKEN_DDL = "original string, token string"
#: A stored map, or a function that gives the tokens of some originals.
Known = DataFrame | Callable[[DataFrame], DataFrame] | None


@dataclass(frozen=True)
class Tokenized:
    rows: DataFrame
    findings: DataFrame
    tokens: DataFrame


def empty_tokens(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], TOKEN_DDL)


def last_number(tokens: DataFrame) -> int:
    """Highest number in a stored map; tokens of another form are ignored."""
    digits = F.regexp_extract("token", r"-([0-9]+)\]\n?\z", 1)
    return tokens.agg(F.max(digits.try_cast("bigint"))).first()[0] or 0


def _new_runs(batch: pa.RecordBatch, last: list[Any] | None) -> np.ndarray:
    """Where a row of sorted rows differs from the one before it; ``last`` is the row before the first."""
    new = np.zeros(batch.num_rows, bool)
    for column in batch.columns:
        if pa.types.is_nested(column.type):
            values = column.to_pylist()
            new[1:] |= [x != y for x, y in pairwise(values)]
        else:
            codes = column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            new[1:] |= codes[1:] != codes[:-1]
    new[0] = last is None or [c[0].as_py() for c in batch.columns] != last
    return new


def _numbered(width: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds the partition, the place in it and the number within a run of equal values of the first ``width`` columns."""

    def number(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, start, last = TaskContext.get().partitionId(), 0, 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            place = np.arange(at, at + batch.num_rows)
            at += batch.num_rows
            keys = batch.select(list(range(width)))
            begins = np.maximum.accumulate(np.where(_new_runs(keys, last), place, start))
            start, last = begins[-1], [c[-1].as_py() for c in keys.columns]
            added = {"_part": pa.array(np.full(len(place), part, np.int32)), "_at": pa.array(place), "_n": pa.array(place - begins + 1)}
            yield pa.RecordBatch.from_arrays([*batch.columns, *added.values()], names=[*batch.schema.names, *added])

    return number


def number_rows(df: DataFrame, order: Sequence[str], scope: Sequence[str] = ()) -> DataFrame:
    """Add ``n`` = 1, 2, 3 ... in ``order``, restarting in every ``scope``.

    The rows are range-sorted and stored with their partition and their place in it: that sort is the only exchange of
    rows.  What is missing then is one number for each partition: the rows of all before it, or, with a scope, those of
    the scope it continues.  A scope of any size may spread over many partitions.
    """
    laid = df.select(*scope, *(c for c in df.columns if c not in scope)).orderBy(*scope, *order)
    if not scope:
        place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
        laid = scratch.kept(laid.withColumns({"_part": F.spark_partition_id(), "_n": place + 1}))
        counts = laid.groupBy("_part").agg(F.count("*").alias("_rows"))
        before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        offsets = counts.select("_part", F.sum("_rows").over(before).alias("_before"))
    else:
        shape = T.StructType([*laid.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_at", T.LongType()), T.StructField("_n", T.LongType())])
        laid = scratch.kept(laid.mapInArrow(_numbered(len(scope)), shape))
        # only the scope that ends a partition can go on in later ones, as the first of theirs
        ends = F.max_by(F.struct(*scope, F.col("_n").alias("_rows")), "_at").alias("_run")
        heads = F.min_by(F.struct(*scope, F.lit(0).cast("long").alias("_rows")), "_at").alias("_run")
        runs = laid.groupBy("_part").agg(ends).unionByName(laid.groupBy("_part").agg(heads))
        per_part = runs.select("_part", "_run.*").groupBy("_part", *scope).agg(F.sum("_rows").alias("_rows"))
        before = Window.partitionBy(*scope).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        offsets = per_part.select(*scope, "_part", F.sum("_rows").over(before).alias("_before")).where("_before > 0")
        laid = laid.drop("_at")
    # no more rows than two for each partition of the sort
    numbered = join_keys(laid, offsets, [*scope, "_part"], "left", small=True)
    return numbered.withColumn("n", F.coalesce("_before", F.lit(0)) + F.col("_n")).drop("_part", "_n", "_before")


def make_tokens(
    spans: DataFrame,
    order: Sequence[str],
    scope: Sequence[str] = (),
    known: Known = None,
    last: int | None = None,
) -> DataFrame:
    """Token per distinct original: ``scope..., original, token, category, n, uses``.

    Numbers follow first occurrence; the category is that of the first span.
    With a stored map, known originals keep their token and new numbers start
    above its highest one.  The map may be a function from originals to their
    tokens; the highest number is then given as ``last``.
    """
    scope = list(scope)
    order = [c for c in order if c not in scope]
    firsts = spans.groupBy(*scope, "original").agg(
        F.min(F.struct(*order, "category")).alias("_first"), F.count("*").alias("uses")
    )
    start = 0
    if known is not None:
        if scope:
            raise ValueError("a stored token map belongs to the whole dataset")
        if not isinstance(known, DataFrame):
            firsts = scratch.kept(firsts)
            known = known(firsts.select("original"))
        start = last_number(known) if last is None else last
        firsts = firsts.join(known.select("original", "token"), "original", "left")
    fresh = firsts if known is None else firsts.where("token is null").drop("token")
    numbered = number_rows(
        fresh.select(*scope, "original", "uses", F.col("_first.category").alias("category"),
                     *(F.col(f"_first.{c}").alias(f"_o{i}") for i, c in enumerate(order))),
        [f"_o{i}" for i in range(len(order))],
        scope,
    )
    number = (F.col("n") + start).alias("n")
    made = numbered.select(*scope, "original", "category", number, "uses").select(
        *scope,
        "original",
        F.expr(token_sql("upper(category)", "n")).alias("token"),
        "category",
        "n",
        "uses",
    )
    if known is None:
        return made
    old = firsts.where("token is not null").select(
        "original",
        "token",
        F.col("_first.category").alias("category"),
        F.lit(None).cast("bigint").alias("n"),
        "uses",
    )
    return made.unionByName(old)


def tokenize(
    df: DataFrame,
    id_cols: Sequence[str] | str,
    fields: Sequence[str] | str,
    policy: Policy | None = None,
    order: Sequence[str] | None = None,
    scope: Sequence[str] = (),
    known: Known = None,
    split_rows: int = scratch.SPLIT_ROWS,
    last: int | None = None,
) -> Tokenized:
    """Token style with one map per ``scope`` (empty: the whole dataset).

    ``id_cols`` name a row in the findings and ``order`` (default: the ids)
    says which rows come first; null and repeated ids are allowed.  ``order`` and ``scope`` are taken from the ids.
    """
    policy = policy or Policy(mask_style="token")
    ids = [id_cols] if isinstance(id_cols, str) else list(id_cols)
    order, scope = list(order or ids), list(scope)
    names = present(df, fields)
    routed = scan(df, names, policy)
    spans = span_rows(routed, {c: routed.own(c) for c in ids}, names, policy)
    found, tokens = assign(spans, [*order, "field_at", "start"], scope, known, split_rows, last)
    rows = splice(routed, names, found.select(ROW, "field_at", "b0", "b1", "masked"), measured(spans, longest(tokens, "token")))
    listed = found.select(
        *ids, "field", "pattern", "category", "confidence", "original", "masked", "start", "end"
    )
    return Tokenized(rows, listed, tokens)


def longest(tokens: DataFrame, column: str) -> int:
    """Bytes of the longest value of a token table."""
    return tokens.agg(F.max(F.octet_length(column))).first()[0] or 0


def assign(
    spans: DataFrame, order: Sequence[str], scope: Sequence[str], known: Known, split_rows: int, last: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Spans with the token of their original as ``masked``, and the tokens."""
    tokens = make_tokens(spans, order, scope, known, last)
    if known is not None:
        # new and known ones come from different places; without a map the numbered originals are stored already
        tokens = scratch.kept(tokens)
    by_original = tokens.select(*scope, "original", F.col("token").alias("masked"), "uses")
    return join_by_value(spans, by_original, [*scope, "original"], split_rows=split_rows), tokens


TOKEN_FORM = PatternSpec("token", "custom", r"\[[^\[\]\n]+-[0-9]{3,}\]", all_of=("[",))


def detokenize(
    df: DataFrame,
    id_cols: Sequence[str] | str,
    fields: Sequence[str] | str,
    tokens: DataFrame,
    scope: Sequence[str] = (),
) -> DataFrame:
    """Put the originals back; a token the map does not hold stays.

    ``scope`` is that of :func:`tokenize`: its columns are among the ids and in the map. A map that gives one token
    two originals within a scope is refused.
    """
    scope = list(scope)
    ids = [id_cols] if isinstance(id_cols, str) else list(id_cols)
    only = Policy(categories=frozenset(), extra_patterns=(TOKEN_FORM,))
    names = present(df, fields)
    routed = scan(df, names, only)
    spans = span_rows(routed, {c: routed.own(c) for c in dict.fromkeys([*ids, *scope])}, names, only)
    uses = spans.groupBy(*scope, "original").agg(F.count("*").alias("uses"))
    listed = tokens.select(*scope, F.col("token").alias("original"), F.col("original").alias("masked"))
    once = listed.groupBy(*scope, "original").agg(F.min("masked").alias("masked"), F.max("masked").alias("_other"))
    clash = F.raise_error("a token stands for several originals; name the scope of the map")
    sure = once.withColumn("masked", F.when(F.col("masked") == F.col("_other"), F.col("masked")).otherwise(clash))
    table = scratch.kept(join_keys(sure.drop("_other"), uses, [*scope, "original"]))
    found = join_by_value(spans, table, [*scope, "original"])
    return splice(routed, names, found.select(ROW, "field_at", "b0", "b1", "masked"), measured(spans, longest(table, "masked")))
