"""Scrub inside structs, arrays and maps; keys and values that are not text stay."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwell.functions.lists import apply, empty_array, let, running
from maskwell.operators import spans as S
from maskwell.operators.documents import json_values_sql, spliced_sql
from maskwell.operators.scrub import barrier, with_python_masks
from maskwell.plans.policy import Policy

DEEP = 500


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it any number of times in ``body``."""
    return F.transform(F.array(value), body).getItem(0)


def allow_deep_expressions(spark: SparkSession) -> None:
    """Let the analyzer take more passes: it resolves one lambda level per pass."""
    key = "spark.sql.analyzer.maxIterations"
    if int(spark.conf.get(key)) < DEEP:
        spark.conf.set(key, DEEP)


def has_text(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.StructType):
        return any(has_text(f.dataType) for f in dtype.fields)
    if isinstance(dtype, T.ArrayType):
        return has_text(dtype.elementType)
    if isinstance(dtype, T.MapType):
        return has_text(dtype.valueType)
    return isinstance(dtype, (T.StringType, T.VariantType))


def fixed_count(dtype: T.DataType) -> int | None:
    """Number of strings below a value, if its type alone says it."""
    if not has_text(dtype):
        return 0
    if isinstance(dtype, T.StringType):
        return 1
    if isinstance(dtype, T.StructType):
        counts = [fixed_count(f.dataType) for f in dtype.fields]
        return None if None in counts else sum(counts)
    return None


def leaves(v: Column, dtype: T.DataType) -> Column:
    """All strings below a value as one array, in the order of a walk."""
    none = empty_array("string")
    if not has_text(dtype):
        return none
    if isinstance(dtype, T.StringType):
        return F.array(v)
    if isinstance(dtype, T.StructType):
        return F.concat(*(leaves(v[f.name], f.dataType) for f in dtype.fields if has_text(f.dataType)))
    if isinstance(dtype, T.ArrayType):
        return F.coalesce(F.flatten(F.transform(v, lambda x: leaves(x, dtype.elementType))), none)
    if isinstance(dtype, T.MapType):
        return leaves(F.map_values(v), T.ArrayType(dtype.valueType))
    values = let(json_values_sql("_doc"), "_vals", "transform(_vals, _v -> _v.value)")
    return F.coalesce(apply(F.to_json(v), "_doc", values), none)


def rebuilt(v: Column, dtype: T.DataType, done: Column, at: Column) -> Column:
    """The value with its strings taken from ``done``, from place ``at`` on, in the order of :func:`leaves`."""
    if not has_text(dtype):
        return v
    if isinstance(dtype, T.StringType):
        return F.get(done, at)["text"]
    if isinstance(dtype, T.StructType):
        fields = []
        for f in dtype.fields:
            fields.append(rebuilt(v[f.name], f.dataType, done, at).alias(f.name))
            n = fixed_count(f.dataType)
            at = at + (F.lit(n) if n is not None else F.size(leaves(v[f.name], f.dataType)))
        return F.when(v.isNotNull(), F.struct(*fields))
    if isinstance(dtype, T.ArrayType):
        inner, n = dtype.elementType, fixed_count(dtype.elementType)
        if n is not None:
            return F.transform(v, lambda x, i: rebuilt(x, inner, done, at + i * n))
        sizes = F.transform(v, lambda x: F.size(leaves(x, inner)))
        sums = running("_ns", "0", lambda a, m: f"struct({a} + {m} AS state, array({a}) AS emit)", "int")
        starts = apply(sizes, "_ns", sums)
        return F.transform(F.arrays_zip(v.alias("x"), starts.alias("n")), lambda p: rebuilt(p["x"], inner, done, at + p["n"]))
    if isinstance(dtype, T.MapType):
        values = rebuilt(F.map_values(v), T.ArrayType(dtype.valueType), done, at)
        return F.map_from_arrays(F.map_keys(v), values)
    packed = F.struct(F.to_json(v).alias("doc"), done.alias("done"), at.alias("at"))
    new = let(
        json_values_sql("_r.doc"),
        "_vals",
        let("slice(_r.done, _r.at + 1, size(_vals))", "_mine", spliced_sql("_r.doc", "_vals", "_mine", "'json'", ",")),
    )
    return F.when(v.isNotNull(), F.call_function("try_parse_json", apply(packed, "_r", new)["text"]))


def _packed(v: Column, dtype: T.DataType, done: Column) -> Column:
    found = F.flatten(F.transform(done, lambda d: d["findings"]))
    return F.struct(rebuilt(v, dtype, done, F.lit(0)).alias("value"), found.alias("findings"))


def scrub_nested(value: Column, dtype: T.DataType, policy: Policy | None = None) -> Column:
    """``struct<value, findings>`` for a column of any type.

    All strings below the value go through one copy of the scan; the token style numbers over the whole value.  Deep
    types need ``allow_deep_expressions`` on the session, masks in Python ``scrub_nested_columns``.
    """
    policy = policy or Policy()

    def build(v: Column) -> Column:
        done = S.scrub_values(leaves(v, dtype), policy, shared_tokens=True)
        return bound(done, lambda d: _packed(v, dtype, d))

    return bound(value, build)


def scrub_nested_columns(
    df: DataFrame, columns: list[str], policy: Policy | None = None
) -> DataFrame:
    """Scrub nested columns in place and add ``<column>_found``, the findings."""
    policy = policy or Policy()
    allow_deep_expressions(df.sparkSession)
    for name in [c for c in columns if c in df.columns]:
        dtype, value = df.schema[name].dataType, F.col(f"`{name}`")
        work = barrier(df, _leaves=leaves(value, dtype))
        if S.python_masked(policy):
            work = with_python_masks(work, F.col("_leaves"), policy, "_done")
        else:
            work = barrier(work, _done=S.scrub_values(F.col("_leaves"), policy, shared_tokens=True))
        work = barrier(work, _nested=_packed(value, dtype, F.col("_done")))
        cols = [F.col("_nested.value").alias(c) if c == name else F.col(f"`{c}`") for c in df.columns]
        df = work.select(*cols, F.col("_nested.findings").alias(f"{name}_found"))
    return df
