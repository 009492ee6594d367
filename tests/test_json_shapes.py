"""Schemas of JSON documents: Spark's own merge where keys are few, maps where they are many."""

import json
import random

import pytest
from pyspark.sql import functions as F

from maskwell.sources import readers as RD
from maskwell.sources.json_shapes import parsed


def value(rng, depth=0):
    kind = rng.randrange(9 if depth < 3 else 7)
    if kind == 7:
        return [value(rng, depth + 1) for _ in range(rng.randrange(3))]
    if kind == 8:
        return {rng.choice(["a", "b c", "d`e", "f:g", "<h>", "VOID", "i,j", "é"]): value(rng, depth + 1) for _ in range(rng.randrange(4))}
    return [None, True, rng.randrange(10**6), 10**rng.randrange(25), 1.5, 12345.678, "text"][kind]


@pytest.mark.parametrize("seed", range(3))
def test_few_keys_merge_as_spark_merges_them(spark, seed):
    rng = random.Random(seed)
    docs = [json.dumps({rng.choice("xyz"): value(rng) for _ in range(3)}) for _ in range(15 * 4**seed)] + ["no json", None, "[1, 2.50]"][: 2 + (seed == 2)]
    df = spark.createDataFrame([(d,) for d in docs], "t string").repartition(5)
    spark_own = df.select(F.expr("schema_of_variant_agg(try_parse_json(t))")).first()[0]
    from maskwell.sources.json_shapes import ddl_of

    assert RD.json_schema_of(df, "t") == ddl_of(parsed(spark_own))


def test_data_as_keys(spark):
    df = spark.range(100_000).select(
        F.concat(F.lit('{"users": {"user-'), "id", F.lit('": {"n": '), "id", F.lit(', "tags": ["x"]}}, "kind": "k", "by": {"a": 1}}')).alias("t")
    )
    ddl = RD.json_schema_of(df, "t")
    assert ddl == "STRUCT<`by`: STRUCT<`a`: BIGINT>, `kind`: STRING, `users`: MAP<STRING, STRUCT<`n`: BIGINT, `tags`: ARRAY<STRING>>>>"
    back = df.select("t", F.from_json("t", ddl).alias("v")).where("id % 9973 = 5" if "id" in df.columns else "true")
    assert back.select(F.sum(F.map_values("v.users")[0]["n"])).first()[0] == sum(range(100_000))
    assert RD.json_schema_of(df.limit(3), "t").count("user-") == 3
    assert RD.json_schema_of(df.limit(0), "t") == "STRING"
