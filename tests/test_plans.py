"""What the physical plans must look like."""

import re

import pytest
from pyspark.sql import functions as F

from maskwell.operators.scrub import findings, scrub_columns
from maskwell.operators.spans import scrub
from maskwell.plans.policy import Policy


def plan(df, kind="executedPlan"):
    return getattr(df._jdf.queryExecution(), kind)().toString()


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def test_scrub_has_no_shuffle_and_reads_only_its_columns(docs):
    out = scrub_columns(docs.select("doc_id", "text"), "text", Policy())
    text = plan(out)
    assert "Exchange" not in text and "Python" not in text
    assert re.search(r"ReadSchema: struct<doc_id:bigint,text:string>", text)


def test_filter_on_findings_does_not_scan_twice(spark):
    spark.conf.set("spark.sql.maxPlanStringLength", 10**7)
    df = spark.range(1).select(F.lit("x").alias("text"), F.rand().alias("r"))
    one = plan(scrub_columns(df, "text", Policy()), "optimizedPlan").count("AIzaSy")
    kept = scrub_columns(df, "text", Policy()).where("text_findings is not null")
    assert one > 0 and plan(kept, "optimizedPlan").count("AIzaSy") == one


def test_filter_on_other_columns_reaches_the_scan(docs):
    out = findings(docs.where("lang = 'en'"), "doc_id", "text", Policy())
    assert "EqualTo(lang,en)" in plan(out)
    later = scrub_columns(docs, "text", Policy(), report=False).where("doc_id > 7")
    assert "GreaterThan(doc_id,7)" in plan(later)


def test_unused_patterns_are_not_in_the_plan(docs):
    text = plan(docs.select(scrub(F.col("text"), Policy.only("email"))), "optimizedPlan")
    assert "@" in text and "AKIA" not in text
    high = plan(docs.select(scrub(F.col("text"), Policy(min_confidence=0.8))), "optimizedPlan")
    assert "[A-Z][0-9]{8}" not in high


def test_wide_tables_share_one_scan_expression(spark):
    wide = spark.range(1).select(*(F.lit("x").alias(f"c{i}") for i in range(30)))
    text = plan(scrub_columns(wide, wide.columns, Policy(), report=False), "analyzed")
    single = plan(scrub_columns(wide, ["c0"], Policy(), report=False), "analyzed")
    assert text.count("AIzaSy") == single.count("AIzaSy")
