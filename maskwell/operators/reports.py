"""The dashboard queries: samples, counts, top lists, pattern reference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwell.functions.catalog import BUILTIN, NAMES
from maskwell.operators.scrub import scrub_columns
from maskwell.plans.policy import Policy, allowed_by

SAMPLE = 500
TABLE_SAMPLE = 50

# Lower bounds of the second and third colour range.
EVENT_RANGES = (1, 50)
FINDING_RANGES = (1, 100)


def sample(events: DataFrame, n: int | None, order: str | list[str]) -> DataFrame:
    """First ``n`` events in ``order`` (all if ``None``), before any scrubbing."""
    return events if n is None else events.orderBy(order).limit(n)


def last_hours(
    events: DataFrame, ts: str, now: Column, hours: int = 24, source: Column | None = None
) -> DataFrame:
    """Time range with its start on the hour, and an optional source predicate.

    Both are plain comparisons on columns and reach the scan.
    """
    start = F.date_trunc("hour", now - F.make_dt_interval(hours=F.lit(hours)))
    out = events.where((F.col(ts) >= start) & (F.col(ts) <= now))
    return out if source is None else out.where(source)


def with_findings(scrubbed: DataFrame, field: str) -> DataFrame:
    return scrubbed.where(F.col(f"{field}_findings").isNotNull())


def events_sampled(events: DataFrame) -> DataFrame:
    return events.agg(F.count("*").alias("count"))


def events_with_findings(events: DataFrame, field: str, policy: Policy) -> DataFrame:
    scrubbed = scrub_columns(events, field, policy, report=True)
    return with_findings(scrubbed, field).agg(F.count("*").alias("count"))


def total_findings(events: DataFrame, field: str, policy: Policy) -> DataFrame:
    scrubbed = scrub_columns(events, field, policy, report=True)
    return scrubbed.agg(F.sum(f"{field}_finding_count").cast("bigint").alias("total"))


def findings_by_pattern(events: DataFrame, field: str, policy: Policy) -> DataFrame:
    scrubbed = scrub_columns(events, field, policy, report=True)
    pattern = F.explode(F.split(F.col(f"{field}_findings"), ","))
    return (
        with_findings(scrubbed, field)
        .select(pattern.alias("pattern"))
        .groupBy("pattern")
        .agg(F.count("*").alias("count"))
        .orderBy(F.desc("count"), "pattern")
    )


def top_sources(
    events: DataFrame, field: str, policy: Policy, source: str, n: int = 10
) -> DataFrame:
    scrubbed = scrub_columns(events, field, policy, report=True)
    return (
        with_findings(scrubbed, field)
        .groupBy(source)
        .agg(F.count("*").alias("count"))
        .orderBy(F.desc("count"), source)
        .limit(n)
    )


def sample_table(events: DataFrame, field: str, policy: Policy, columns: list[str]) -> DataFrame:
    scrubbed = scrub_columns(events, field, policy, report=True)
    return (
        with_findings(scrubbed, field)
        .select(*columns, field, f"{field}_findings", f"{field}_finding_count")
        .withColumnRenamed(field, "scrubbed")
        .withColumnRenamed(f"{field}_findings", "patterns_found")
        .withColumnRenamed(f"{field}_finding_count", "finding_count")
    )


def pattern_reference(spark: SparkSession, standard: str) -> DataFrame:
    """Patterns of a standard with their category, sorted by both.

    An unknown standard has no rows here, unlike in a policy.
    """
    categories = {p.name: p.category for p in BUILTIN}

    def packed(name: str) -> str:
        allowed = allowed_by(name)
        return "|".join(f"{n},{categories[n]}" for n in NAMES if allowed is None or n in allowed)

    chosen = F.lit(standard)
    data = F
    for name in ("gdpr", "hipaa", "pci", "soc2", "all"):
        data = data.when(chosen == name, F.lit(packed(name)))
    item = F.split(F.col("item"), ",")
    return (
        spark.range(1)
        .select(F.explode(F.split(data.otherwise(F.lit("")), r"\|")).alias("item"))
        .where("item <> ''")
        .select(item.getItem(0).alias("pattern"), item.getItem(1).alias("category"))
        .orderBy("category", "pattern")
    )


def range_bucket(value: Column, bounds: tuple[int, int]) -> Column:
    """``none`` / ``some`` / ``many``: the three colour ranges of a figure."""
    low, high = bounds
    return F.when(value >= high, "many").when(value >= low, "some").otherwise("none")
