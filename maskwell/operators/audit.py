"""Audit tables and reports made from a findings table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwell.operators.scrub import percent
from maskwell.plans import scratch

# Column order of the flat audit file.
AUDIT_COLUMNS = (
    "timestamp",
    "source",
    "pattern",
    "category",
    "confidence",
    "original",
    "masked",
    "char_offset",
)


def _stamp(generated_at: str | Column | None) -> Column:
    """UTC ISO time of the report; pass a literal to make runs repeatable."""
    if generated_at is None:
        now = F.to_utc_timestamp(F.current_timestamp(), F.current_timezone())
        return F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    return F.lit(generated_at) if isinstance(generated_at, str) else generated_at


def audit_rows(
    found: DataFrame,
    source: str | Column = "source",
    generated_at: str | None = None,
    include_original: bool = False,
) -> DataFrame:
    """Flat audit table; originals only when asked for."""
    src = F.col(source) if isinstance(source, str) else source
    rows = found.select(
        _stamp(generated_at).alias("timestamp"),
        src.cast("string").alias("source"),
        "pattern",
        "category",
        "confidence",
        "original",
        "masked",
        F.col("start").alias("char_offset"),
    )
    return rows.select(*(c for c in AUDIT_COLUMNS if include_original or c != "original"))


def audit_summary(found: DataFrame) -> DataFrame:
    """Totals by category and overall (``category`` null) in one pass."""
    return found.rollup("category").agg(F.count("*").alias("findings"))


def source_totals(found: DataFrame, source: str = "source", scanned: DataFrame | None = None) -> DataFrame:
    """Findings of each source; with the ``scanned`` table, sources without any are listed with 0."""
    totals = found.groupBy(source).agg(F.count("*").alias("findings"))
    if scanned is None:
        return totals
    nothing = scanned.select(source, F.lit(0).cast("long").alias("findings"))
    return totals.unionByName(nothing).groupBy(source).agg(F.sum("findings").alias("findings"))


def batch_totals(
    scanned: DataFrame, counts: Column, source: str = "source", listing: DataFrame | None = None
) -> DataFrame:
    """``files, findings, errors`` over scrubbed sources.

    ``counts`` is the number of findings of a row, null where a source could
    not be read.  Sources of a ``listing`` that were not scanned are errors too.
    """
    seen = scanned.select(F.col(source).alias("_s"), counts.alias("_n"), counts.isNull().alias("_bad"), F.lit(True).alias("_read"))
    if listing is not None:
        seen = seen.unionByName(
            listing.select(F.col(source).alias("_s"), F.lit(None).alias("_n"), F.lit(False).alias("_bad"), F.lit(False).alias("_read"))
        )
    per_source = seen.groupBy("_s").agg(F.sum("_n").alias("n"), (F.max("_read") & ~F.max("_bad")).alias("fine"))
    return per_source.agg(
        F.count_if("fine").alias("files"),
        F.coalesce(F.sum(F.when(F.col("fine"), F.col("n"))), F.lit(0)).alias("findings"),
        F.count_if(~F.col("fine")).alias("errors"),
    )


def quoted(value: Column) -> Column:
    """A string the way Python's repr shows it, for plain printable text."""
    body = value
    for char, shown in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        body = F.replace(body, F.lit(char), F.lit(shown))
    single = F.contains(value, F.lit("'"))
    double = F.contains(value, F.lit('"'))
    return (
        F.when(~single, F.concat(F.lit("'"), body, F.lit("'")))
        .when(~double, F.concat(F.lit('"'), body, F.lit('"')))
        .otherwise(F.concat(F.lit("'"), F.replace(body, F.lit("'"), F.lit("\\'")), F.lit("'")))
    )


def finding_line(include_original: bool = False) -> Column:
    parts = [
        F.lit("  ["),
        F.col("pattern"),
        F.lit("] ("),
        F.col("category"),
        F.lit(", conf="),
        percent(F.col("confidence")),
        F.lit(")  →  "),
        quoted(F.col("masked")),
    ]
    if include_original:
        parts += [F.lit("  original: "), quoted(F.col("original"))]
    parts += [F.lit("  @ "), F.col("source"), F.lit("+"), F.col("start").cast("string")]
    return F.concat(*parts)


def report_lines(
    found: DataFrame,
    generated_at: str,
    order: tuple[str, ...] = ("source", "start"),
    include_original: bool = False,
    title: str = "DE-IDENTIFICATION REPORT",
) -> DataFrame:
    """Plain-text report as rows ``(section, rank, line)``.

    Sort by ``section`` and ``rank`` to read it.  The findings part keeps its
    order columns packed in ``rank`` instead of one running number, so no
    single task has to see all findings.
    """
    spark = found.sparkSession
    # read twice; originals are stored only if they are shown
    found = scratch.kept(found if include_original else found.drop("original"))
    rule, thin = "=" * 60, "-" * 60
    fixed = [
        (0, "0", rule),
        (0, "1", f"  {title}"),
        (0, "2", f"  Generated: {generated_at}"),
        (0, "3", rule),
        (3, "0", ""),
        (3, "1", "  FINDINGS"),
        (3, "2", thin),
        (5, "0", rule),
    ]
    frame = spark.createDataFrame(fixed, "section int, rank string, line string")
    per_category = F.concat(
        F.lit("    "),
        F.rpad("category", F.greatest(F.lit(20), F.length("category")), " "),
        F.lit(" "),
        F.col("findings").cast("string"),
    )
    totals = audit_summary(found).select(
        F.when(F.col("category").isNull(), 1).otherwise(2).alias("section"),
        F.coalesce("category", F.lit("")).alias("rank"),
        F.when(
            F.col("category").isNull(),
            F.concat(F.lit("  Total findings : "), F.col("findings").cast("string")),
        )
        .otherwise(per_category)
        .alias("line"),
    )
    ranks = [
        F.lpad(F.col(c).cast("string"), 20, "0")
        if found.schema[c].dataType.typeName() in ("integer", "long")
        else F.col(c)
        for c in order
    ]
    body = found.select(
        F.lit(4).alias("section"),
        F.concat_ws("\x00", *ranks).alias("rank"),
        finding_line(include_original).alias("line"),
    )
    return frame.unionByName(totals).unionByName(body)


def audit_report(found: DataFrame, generated_at: str, include_original: bool = False) -> DataFrame:
    """Header of the JSON audit: one row with totals and a category map.

    The findings themselves stay rows (``audit_rows``), next to this header.
    """
    return (
        found.groupBy("category")
        .agg(F.count("*").alias("n"))
        .agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("total_findings"),
            F.map_from_entries(
                F.sort_array(F.collect_list(F.struct("category", "n")))
            ).alias("summary_by_category"),
        )
        .select(F.lit(generated_at).alias("generated_at"), "total_findings", "summary_by_category")
    )
