"""Every operator as a query over the given tables, with its expected SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwell.functions.catalog import NAMES, catalog_frame, custom_pattern
from maskwell.operators import audit as A
from maskwell.operators import documents as D
from maskwell.operators import reports as R
from maskwell.operators import spans as S
from maskwell.operators import tokens as TK
from maskwell.operators import long_values as LV
from maskwell.operators.allow import exclude_allowed, union_values
from maskwell.operators.nested import scrub_nested_columns
from maskwell.operators.scrub import (
    dry_run,
    filter_findings,
    findings,
    findings_view,
    scrub_cells,
    scrub_columns,
)
from maskwell.plans import policy as PO
from maskwell.plans.policy import Policy
from maskwell.plans.scratch import delete, kept, new_path
from maskwell.sources import readers as RD
from maskwell.sources import writers as WR
from maskwell.streaming import streams as ST
from workload import oracle as O
from workload.data import (
    DOCUMENTS_SQL,
    EVENTS_SQL,
    LEAKS_SQL,
    documents,
    event_lines,
    leaks,
    table,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

STAMP = "2026-01-01T00:00:00+00:00"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(name)
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def placed(found: DataFrame, *cols: str) -> DataFrame:
    """Findings with column names that are no SQL keywords."""
    out = found.withColumnRenamed("start", "start_at").withColumnRenamed("end", "end_at")
    return out.select(*cols) if cols else out


def noted(df: DataFrame) -> DataFrame:
    """A second text column next to the leak lines."""
    return df.withColumn(
        "note", F.concat(F.lit("owner user"), F.col("cust").cast("string"), F.lit("@example.com"))
    )


NOTED_SQL = f"SELECT *, 'owner user' || cust || '@example.com' AS note FROM ({LEAKS_SQL})"
NOTES_SQL = f"SELECT id, note AS text FROM ({NOTED_SQL})"

# -- single patterns --------------------------------------------------------------

IN_DOCUMENTS = ("email", "phone", "credit_card", "ipv4")


def _pattern_queries(name: str) -> None:
    in_docs = name in IN_DOCUMENTS
    source = documents if in_docs else leaks
    src = DOCUMENTS_SQL if in_docs else LEAKS_SQL
    only = Policy.only(name)

    @query(f"detect_{name}", O.rows("id, start_at, end_at, original", src=src, names=[name]))
    def detect(spark: SparkSession, sf: str) -> DataFrame:
        return placed(findings(source(spark, sf), "id", "text", only), "id", "start_at", "end_at", "original")

    @query(f"mask_partial_{name}", O.rows("id, start_at, masked", src=LEAKS_SQL, names=[name]))
    def mask(spark: SparkSession, sf: str) -> DataFrame:
        return placed(findings(leaks(spark, sf), "id", "text", only), "id", "start_at", "masked")


for _name in NAMES:
    _pattern_queries(_name)

# -- styles and resolution ----------------------------------------------------------


def _scrub_query(name: str, policy: Policy, source: Callable, src: str, **how) -> None:
    @query(name, O.texts(src=src, **how))
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return scrub_columns(source(spark, sf), "text", policy, report=False).select("id", "text")


for _style in ("partial", "label", "full", "redacted", "token"):
    _scrub_query(
        f"scrub_{_style}", Policy(mask_style=_style), documents, DOCUMENTS_SQL, style=_style
    )
_scrub_query("scrub_partial_char", Policy(mask_char="#"), leaks, LEAKS_SQL, char="#")
_scrub_query(
    "scrub_full_chars", Policy(mask_style="full", mask_char="xy"), leaks, LEAKS_SQL, style="full", char="xy"
)
_scrub_query("tokens_value", Policy(mask_style="token"), leaks, LEAKS_SQL, style="token")

FULL_ROW = "id, seq, pattern, category, confidence, original, masked, start_at, end_at"


@query("scrub_overlap", O.rows(FULL_ROW, src=LEAKS_SQL))
def scrub_overlap(spark, sf):
    return placed(findings(leaks(spark, sf), "id", "text")).drop("field")


@query("findings_rows", O.rows(FULL_ROW, src=DOCUMENTS_SQL))
def findings_rows(spark, sf):
    return placed(findings(documents(spark, sf), "id", "text")).drop("field")


_PAGES = "SELECT page_id AS id, html AS text FROM pages"


@query("scrub_pages", O.texts(src=_PAGES, style="label"))
def scrub_pages(spark, sf):
    raw = RD.spread(table(spark, sf, "pages").select("page_id", "html"))
    pages = raw.select(F.col("page_id").alias("id"), F.col("html").alias("text"))
    return scrub_columns(pages, "text", Policy(mask_style="label"), report=False)


_TURNS = "SELECT conv_id * 1000 + turn AS id, text FROM conversations"


@query("scrub_conversations", O.texts(src=_TURNS, style="redacted"))
def scrub_conversations(spark, sf):
    turns = table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text"
    )
    return scrub_columns(turns, "text", Policy(mask_style="redacted"), report=False)


# -- policies -----------------------------------------------------------------------

for _std, _list in O.STANDARD.items():
    _scrub_query(f"policy_{_std}", Policy.from_standard(_std), leaks, LEAKS_SQL, names=_list.split())

_PROFILE_SQL = {
    "GDPR": ("redacted", ()),
    "HIPAA": ("token", ("ipv4", "url_credentials")),
    "SOC2": ("partial", ("ipv4",)),
    "Minimal": ("partial", ("ipv4", "generic_credential", "url_credentials", "phone")),
}
for _prof, (_style, _off) in _PROFILE_SQL.items():
    _scrub_query(
        f"profile_{_prof.lower()}",
        Policy.from_profile(_prof),
        leaks,
        LEAKS_SQL,
        style=_style,
        names=[n for n in NAMES if n not in _off],
    )

_scrub_query(
    "policy_unknown_standard",
    Policy.from_standard("no-such"),
    leaks,
    LEAKS_SQL,
    names=O.STANDARD["gdpr"].split(),
)
_scrub_query(
    "categories",
    Policy(categories=frozenset({"pii", "network"})),
    leaks,
    LEAKS_SQL,
    names=[p[0] for p in O.PATTERNS if p[1] in ("pii", "network")],
)
_scrub_query(
    "min_confidence",
    Policy(min_confidence=0.8),
    leaks,
    LEAKS_SQL,
    names=[p[0] for p in O.PATTERNS if p[2] >= 0.8],
)
_scrub_query(
    "disabled",
    Policy(disabled_patterns=frozenset({"generic_credential", "url_credentials"})),
    leaks,
    LEAKS_SQL,
    names=[n for n in NAMES if n not in ("generic_credential", "url_credentials")],
)

_ALLOW = ("ops@example.com", "AB12CDEF", "postgres://u:p@", "4111111111111111")
_ALLOW_SQL = "original IN (" + ", ".join(O.lit(v) for v in _ALLOW) + ")"
_scrub_query("allowlist_small", Policy(allowlist=frozenset(_ALLOW)), leaks, LEAKS_SQL, drop=_ALLOW_SQL)

_ALLOW_TABLE_SQL = (
    "original IN (SELECT 'user' || c_custkey || '@example.com' FROM customer"
    " UNION SELECT '192.168.' || s_suppkey || '.' || s_suppkey FROM supplier"
    " UNION SELECT 'postgres://u:p@' FROM region)"
)


def _allow_table(spark: SparkSession, sf: str) -> DataFrame:
    mails = table(spark, sf, "customer").select(
        F.concat(F.lit(" user"), F.col("c_custkey").cast("string"), F.lit("@example.com ")).alias("value")
    )
    key = F.col("s_suppkey").cast("string")
    hosts = table(spark, sf, "supplier").select(
        F.concat(F.lit("192.168."), key, F.lit("."), key).alias("value")
    )
    fixed = table(spark, sf, "region").select(F.lit("postgres://u:p@").alias("value"))
    return union_values(mails, hosts, fixed)


@query("allowlist_join", O.texts(src=LEAKS_SQL, drop=_ALLOW_TABLE_SQL))
def allowlist_join(spark, sf):
    rows, _ = exclude_allowed(leaks(spark, sf), "id", "text", _allow_table(spark, sf))
    return rows.select("id", "text")


@query("allowlist_join_findings", O.rows("id, seq, pattern, masked, start_at", src=LEAKS_SQL, drop=_ALLOW_TABLE_SQL))
def allowlist_join_findings(spark, sf):
    _, found = exclude_allowed(leaks(spark, sf), "id", "text", _allow_table(spark, sf))
    return placed(found, "id", "seq", "pattern", "masked", "start_at")


@query(
    "allowlist_ignore_case",
    O.texts(src=LEAKS_SQL, drop=_ALLOW_TABLE_SQL.replace("original IN", "lower(original) IN")),
)
def allowlist_ignore_case(spark, sf):
    upper = _allow_table(spark, sf).select(F.upper("value").alias("value"))
    rows, _ = exclude_allowed(leaks(spark, sf), "id", "text", upper, ignore_case=True)
    return rows.select("id", "text")


_EMP = ("employee_id", "pii", 1.0, r"EMP-\d{6}", "left(original, 2) || repeat('*', 8)")
_CONFIG = {
    "allowlist": ["ops@example.com", "10.0.0.1"],
    "disabled_patterns": ["ipv4", "mac_address"],
    "min_confidence": 0.7,
    "mask_style": "partial",
    "custom_patterns": [
        {"name": "employee_id", "category": "pii", "regex": r"EMP-\d{6}", "confidence": 1.0},
        {"name": "too_low", "regex": "nothing", "confidence": 0.5},
        {"name": "broken", "regex": "("},
    ],
}
_OVERLAY = [n for n in O.STANDARD["gdpr"].split() if n not in ("ipv4", "mac_address", "us_passport")]
_scrub_query(
    "policy_overlay",
    Policy.from_standard("gdpr", mask_style="full").overlay(_CONFIG),
    leaks,
    LEAKS_SQL,
    names=_OVERLAY,
    extra=[_EMP],
    drop="original IN ('ops@example.com', '10.0.0.1')",
)
_scrub_query(
    "event_policy",
    PO.resolve_event_policy(
        settings={"default_standard": "pci", "default_min_confidence": "76", "default_allowlist": "4111111111111111, x"},
        standard="soc2",
        mask_style="label",
        config={"custom_patterns": [_CONFIG["custom_patterns"][0]]},
    ),
    leaks,
    LEAKS_SQL,
    names=[n for n in O.STANDARD["soc2"].split()],
    extra=[_EMP],
    style="label",
)
_scrub_query(
    "resolve_explicit",
    PO.resolve_explicit("HIPAA", mask_style="redacted", disable=["email"], min_confidence=0.7),
    leaks,
    LEAKS_SQL,
    names=[p[0] for p in O.PATTERNS if p[0] != "email" and p[2] >= 0.7],
    style="redacted",
)
_ORDER_SQL = (
    "order_no",
    "custom",
    0.9,
    r"order (\d+)",
    r"CASE WHEN length(original) - 6 > 4 THEN left(regexp_extract(original, '(\d+)', 1), 2)"
    r" || repeat('*', CAST(greatest(4, length(original) - 8) AS INTEGER)) ELSE '****' END",
)
_scrub_query(
    "custom_pattern",
    Policy(extra_patterns=(custom_pattern("order_no", r"order (\d+)", confidence=0.9),)),
    leaks,
    LEAKS_SQL,
    extra=[_ORDER_SQL],
)
_scrub_query(
    "custom_mask_native",
    Policy(extra_patterns=(custom_pattern("employee_id", r"EMP-\d{6}", "pii", mask=F.reverse),)),
    leaks,
    LEAKS_SQL,
    extra=[(*_EMP[:4], "reverse(original)")],
)
_scrub_query(
    "custom_mask_python",
    Policy(extra_patterns=(custom_pattern("employee_id", r"EMP-\d{6}", "pii", py_mask=lambda s: s[::-1].lower()),)),
    leaks,
    LEAKS_SQL,
    extra=[(*_EMP[:4], "lower(reverse(original))")],
)


@query(
    "profile_overlay",
    O.texts(src=LEAKS_SQL, style="label", names=[n for n in NAMES if n not in ("email",)]),
)
def profile_overlay(spark, sf):
    """A stored profile replaces the built-in one of the same name."""
    mine = PO.profiles_frame(
        spark, [{"name": "SOC2", "mask_style": "label", "disabled_patterns": ["email"]}, {"name": "Mine"}]
    )
    path = new_path(spark, "profiles")
    WR.write_profiles(mine, path)
    merged = PO.merged_by_name(PO.profiles_frame(spark), RD.read_profiles(spark, path))
    policy = Policy.from_profile("SOC2", RD.profile_rows(merged))
    return scrub_columns(leaks(spark, sf), "text", policy, report=False).select("id", "text")


_REFERENCE = (
    "SELECT p.pattern, p.category, p.confidence, count(f.id) AS findings FROM (VALUES "
    + ", ".join(f"({O.lit(n)}, {O.lit(c)}, CAST({f} AS DOUBLE))" for n, c, f, _ in O.PATTERNS if n in O.STANDARD["hipaa"].split())
    + ") p(pattern, category, confidence) LEFT JOIN found f ON f.pattern = p.pattern GROUP BY ALL"
)


@query("standard_patterns", f"{O.kept(src=LEAKS_SQL)}\n{_REFERENCE}")
def standard_patterns(spark, sf):
    """Patterns of a standard (semi-join) with how often each one was found."""
    chosen = PO.patterns_of(catalog_frame(spark), PO.standards_frame(spark), "hipaa")
    counts = findings(leaks(spark, sf), "id", "text").groupBy("pattern").agg(F.count("*").alias("n"))
    return chosen.join(counts, "pattern", "left").select(
        "pattern", "category", "confidence", F.coalesce("n", F.lit(0)).alias("findings")
    )


# -- several fields -------------------------------------------------------------------

_FIELDS_SQL = (
    "SELECT a.id, a.text, a.text_findings, a.text_finding_count, b.text AS note, "
    "b.text_findings AS note_findings, b.text_finding_count AS note_finding_count FROM ("
    + O.reported("SELECT * FROM report", src=LEAKS_SQL, names=O.STANDARD["gdpr"].split())
    + ") a JOIN ("
    + O.reported("SELECT * FROM report", src=NOTES_SQL, names=O.STANDARD["gdpr"].split())
    + ") b ON a.id = b.id"
)


@query("scrub_fields_report", _FIELDS_SQL)
def scrub_fields_report(spark, sf):
    out = scrub_columns(noted(leaks(spark, sf)), "text, absent, note", Policy.from_standard("gdpr"))
    return out.select(
        "id", "text", "text_findings", "text_finding_count", "note", "note_findings", "note_finding_count"
    )


@query(
    "scrub_cells",
    f"SELECT a.id, a.text, b.text AS note, a.host FROM ({O.texts('id, text, host', src=LEAKS_SQL)}) a "
    f"JOIN ({O.texts(src=NOTES_SQL)}) b ON a.id = b.id",
)
def scrub_all_cells(spark, sf):
    return scrub_cells(noted(leaks(spark, sf)).select("id", "text", "note", "host"))


# one value per row and field: id = 2 * row + field
_PAIR_SRC = (
    f"SELECT id * 2 AS id, id AS doc, 0 AS field_at, note AS text FROM ({NOTED_SQL})"
    f" UNION ALL SELECT id * 2 + 1, id, 1, text FROM ({LEAKS_SQL})"
)


def _paired(select: str, **how) -> str:
    inner = O.texts("id, doc, field_at, text", src=_PAIR_SRC, **how)
    return f"SELECT {select} FROM ({inner}) a JOIN ({inner}) b ON a.doc = b.doc WHERE a.field_at = 0 AND b.field_at = 1"


_ROW_TOKENS = dict(style="token", scope="doc", first="doc, field_at, start_at")


@query("tokens_row", _paired("a.doc AS id, a.text AS note, b.text", **_ROW_TOKENS))
def tokens_row(spark, sf):
    rows = noted(leaks(spark, sf)).select("id", "note", "text")
    return scrub_columns(rows, "note,text", Policy(mask_style="token"), report=False, token_scope="row")


# -- findings lists ---------------------------------------------------------------------

_VIEW = (
    "id, seq, pattern, category, CAST(CAST(round(confidence * 100) AS INTEGER) AS VARCHAR) || '%' AS conf, "
    "CASE WHEN length(original) > 44 THEN left(original, 41) || '…' ELSE original END AS original, "
    "masked, confidence < 0.9 AS low_confidence"
)


@query("low_confidence", O.rows(_VIEW, src=LEAKS_SQL))
def low_confidence(spark, sf):
    return findings_view(findings(leaks(spark, sf), "id", "text")).select(
        "id", "seq", "pattern", "category", "conf", "original", "masked", "low_confidence"
    )


@query(
    "findings_filter",
    f"SELECT * FROM ({O.rows(_VIEW, src=LEAKS_SQL)}) WHERE contains(lower(concat_ws(chr(1), pattern, category, conf, original, masked)), 'bearer')",
)
def findings_filter(spark, sf):
    view = findings_view(findings(leaks(spark, sf), "id", "text"))
    return filter_findings(view, " BEARER ").select(
        "id", "seq", "pattern", "category", "conf", "original", "masked", "low_confidence"
    )


@query(
    "dry_run",
    O.rows(
        "id, seq, pattern, CAST(CAST(round(confidence * 100) AS INTEGER) AS VARCHAR) || '%' AS conf, substring(original, 1, 60) AS original",
        src=LEAKS_SQL,
    ),
)
def dry_run_query(spark, sf):
    return dry_run(leaks(spark, sf), "id", "text").drop("field")


# -- dashboard ------------------------------------------------------------------------------

_GDPR = Policy.from_standard("gdpr")
_GDPR_NAMES = O.STANDARD["gdpr"].split()


@query("events_sampled", "SELECT count(*) AS count FROM (SELECT * FROM events ORDER BY event_id LIMIT 500)")
def events_sampled(spark, sf):
    return R.events_sampled(R.sample(table(spark, sf, "events"), R.SAMPLE, "event_id"))


@query(
    "events_with_findings",
    O.reported("SELECT count(*) AS count FROM report WHERE text_findings IS NOT NULL", src=LEAKS_SQL, names=_GDPR_NAMES),
)
def events_with_findings(spark, sf):
    return R.events_with_findings(leaks(spark, sf), "text", _GDPR)


@query(
    "total_findings",
    O.reported("SELECT CAST(sum(text_finding_count) AS BIGINT) AS total FROM report", src=LEAKS_SQL, names=_GDPR_NAMES),
)
def total_findings(spark, sf):
    return R.total_findings(leaks(spark, sf), "text", _GDPR)


@query(
    "findings_by_pattern",
    O.rows("pattern, count(*) AS count", src=LEAKS_SQL, names=_GDPR_NAMES) + " GROUP BY pattern",
)
def findings_by_pattern(spark, sf):
    return R.findings_by_pattern(leaks(spark, sf), "text", _GDPR)


_LABELLED = O.rows("pattern, count(*) AS count", src=DOCUMENTS_SQL) + " GROUP BY pattern"


@query("documents_by_pattern", _LABELLED)
def documents_by_pattern(spark, sf):
    """Flagship: scrub the documents, count what was found."""
    return R.findings_by_pattern(documents(spark, sf), "text", Policy(mask_style="label"))


_BY_HOST = "SELECT cust AS host, count(*) AS count FROM report WHERE text_findings IS NOT NULL GROUP BY cust ORDER BY count DESC, cust LIMIT 10"


@query("top_sources", O.reported(_BY_HOST, src=LEAKS_SQL, names=_GDPR_NAMES))
def top_sources(spark, sf):
    by_customer = leaks(spark, sf).drop("host").withColumnRenamed("cust", "host")
    return R.top_sources(by_customer, "text", _GDPR, "host")


@query(
    "sample_table",
    O.reported(
        "SELECT CAST(ts AS VARCHAR) AS ts, host, sourcetype, text AS scrubbed, text_findings AS patterns_found, text_finding_count AS finding_count FROM report WHERE text_findings IS NOT NULL",
        src=f"{LEAKS_SQL} ORDER BY id LIMIT 50",
        names=_GDPR_NAMES,
    ),
)
def sample_table(spark, sf):
    first = R.sample(leaks(spark, sf), R.TABLE_SAMPLE, "id")
    out = R.sample_table(first, "text", _GDPR, ["ts", "host", "sourcetype"])
    return out.withColumn("ts", F.col("ts").cast("string"))


_SOC2_REF = (
    "SELECT p.category, p.pattern, count(f.id) AS findings FROM (VALUES "
    + ", ".join(f"({O.lit(n)}, {O.lit(c)})" for n, c, _, _ in O.PATTERNS if n in O.STANDARD["soc2"].split())
    + ") p(pattern, category) LEFT JOIN found f ON f.pattern = p.pattern GROUP BY ALL"
)


@query("pattern_reference", f"{O.kept(src=LEAKS_SQL, names=O.STANDARD['soc2'].split())}\n{_SOC2_REF}")
def pattern_reference(spark, sf):
    counts = (
        findings(leaks(spark, sf), "id", "text", Policy.from_standard("soc2"))
        .groupBy("pattern")
        .agg(F.count("*").alias("n"))
    )
    return (
        R.pattern_reference(spark, "soc2")
        .join(counts, "pattern", "left")
        .select("category", "pattern", F.coalesce("n", F.lit(0)).alias("findings"))
    )


@query(
    "kpi_bucket",
    O.reported(
        "SELECT host, CAST(sum(text_finding_count) AS BIGINT) AS total, "
        "CASE WHEN count(text_findings) >= 50 THEN 'many' WHEN count(text_findings) >= 1 THEN 'some' ELSE 'none' END AS events_range, "
        "CASE WHEN sum(text_finding_count) >= 100 THEN 'many' WHEN sum(text_finding_count) >= 1 THEN 'some' ELSE 'none' END AS findings_range "
        "FROM report GROUP BY host",
        src=LEAKS_SQL,
        names=_GDPR_NAMES,
    ),
)
def kpi_bucket(spark, sf):
    scrubbed = scrub_columns(leaks(spark, sf), "text", _GDPR)
    per_host = scrubbed.groupBy("host").agg(
        F.sum("text_finding_count").cast("bigint").alias("total"), F.count("text_findings").alias("events")
    )
    return per_host.select(
        "host",
        "total",
        R.range_bucket(F.col("events"), R.EVENT_RANGES).alias("events_range"),
        R.range_bucket(F.col("total"), R.FINDING_RANGES).alias("findings_range"),
    )


_NOW = "2024-01-02 09:41:00"
_LAST = (
    f"SELECT * FROM ({EVENTS_SQL}) WHERE ts >= date_trunc('hour', TIMESTAMP '{_NOW}' - INTERVAL 24 HOUR) "
    f"AND ts <= TIMESTAMP '{_NOW}' AND host = 'error'"
)


@query("last_24h", O.reported("SELECT id, text, text_findings, text_finding_count FROM report", src=_LAST))
def last_24h(spark, sf):
    events = table(spark, sf, "events")
    now = F.lit(_NOW).cast(events.schema["ts"].dataType)
    recent = R.last_hours(events, "ts", now, 24, F.col("event_type") == "error")
    out = scrub_columns(event_lines(recent), "text", Policy())
    return out.select("id", "text", "text_findings", "text_finding_count")


# -- audit ------------------------------------------------------------------------------------


def _sourced(spark: SparkSession, sf: str) -> DataFrame:
    docs = leaks(spark, sf)
    path = F.concat(F.lit("logs/"), F.lpad(F.col("id").cast("string"), 12, "0"), F.lit(".log"))
    return docs.withColumn("source", path)


_SOURCE = "'logs/' || lpad(CAST(id AS VARCHAR), 12, '0') || '.log'"
_AUDIT = f"'{STAMP}' AS timestamp, {_SOURCE} AS source, pattern, category, confidence, original, masked, start_at AS char_offset"


@query("audit_flat", O.rows(_AUDIT, src=LEAKS_SQL))
def audit_flat(spark, sf):
    return A.audit_rows(findings(_sourced(spark, sf), "source", "text"), "source", STAMP, True)


@query("audit_no_original", O.rows(_AUDIT.replace("original, ", ""), src=LEAKS_SQL))
def audit_no_original(spark, sf):
    return A.audit_rows(findings(_sourced(spark, sf), "source", "text"), "source", STAMP)


@query("audit_summary", O.rows("category, count(*) AS findings", src=LEAKS_SQL) + " GROUP BY ROLLUP (category)")
def audit_summary(spark, sf):
    return A.audit_summary(findings(leaks(spark, sf), "id", "text"))


@query(
    "source_totals",
    f"SELECT {_SOURCE} AS source, CAST(coalesce(n, 0) AS BIGINT) AS findings FROM ("
    + O.reported("SELECT id, text_finding_count AS n FROM report", src=LEAKS_SQL)
    + ")",
)
def source_totals(spark, sf):
    docs = _sourced(spark, sf)
    return A.source_totals(findings(docs, "source", "text"), scanned=docs)


@query(
    "audit_report",
    f"SELECT '{STAMP}' AS generated_at, CAST(sum(n) AS BIGINT) AS total_findings, "
    "string_agg(category || '=' || n, ',' ORDER BY category) AS summary FROM ("
    + O.rows("category, count(*) AS n", src=LEAKS_SQL)
    + " GROUP BY category)",
)
def audit_report(spark, sf):
    report = A.audit_report(findings(leaks(spark, sf), "id", "text"), STAMP)
    pairs = F.transform(
        F.map_entries("summary_by_category"),
        lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")),
    )
    return report.select("generated_at", "total_findings", F.array_join(pairs, ",").alias("summary"))


_QUOTED = (
    "CASE WHEN NOT contains({v}, '''') THEN '''' || {v} || '''' WHEN NOT contains({v}, '\"') THEN '\"' || {v} || '\"' "
    "ELSE '''' || replace({v}, '''', '\\''') || '''' END"
)
_LINE = (
    "'  [' || pattern || '] (' || category || ', conf=' || CAST(round(confidence * 100) AS INTEGER) || '%)  →  ' || "
    + _QUOTED.format(v="masked")
    + f" || '  @ ' || {_SOURCE} || '+' || start_at"
)
_REPORT_SQL = f"""{O.kept(src=LEAKS_SQL)}
SELECT section, line FROM (VALUES (0, '{"=" * 60}'), (0, '  DE-IDENTIFICATION REPORT'), (0, '  Generated: {STAMP}'), (0, '{"=" * 60}'),
 (3, ''), (3, '  FINDINGS'), (3, '{"-" * 60}'), (5, '{"=" * 60}')) t(section, line)
UNION ALL SELECT 1, '  Total findings : ' || count(*) FROM found
UNION ALL SELECT 2, '    ' || rpad(category, 20, ' ') || ' ' || count(*) FROM found GROUP BY category
UNION ALL SELECT 4, {_LINE} FROM found"""


@query("audit_text", _REPORT_SQL)
def audit_text(spark, sf):
    found = findings(_sourced(spark, sf), "source", "text")
    return A.report_lines(found, STAMP).select("section", "line")


@query(
    "batch_totals",
    "SELECT count(*) AS files, CAST(sum(coalesce(n, 0)) AS BIGINT) AS findings, CAST(0 AS BIGINT) AS errors FROM ("
    + O.reported("SELECT id, text_finding_count AS n FROM report", src=LEAKS_SQL)
    + ")",
)
def batch_totals(spark, sf):
    out = scrub_columns(_sourced(spark, sf), "text")
    counts = F.coalesce("text_finding_count", F.lit(0))
    return A.batch_totals(out, counts)


# -- nested, JSON, CSV ------------------------------------------------------------------------

_JSON = (
    "'{{\"id\": ' || cast(id as string) || ', \"msg\": \"' || replace({text}, '\"', chr(92) || '\"') || "
    "'\", \"tags\": [\"' || {note} || '\", null, 1.50]}}'"
)


def _json_docs(spark: SparkSession, sf: str) -> DataFrame:
    rows = noted(leaks(spark, sf))
    return rows.select("id", F.expr(_JSON.format(text="text", note="note")).alias("doc"))


_BOTH = f"FROM ({O.texts(src=LEAKS_SQL)}) a JOIN ({O.texts(src=NOTES_SQL)}) b ON a.id = b.id"
_JSON_DUCK = _JSON.format(text="a.text", note="b.text").replace("cast(id as string)", "a.id")


@query("scrub_json_values", f"SELECT a.id, {_JSON_DUCK} AS doc {_BOTH}")
def scrub_json_values(spark, sf):
    return D.scrub_json_column(_json_docs(spark, sf), "doc").select("id", "doc")


_BROKEN_SRC = (
    "SELECT id, left(doc, length(doc) - 1) AS text FROM (SELECT id, "
    + _JSON.format(text="text", note="note").replace("cast(id as string)", "id")
    + f" AS doc FROM ({NOTED_SQL}))"
)


@query("scrub_json_fallback", O.texts("id, text AS doc", src=_BROKEN_SRC))
def scrub_json_fallback(spark, sf):
    cut = _json_docs(spark, sf).withColumn("doc", F.expr("left(doc, length(doc) - 1)"))
    return D.scrub_json_column(cut, "doc").select("id", "doc")


_PAIR_JSON_SRC = (
    f"SELECT id * 2 AS id, id AS doc, 0 AS field_at, text FROM ({LEAKS_SQL})"
    f" UNION ALL SELECT id * 2 + 1, id, 1, note FROM ({NOTED_SQL})"
)
_TOKEN_PAIR = O.texts("id, doc, field_at, text", src=_PAIR_JSON_SRC, **_ROW_TOKENS)


@query(
    "tokens_json_document",
    f"SELECT a.doc AS id, {_JSON_DUCK.replace('a.id', 'a.doc')} AS doc FROM ({_TOKEN_PAIR}) a "
    f"JOIN ({_TOKEN_PAIR}) b ON a.doc = b.doc WHERE a.field_at = 0 AND b.field_at = 1",
)
def tokens_json_document(spark, sf):
    return D.scrub_json_column(_json_docs(spark, sf), "doc", Policy(mask_style="token")).select("id", "doc")


@query(
    "scrub_json_typed",
    f"SELECT a.id, a.text AS msg, CASE WHEN a.text IS NOT NULL THEN b.text END AS tag {_BOTH}",
)
def scrub_json_typed(spark, sf):
    """Schema inferred once, then typed columns instead of text."""
    docs = _json_docs(spark, sf)
    schema = RD.json_schema_of(docs, "doc")
    typed = docs.select("id", F.from_json("doc", schema).alias("v"))
    out = scrub_nested_columns(typed, ["v"])
    return out.select("id", F.col("v.msg").alias("msg"), F.col("v.tags").getItem(0).cast("string").alias("tag"))


@query(
    "scrub_nested",
    "SELECT a.id, a.text AS in_struct, b.text AS in_array, a.text AS in_map, "
    "CAST(coalesce(x.n, 0) * 2 + coalesce(y.n, 0) AS INTEGER) AS n FROM ("
    + O.texts(src=LEAKS_SQL)
    + ") a JOIN ("
    + O.texts(src=NOTES_SQL)
    + ") b ON a.id = b.id LEFT JOIN ("
    + O.rows("id, count(*) AS n", src=LEAKS_SQL)
    + " GROUP BY id) x ON x.id = a.id LEFT JOIN ("
    + O.rows("id, count(*) AS n", src=NOTES_SQL)
    + " GROUP BY id) y ON y.id = a.id",
)
def scrub_nested_query(spark, sf):
    rows = noted(leaks(spark, sf)).select(
        "id",
        F.struct(
            F.col("text").alias("msg"),
            F.col("id").alias("n"),
            F.array(F.struct(F.col("note").alias("note"))).alias("list"),
            F.create_map(F.lit("ops@example.com"), F.col("text")).alias("map"),
        ).alias("v"),
    )
    return scrub_nested_columns(rows, ["v"]).select(
        "id",
        F.col("v.msg").alias("in_struct"),
        F.col("v.list").getItem(0)["note"].alias("in_array"),
        F.col("v.map")["ops@example.com"].alias("in_map"),
        F.size("v_found").alias("n"),
    )


@query(
    "scrub_csv_cells",
    f"SELECT CAST(a.id AS VARCHAR) AS id, nullif(a.text, '') AS text, b.text AS note FROM ({O.texts(src=LEAKS_SQL)}) a "
    f"JOIN ({O.texts(src=NOTES_SQL)}) b ON a.id = b.id",
)
def scrub_csv_cells(spark, sf):
    """CSV folder in, cells scrubbed, CSV folder out, read back."""
    src, dst = new_path(spark, "csv-in"), new_path(spark, "csv-out")
    WR.write_csv(noted(leaks(spark, sf)).select("id", "text", "note"), src, sep=";")
    WR.write_csv(scrub_cells(RD.read_csv(spark, src, sep=";")), dst, sep=";")
    return RD.read_csv(spark, dst, sep=";")


_CSV_DOC = "'id,note,msg' || chr(10) || cast({id} as string) || ',' || {note} || ',\"' || replace({text}, '\"', '\"\"') || '\"' || chr(10)"


def _csv_docs(spark: SparkSession, sf: str) -> DataFrame:
    rows = noted(leaks(spark, sf))
    return rows.select("id", F.expr(_CSV_DOC.format(id="id", text="text", note="note")).alias("text"))


@query(
    "scrub_csv_text",
    f"SELECT a.id, {_CSV_DOC.format(id='a.id', text='a.text', note='b.text')} AS text {_BOTH}",
)
def scrub_csv_text(spark, sf):
    return D.scrub_csv_column(_csv_docs(spark, sf), "text").select("id", "text")


def _files(spark: SparkSession, sf: str) -> DataFrame:
    """A folder as a table: JSON, CSV and plain text by turns."""
    name = F.lpad(F.col("id").cast("string"), 12, "0")
    js = _json_docs(spark, sf).select(name.alias("name"), F.col("doc").alias("text"))
    cs = _csv_docs(spark, sf).select(name.alias("name"), "text")
    tx = leaks(spark, sf).select(name.alias("name"), "text")
    all_files = (
        js.withColumn("source", F.concat(F.lit("a/"), "name", F.lit(".JSON")))
        .unionByName(cs.withColumn("source", F.concat(F.lit("b/"), "name", F.lit(".csv"))))
        .unionByName(tx.withColumn("source", F.concat(F.lit("c/"), "name", F.lit(".log"))))
    )
    return all_files.select("source", RD.format_of(F.col("source")).alias("format"), "text")


_PADDED = "lpad(CAST({k} AS VARCHAR), 12, '0')"
_FILES_SQL = (
    f"SELECT 'a/' || {_PADDED.format(k='a.id')} || '.JSON' AS source, 'json' AS format, {_JSON_DUCK} AS text {_BOTH} "
    f"UNION ALL SELECT 'b/' || {_PADDED.format(k='a.id')} || '.csv', 'csv', "
    f"{_CSV_DOC.format(id='a.id', text='a.text', note='b.text')} {_BOTH} "
    f"UNION ALL SELECT 'c/' || {_PADDED.format(k='id')} || '.log', 'text', text FROM ({O.texts(src=LEAKS_SQL)})"
)


@query("scrub_files", _FILES_SQL)
def scrub_files(spark, sf):
    return D.scrub_files(_files(spark, sf)).drop("findings")


# -- tokens ---------------------------------------------------------------------------------------

_TOKEN = Policy(mask_style="token")


@query("tokens_dataset", O.texts(src=LEAKS_SQL, style="token", scope=""))
def tokens_dataset(spark, sf):
    return TK.tokenize(leaks(spark, sf), "id", "text", _TOKEN).rows.select("id", "text")


@query(
    "tokens_dataset_map",
    O.rows("DISTINCT original, masked AS token, first_category AS category, num AS n", src=LEAKS_SQL, style="token", scope=""),
)
def tokens_dataset_map(spark, sf):
    return TK.tokenize(leaks(spark, sf), "id", "text", _TOKEN).tokens.select("original", "token", "category", "n")


@query(
    "tokens_document",
    O.texts("id, host, text", src=LEAKS_SQL, style="token", scope="host", first="host, id, start_at"),
)
def tokens_document(spark, sf):
    """One map per host; a host holds a fifth of all rows."""
    got = TK.tokenize(leaks(spark, sf), ["host", "id"], "text", _TOKEN, scope=["host"])
    return got.rows.select("id", "host", "text")


@query("tokens_documents_table", O.texts(src=DOCUMENTS_SQL, style="token", scope=""))
def tokens_documents_table(spark, sf):
    return TK.tokenize(documents(spark, sf), "id", "text", _TOKEN).rows.select("id", "text")


@query("tokens_findings", O.rows("id, pattern, original, masked, start_at", src=LEAKS_SQL, style="token", scope=""))
def tokens_findings(spark, sf):
    got = TK.tokenize(leaks(spark, sf), "id", "text", _TOKEN)
    return placed(got.findings, "id", "pattern", "original", "masked", "start_at")


_KNOWN = "SELECT 'user' || c_custkey || '@example.com' AS original, '[PII-' || lpad(CAST(c_custkey + 5 AS VARCHAR), CAST(greatest(3, length(CAST(c_custkey + 5 AS VARCHAR))) AS INTEGER), '0') || ']' AS token FROM customer"
_CONTINUE = f"""{O.kept(src=LEAKS_SQL)},
known AS ({_KNOWN}),
fresh AS (SELECT original, category, row_number() OVER (PARTITION BY original ORDER BY id, start_at) AS occ, id, start_at
  FROM found WHERE original NOT IN (SELECT original FROM known)),
made AS (SELECT original, category, row_number() OVER (ORDER BY id, start_at) + (SELECT max(c_custkey) + 5 FROM customer) AS n FROM fresh WHERE occ = 1),
map AS (SELECT original, token FROM known UNION ALL
  SELECT original, '[' || upper(category) || '-' || lpad(CAST(n AS VARCHAR), CAST(greatest(3, length(CAST(n AS VARCHAR))) AS INTEGER), '0') || ']' FROM made)
SELECT f.id, f.start_at, f.original, m.token AS masked FROM found f JOIN map m USING (original)"""


@query("tokens_continue", _CONTINUE)
def tokens_continue(spark, sf):
    customer = table(spark, sf, "customer")
    known = customer.select(
        F.concat(F.lit("user"), F.col("c_custkey").cast("string"), F.lit("@example.com")).alias("original"),
        F.format_string("[PII-%03d]", F.col("c_custkey") + 5).alias("token"),
    )
    path = new_path(spark, "tokens")
    WR.write_tokens(known, path)
    got = TK.tokenize(leaks(spark, sf), "id", "text", _TOKEN, known=RD.read_tokens(spark, path))
    return placed(got.findings, "id", "start_at", "original", "masked")


@query("detokenize", f"SELECT id, text FROM ({LEAKS_SQL})")
def detokenize(spark, sf):
    got = TK.tokenize(leaks(spark, sf), "id", "text", _TOKEN)
    return TK.detokenize(got.rows, "id", "text", got.tokens).select("id", "text")


@query("detokenize_scoped", f"SELECT id, host, text FROM ({LEAKS_SQL})")
def detokenize_scoped(spark, sf):
    got = TK.tokenize(leaks(spark, sf), ["host", "id"], "text", _TOKEN, scope=["host"])
    return TK.detokenize(got.rows, ["host", "id"], "text", got.tokens, scope=["host"]).select("id", "host", "text")


_FILE_VALUES = (
    f"SELECT id * 10 AS id, 'a/' || {_PADDED.format(k='id')} AS source, 0 AS seq0, text FROM ({LEAKS_SQL})"
    f" UNION ALL SELECT id * 10 + 1, 'a/' || {_PADDED.format(k='id')}, 1, note FROM ({NOTED_SQL}) WHERE text IS NOT NULL"
    f" UNION ALL SELECT id * 10 + 2, 'b/' || {_PADDED.format(k='id')}, 0, note FROM ({NOTED_SQL}) WHERE text IS NOT NULL"
    f" UNION ALL SELECT id * 10 + 3, 'b/' || {_PADDED.format(k='id')}, 1, text FROM ({LEAKS_SQL})"
    f" UNION ALL SELECT id * 10 + 4, 'c/' || {_PADDED.format(k='id')}, 0, text FROM ({LEAKS_SQL})"
)


@query(
    "tokens_files",
    O.rows("DISTINCT original, masked AS token", src=_FILE_VALUES, style="token", scope="", first="source, seq0, start_at"),
)
def tokens_files(spark, sf):
    return D.tokenize_files(_files(spark, sf)).tokens.select("original", "token")


# -- sinks -----------------------------------------------------------------------------------------


@query("sink_text", O.texts("coalesce(text, '') AS value", src=LEAKS_SQL))
def sink_text(spark, sf):
    path = new_path(spark, "text")
    out = scrub_columns(leaks(spark, sf), "text", report=False)
    WR.write_text(out, "text", path)
    return spark.read.text(path)


@query("sink_json", O.texts("id, text, host", src=LEAKS_SQL))
def sink_json(spark, sf):
    path = new_path(spark, "json")
    out = scrub_columns(leaks(spark, sf).select("id", "text", "host"), "text", report=False)
    WR.write_json(out, path)
    return RD.read_json(spark, path, "id bigint, text string, host string", multi_line=False)


@query("sink_tree", _FILES_SQL.replace(" AS source", " AS rel_path"))
def sink_tree(spark, sf):
    path = new_path(spark, "tree")
    WR.write_tree(D.scrub_files(_files(spark, sf)).withColumnRenamed("source", "rel_path"), path)
    return spark.read.parquet(path).select("rel_path", "format", "text")


@query(
    "sink_audit_csv",
    O.rows(_AUDIT.replace("confidence,", "CAST(confidence AS VARCHAR) AS confidence,").replace("start_at AS", "CAST(start_at AS VARCHAR) AS"), src=LEAKS_SQL),
)
def sink_audit_csv(spark, sf):
    path = new_path(spark, "audit-csv")
    WR.write_audit_csv(findings(_sourced(spark, sf), "source", "text"), path, STAMP, True)
    return RD.read_csv(spark, path)


@query("sink_audit_json", O.rows(_AUDIT.replace("original, ", ""), src=LEAKS_SQL))
def sink_audit_json(spark, sf):
    path = new_path(spark, "audit-json")
    WR.write_audit_json(findings(_sourced(spark, sf), "source", "text"), path, STAMP)
    return RD.read_json(
        spark,
        f"{path}/findings",
        "timestamp string, source string, pattern string, category string, confidence double, masked string, char_offset int",
        multi_line=False,
    )


_EVENT_SQL = (
    "'id=\"' || id || '\"' || CASE WHEN text <> '' THEN ' text=\"' || text || '\"' ELSE '' END || ' host=\"' || host || '\"'"
    " || CASE WHEN text_findings <> '' THEN ' text_findings=\"' || text_findings || '\" text_finding_count=\"' || text_finding_count || '\"' ELSE '' END AS event"
)


@query("summary_events", O.reported(f"SELECT {_EVENT_SQL} FROM report", src=LEAKS_SQL, names=_GDPR_NAMES))
def summary_events(spark, sf):
    return WR.summary_events(scrub_columns(leaks(spark, sf).select("id", "text", "host"), "text", _GDPR))


@query(
    "sink_union_csv",
    f"SELECT CAST(id AS VARCHAR) AS id, nullif(text, '') AS text, host, CAST(NULL AS VARCHAR) AS kind FROM ({O.texts('id, text, host', src=LEAKS_SQL)})"
    f" UNION ALL SELECT CAST(id AS VARCHAR), text, CAST(NULL AS VARCHAR), host FROM ({O.texts('id, text, host', src=EVENTS_SQL)})",
)
def sink_union_csv(spark, sf):
    a = scrub_columns(leaks(spark, sf).select("id", "text", "host"), "text", report=False)
    b = scrub_columns(
        event_lines(RD.spread(table(spark, sf, "events"))).select("id", "text", F.col("host").alias("kind")), "text", report=False
    )
    path = new_path(spark, "union-csv")
    WR.write_csv(WR.union_rows(a, b), path)
    return RD.read_csv(spark, path)


# -- streams ------------------------------------------------------------------------------------------


def _event_stream(spark: SparkSession, sf: str) -> DataFrame:
    schema = table(spark, sf, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return event_lines(raw)


_STREAM_SQL = O.reported("SELECT id, text, text_findings, text_finding_count FROM report", src=EVENTS_SQL, names=_GDPR_NAMES)


@query("stream_scrub", _STREAM_SQL)
def stream_scrub(spark, sf):
    path = new_path(spark, "stream")
    scrubbed = ST.scrub_stream(_event_stream(spark, sf), "text", _GDPR)
    ST.run(
        scrubbed.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", new_path(spark, "stream-state"))
        .trigger(availableNow=True)
    )
    return spark.read.parquet(path).select("id", "text", "text_findings", "text_finding_count")


@query(
    "stream_summary",
    O.reported(f"SELECT {_EVENT_SQL.replace(' AS event', ' AS value')} FROM report", src=EVENTS_SQL, names=_GDPR_NAMES),
)
def stream_summary(spark, sf):
    path = new_path(spark, "summary")
    events = _event_stream(spark, sf).select("id", "text", "host")
    ST.run(ST.summary_stream(events, "text", _GDPR, path, new_path(spark, "summary-state")))
    return spark.read.text(path).select("value")


@query("stream_tokens", O.texts(src=EVENTS_SQL, style="token", scope=""))
def stream_tokens(spark, sf):
    path = new_path(spark, "stream-tokens")
    events = _event_stream(spark, sf).select("id", "text")
    ST.run(ST.token_stream(events, "id", "text", _TOKEN, path, new_path(spark, "stream-tokens-state")))
    return spark.read.option("basePath", f"{path}/rows").parquet(f"{path}/rows/batch=*").select("id", "text")


_ALLOWED_USERS = "SELECT 'user' || cast(user_id as string) || '@example.com' AS value FROM events WHERE user_id % 3 = 0"
_ALLOWED_USERS_SQL = f"original IN ({_ALLOWED_USERS.replace('string', 'varchar')})"


def _allowed_users(spark: SparkSession, sf: str) -> DataFrame:
    users = table(spark, sf, "events").where("user_id % 3 = 0")
    return users.select(F.expr("'user' || cast(user_id as string) || '@example.com'").alias("value"))


@query("stream_allowlist", O.texts(src=EVENTS_SQL, drop=_ALLOWED_USERS_SQL))
def stream_allowlist(spark, sf):
    """A table of allowed values on a stream: held by the workers, looked up row by row."""
    path = new_path(spark, "stream-allow")
    events = _event_stream(spark, sf).select("id", "text")
    scrubbed = ST.scrub_stream(events, "text", Policy(), report=False, allow=_allowed_users(spark, sf))
    ST.run(
        scrubbed.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", new_path(spark, "stream-state"))
        .trigger(availableNow=True)
    )
    return spark.read.schema(scrubbed.schema).parquet(path).select("id", "text")


@query("stream_allowlist_batches", O.texts(src=EVENTS_SQL, drop=_ALLOWED_USERS_SQL))
def stream_allowlist_batches(spark, sf):
    """The same with a table of any size, joined batch by batch."""
    path = new_path(spark, "stream-allow")
    events = _event_stream(spark, sf).select("id", "text")
    state = new_path(spark, "stream-state")
    ST.run(ST.allowed_stream(events, "id", "text", lambda: _allowed_users(spark, sf), Policy(), path, state))
    return spark.read.option("basePath", path).parquet(f"{path}/batch=*").select("id", "text")


@query("json_schema_data_keys", O.texts("id, text AS value", src=LEAKS_SQL))
def json_schema_data_keys(spark, sf):
    """Documents that use their id as a key: one map column, scrubbed as typed JSON."""
    rows = leaks(spark, sf).select("id", F.to_json(F.create_map(F.lit("by_id"), F.create_map(F.concat(F.lit("k"), "id"), "text")), {"ignoreNullFields": "false"}).alias("doc"))
    ddl = RD.json_schema_of(rows, "doc", most_keys=100)
    typed = rows.select("id", F.from_json("doc", ddl).alias("doc"))
    done = scrub_nested_columns(typed, ["doc"])
    return done.select("id", F.element_at("doc.by_id", F.concat(F.lit("k"), "id")).alias("value"))


@query("stream_tokens_batches", O.texts(src=EVENTS_SQL, style="token", scope=""))
def stream_tokens_batches(spark, sf):
    """Five batches that carry one map along, merged on the way; files come in order of the ids."""
    path, src = new_path(spark, "stream-batches"), new_path(spark, "stream-source")
    rows = event_lines(table(spark, sf, "events")).select("id", "text")
    # any bounds will do, so those of a sketch: exact ones need all ids in one task
    bounds = rows.agg(F.percentile_approx("id", [i / 5 for i in range(1, 5)])).first()[0]
    edges = [None, *(bounds or [None] * 4), None]
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        above = F.lit(True) if low is None else F.col("id") > low
        part = rows.where(above if high is None else above & (F.col("id") <= high))
        part.coalesce(1).write.mode("append").parquet(src)
    events = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(src)
    ST.run(ST.token_stream(events, "id", "text", _TOKEN, path, new_path(spark, "stream-state"), merge_after=2))
    return spark.read.option("basePath", f"{path}/rows").parquet(f"{path}/rows/batch=*").select("id", "text")


# -- ids, keys and sources that are not well-behaved ------------------------------------------------

_NO_NUMBER = r"'-[0-9]{3,}\]', ']'"


def _unnumbered(df: DataFrame) -> DataFrame:
    """Tokens without their numbers: rows of one id have no order among themselves."""
    return df.select("id", F.expr(f"regexp_replace(text, r{_NO_NUMBER})").alias("text"))


_UNNUMBERED_SQL = f"SELECT id, regexp_replace(text, {_NO_NUMBER}, 'g') AS text FROM ({O.texts(src=LEAKS_SQL, style='token', scope='')})"


@query("tokens_null_id", _UNNUMBERED_SQL)
def tokens_null_id(spark, sf):
    rows = leaks(spark, sf).withColumn("key", F.when(F.col("id") % 5 != 0, F.col("id")))
    return _unnumbered(TK.tokenize(rows, "key", "text", _TOKEN).rows)


@query("tokens_duplicate_id", _UNNUMBERED_SQL)
def tokens_duplicate_id(spark, sf):
    rows = leaks(spark, sf).withColumn("key", F.col("id") % 100)
    return _unnumbered(TK.tokenize(rows, "key", "text", _TOKEN).rows)


@query("allowlist_null_id", O.texts(src=LEAKS_SQL, drop=_ALLOW_TABLE_SQL))
def allowlist_null_id(spark, sf):
    rows = leaks(spark, sf).withColumn("key", F.when(F.col("id") % 5 != 0, F.col("id") % 100))
    return exclude_allowed(rows, "key", "text", _allow_table(spark, sf))[0].select("id", "text")


@query(
    "allowlist_join_python_mask",
    O.texts(src=LEAKS_SQL, drop=_ALLOW_TABLE_SQL, extra=[(*_EMP[:4], "lower(reverse(original))")]),
)
def allowlist_join_python_mask(spark, sf):
    own = custom_pattern("employee_id", r"EMP-\d{6}", "pii", py_mask=lambda s: s[::-1].lower())
    rows, _ = exclude_allowed(leaks(spark, sf), "id", "text", _allow_table(spark, sf), Policy(extra_patterns=(own,)))
    return rows.select("id", "text")


_scrub_query(
    "custom_backreference",
    Policy(extra_patterns=(custom_pattern("double_letter", r"([a-z])\1", confidence=0.9),)),
    leaks,
    LEAKS_SQL,
    extra=[("double_letter", "custom", 0.9, "|".join(2 * chr(c) for c in range(ord("a"), ord("z") + 1)), "'****'")],
)


@query(
    "tokens_nested",
    f"SELECT a.doc AS id, a.text AS msg, b.text AS note FROM ({_TOKEN_PAIR}) a "
    f"JOIN ({_TOKEN_PAIR}) b ON a.doc = b.doc WHERE a.field_at = 0 AND b.field_at = 1",
)
def tokens_nested(spark, sf):
    """One numbering over a struct and the lists and maps in it."""
    v = F.struct(F.col("text").alias("msg"), F.array(F.create_map(F.lit("k"), F.col("note"))).alias("l"))
    rows = noted(leaks(spark, sf)).select("id", v.alias("v"))
    out = scrub_nested_columns(rows, ["v"], _TOKEN)
    return out.select("id", F.col("v.msg").alias("msg"), F.col("v.l").getItem(0)["k"].alias("note"))


_TWICE = (
    "'{{\"m\": \"' || replace({text}, '\"', chr(92) || '\"') || '\", \"m\" : \"' || {note} || '\", \"n\": NaN}}'"
)


@query("json_duplicate_keys", f"SELECT a.id, {_TWICE.format(text='a.text', note='b.text')} AS doc {_BOTH}")
def json_duplicate_keys(spark, sf):
    docs = noted(leaks(spark, sf)).select("id", F.expr(_TWICE.format(text="text", note="note")).alias("doc"))
    return D.scrub_json_column(docs, "doc").select("id", "doc")


@query("json_schema_odd_keys", O.texts(src=LEAKS_SQL))
def json_schema_odd_keys(spark, sf):
    doc = F.to_json(F.struct(F.col("text").alias("VOIDED_BY"), F.lit(1).alias("OBJECT<x")))
    docs = leaks(spark, sf).select("id", doc.alias("doc"))
    typed = docs.select("id", F.from_json("doc", RD.json_schema_of(docs, "doc")).alias("v"))
    return scrub_nested_columns(typed, ["v"]).select("id", F.col("v.VOIDED_BY").alias("text"))


@query("allowlist_lookup", O.texts(src=LEAKS_SQL, drop=_ALLOW_TABLE_SQL))
def allowlist_lookup(spark, sf):
    """The allowlist as a lookup file."""
    path = new_path(spark, "lookup")
    WR.write_csv(_allow_table(spark, sf).select(F.lit("x").alias("note"), "value"), path)
    rows, _ = exclude_allowed(leaks(spark, sf), "id", "text", RD.read_allowlist(spark, path))
    return rows.select("id", "text")


@query("standards_lookup", f"{O.kept(src=LEAKS_SQL)}\n{_REFERENCE}")
def standards_lookup(spark, sf):
    """Standard definitions from a stored table of lists."""
    path = new_path(spark, "standards")
    lists = PO.standards_frame(spark).groupBy("standard").agg(F.array_join(F.collect_list("pattern"), " , ").alias("patterns"))
    WR.write_csv(lists, path)
    stored = RD.standards_table(RD.read_csv(spark, path))
    counts = findings(leaks(spark, sf), "id", "text").groupBy("pattern").agg(F.count("*").alias("n"))
    return PO.patterns_of(catalog_frame(spark), stored, "HIPAA").join(counts, "pattern", "left").select(
        "pattern", "category", "confidence", F.coalesce("n", F.lit(0)).alias("findings")
    )


@query("category_counts", O.rows("id, category, CAST(count(*) AS INTEGER) AS n", src=LEAKS_SQL) + " GROUP BY id, category")
def category_counts(spark, sf):
    """Count by category within each value."""
    done = leaks(spark, sf).select("id", F.explode(S.summary_by_category(S.scrub(F.col("text"), Policy())["findings"])))
    return done.select("id", F.col("key").alias("category"), F.col("value").alias("n"))


@query("long_values", O.texts("id, text", src=DOCUMENTS_SQL))
def long_values(spark, sf):
    """Documents scrubbed in chunks, each by its own task, and put together again."""
    docs = documents(spark, sf).select("id", "text")
    done = LV.scrub_chunks(LV.cut(docs, "text", 16_384), "id", halo=2_048).chunks
    parts = done.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("chunk", "text"))).alias("parts"))
    return parts.select("id", F.when(F.get("parts", F.lit(0))["text"].isNotNull(), F.array_join("parts.text", "")).alias("text"))


@query("long_findings", O.rows("id, pattern, original, masked, CAST(start_at AS BIGINT) AS start", src=DOCUMENTS_SQL))
def long_findings(spark, sf):
    docs = documents(spark, sf).select("id", "text")
    found = LV.scrub_chunks(LV.cut(docs, "text", 16_384), "id", halo=2_048).findings
    return found.select("id", "pattern", "original", "masked", F.col("start").cast("long").alias("start"))


@query("long_files", O.texts("coalesce(text, '') AS value", src=LEAKS_SQL))
def long_files(spark, sf):
    """Files without a limit on their size, line by line in chunks."""
    path = new_path(spark, "long")
    leaks(spark, sf).select("text").write.text(path)
    chunks = RD.read_long_text(spark, path, 200_000)
    done = LV.scrub_chunks(chunks, "source").chunks
    return done.select(F.explode(F.split(F.expr("left(text, length(text) - 1)"), "\n")).alias("value"))


@query(
    "text_files",
    f"SELECT d.id, CAST(coalesce(f.n, 0) AS INTEGER) AS n FROM ({DOCUMENTS_SQL}) d LEFT JOIN ({O.rows('id, count(*) AS n', src=DOCUMENTS_SQL)} GROUP BY id) f ON f.id = d.id",
)
def text_files(spark, sf):
    """Documents as single text files, each read as one value."""
    path = new_path(spark, "files")
    WR.write_folders(documents(spark, sf), "id", "text", path)
    one = RD.read_text_file(spark, path, "text", recursive=True)
    done = D.scrub_files(one)
    return done.select(F.regexp_extract("source", r"id=(\d+)/", 1).cast("long").alias("id"), F.size("findings").alias("n"))


@query(
    "tree_errors",
    f"SELECT count(*) - 1 AS files, CAST(coalesce(sum(n), 0) AS BIGINT) AS findings, CAST(1 AS BIGINT) AS errors FROM (SELECT d.id, CASE WHEN d.id = least_id THEN 0 ELSE coalesce(f.n, 0) END AS n FROM ({DOCUMENTS_SQL}) d CROSS JOIN (SELECT min(doc_id) AS least_id FROM documents) LEFT JOIN ({O.rows('id, count(*) AS n', src=DOCUMENTS_SQL)} GROUP BY id) f ON f.id = d.id)",
)
def tree_errors(spark, sf):
    """One file of a folder is gone when it is its turn; the others are scrubbed, and it is counted."""
    path = new_path(spark, "tree")
    WR.write_folders(documents(spark, sf), "id", "text", path)
    listing = kept(RD.list_tree(spark, path))
    files = RD.read_tree(spark, path, unreadable="skip")
    gone = listing.orderBy(F.regexp_extract("rel_path", r"id=(\d+)/", 1).cast("long")).first()["source"]
    delete(spark, gone)
    done = D.scrub_files(files)
    return A.batch_totals(done, F.size("findings").cast("long"), listing=listing)


@query(
    "tree_source_totals",
    f"SELECT d.id, CAST(coalesce(f.n, 0) AS INTEGER) AS n FROM documents_of d LEFT JOIN ({O.rows('id, count(*) AS n', src=DOCUMENTS_SQL)} GROUP BY id) f ON f.id = d.id".replace(
        "documents_of", f"({DOCUMENTS_SQL})"
    ),
)
def tree_source_totals(spark, sf):
    """Documents as files of a folder tree, read back and counted file by file."""
    path = new_path(spark, "tree")
    WR.write_folders(documents(spark, sf), "id", "text", path)
    files = D.scrub_files(RD.read_tree(spark, path))
    return files.select(F.regexp_extract("rel_path", r"id=(\d+)/", 1).cast("long").alias("id"), F.size("findings").alias("n"))
