"""Text columns derived from the given tables, one formula for both engines.

Most patterns occur in no table, so rows of ``orders`` and ``events`` are
turned into log lines.  ``{k}`` is the key, ``{h}`` its SHA-256 in hex.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwell.sources.readers import spread


def _pad(expr: str, n: int) -> str:
    return f"lpad(cast({expr} as string), {n}, '0')"


def _cut(start: int, n: int | str) -> str:
    return f"substr({{h}}, {start}, {n})"


_CARDS = (
    "4111-1111-1111-1111",
    "4111 1111 1111 1111",
    "4111111111111111",
    "3782-822463-10005",
    "378282246310005",
    "4111-1111-1111-1112",
    "5500 0000 0000 0004",
)
_CARD = "CASE {k} % 7 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(_CARDS)) + " END"
_MAC = " || (CASE WHEN {k} % 2 = 0 THEN ':' ELSE '-' END) || ".join(
    _cut(1 + 2 * i, 2) for i in range(6)
)
_JWT = f"'eyJ' || {_cut(1, 20)} || '.' || {_cut(21, 20)} || '.' || {_cut(41, 20)}"

_KINDS = (
    f"'user ssn ' || {_pad('{k} % 1000', 3)} || '-12-' || {_pad('{k} % 10000', 4)} || ' on file'",
    f"'passport A' || {_pad('{k} % 100000000', 8)} || ' verified'",
    f"'session ' || {_JWT}",
    f"'Authorization: Bearer ' || {_cut(1, 30)}",
    f"'Bearer ' || {_cut(1, '1 + {k} % 3')} || ' rejected'",
    f"'key=sk-' || {_cut(1, 40)}",
    f"'model key sk-ant-' || {_cut(1, 30)}",
    f"'hook ghp_' || {_cut(1, 36)} || ' ok'",
    f"'access AKIA' || upper({_cut(1, 16)}) || ' used'",
    f"'api_key=\"' || {_cut(1, 30)} || '\"'",
    f"'bot xoxb-' || {_cut(1, 30)}",
    f"'charge sk_live_' || {_cut(1, 30)}",
    f"'maps AIzaSy' || {_cut(1, 33)}",
    f"'mail SG.' || {_cut(1, 12)} || '.' || {_cut(13, 12)}",
    f"'IBAN GB29NWBK' || {_pad('{k}', 14)} || ' or AB12CDEF'",
    f"'paid with ' || {_CARD}",
    "'open postgres://u' || cast({k} as string) || ':pw@db.internal:5432/app'",
    f"'mac ' || {_MAC}",
    "'open postgres://u:p@10.0.0.' || cast({k} % 256 as string)",
    f"'Bearer ' || {_JWT}",
    f"'api_key=sk-ant-' || {_cut(1, 30)}",
    "'mail user' || cast({k} % 97 as string) || '@example.com, ops@example.com from 192.168.'"
    " || cast({k} % 256 as string) || '.' || cast({k} % 251 as string)",
    f"'call (212) 555-' || {_pad('{k} % 10000', 4)} || ' or +1 212-555-0100'",
    "'nothing to see in order ' || cast({k} as string) || ' of EMP-' || " + _pad("{k} % 1000000", 6),
    "''",
)
LEAK = (
    "CASE {k} % 26 " + " ".join(f"WHEN {i} THEN {kind}" for i, kind in enumerate(_KINDS)) + " END"
)
EVENT = (
    "'login user' || cast(user_id as string) || '@example.com as ' || event_type || ' from 10.'"
    " || cast(event_id % 200 as string) || '.0.' || cast(user_id % 250 as string)"
)


def _spark(expr: str, key: str) -> str:
    return expr.replace("{h}", f"sha2(cast({key} as string), 256)").replace("{k}", key)


def _duck(expr: str, key: str) -> str:
    return expr.replace("{h}", f"sha256(cast({key} as varchar))").replace("{k}", key)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, text, ts, host, sourcetype`` from orders."""
    return spread(table(spark, sf_dir, "orders")).select(
        F.col("o_orderkey").alias("id"),
        F.expr(_spark(LEAK, "o_orderkey")).alias("text"),
        F.col("o_orderdate").alias("ts"),
        F.col("o_orderpriority").alias("host"),
        F.col("o_orderstatus").alias("sourcetype"),
        F.col("o_custkey").alias("cust"),
    )


LEAKS_SQL = (
    f"SELECT o_orderkey AS id, {_duck(LEAK, 'o_orderkey')} AS text, o_orderdate AS ts, "
    "o_orderpriority AS host, o_orderstatus AS sourcetype, o_custkey AS cust FROM orders"
)


def event_lines(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("event_id").alias("id"), F.expr(EVENT).alias("text"), "ts",
        F.col("event_type").alias("host"),
    )


EVENTS_SQL = f"SELECT event_id AS id, {EVENT} AS text, ts, event_type AS host FROM events"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return spread(docs).withColumnRenamed("doc_id", "id")


DOCUMENTS_SQL = "SELECT doc_id AS id, text, source, lang FROM documents"
