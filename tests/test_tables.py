"""Operators that work over span tables: tokens and allowlist tables."""

import os
import random

import pytest
from brute import resolve
from corpus import lines
from pyspark.sql import functions as F

from maskwell.operators import tokens as TK
from maskwell.operators.allow import exclude_allowed
from maskwell.operators.span_tables import measured, scan, span_rows, splice
from maskwell.plans import scratch
from maskwell.plans.policy import Policy

VALUES = [
    f"{v} ip 10.0.0.{i % 5} common@x.com {'mail%d@y.org' % (i % 37)}" if i % 3 else v
    for i, v in enumerate(lines(240, seed=21))
] + [None, ""]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, i % 4 if i % 3 else 0, v, v and v[::-1]) for i, v in enumerate(VALUES)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "id int, doc int, t string, u string").repartition(5)


@pytest.mark.parametrize("split_rows", [0, 10**6])
@pytest.mark.parametrize("scope", [[], ["doc"]])
def test_token_scopes(docs, scope, split_rows):
    ids = ["doc", "id"]
    got = TK.tokenize(docs, ids, "t,u", order=ids, scope=scope, split_rows=split_rows)
    maps = {}
    rows = sorted(docs.collect(), key=lambda r: (r.doc, r.id))
    expect, n = {}, 0
    for r in rows:
        m = maps.setdefault(r.doc if scope else None, {})
        pair = [resolve(v, style="token", tokens=m) for v in (r.t, r.u)]
        expect[r.id] = tuple(p[0] for p in pair)
        n += sum(len(p[1]) for p in pair)
    assert {r.id: (r.t, r.u) for r in got.rows.collect()} == expect
    assert got.findings.count() == n
    key = [*scope, "original"]
    made = {tuple(r[k] for k in key): r.token for r in got.tokens.collect()}
    assert made == {((k,) if scope else ()) + (o,): t for k, m in maps.items() for o, t in m.items()}


def test_token_map_continues(spark, docs):
    known = {"common@x.com": "[PII-041]", "other": "odd", "10.0.0.1": "[NETWORK-007]"}
    stored = spark.createDataFrame(list(known.items()), TK.TOKEN_DDL)
    got = TK.tokenize(docs, "id", "t", known=stored)
    expect = {i: resolve(v, style="token", tokens=known)[0] for i, v in enumerate(VALUES)}
    assert {r.id: r.t for r in got.rows.collect()} == expect
    assert {r.original: r.token for r in got.tokens.collect()}.items() <= known.items()


def test_detokenize(spark, docs):
    got = TK.tokenize(docs, "id", "t")
    back = TK.detokenize(got.rows, "id", "t", got.tokens)
    assert {r.id: r.t for r in back.collect()} == dict(enumerate(VALUES))
    odd = spark.createDataFrame([(1, "x [PII-999] [a] [b-12] y")], "id int, t string")
    assert TK.detokenize(odd, "id", "t", got.tokens).first().t == "x [PII-999] [a] [b-12] y"


def test_numbers_beyond_three_digits(spark):
    df = spark.range(2500).select("id", F.format_string("u%04d@x.com", "id").alias("t"))
    got = {r.id: r.t for r in TK.tokenize(df, "id", "t").rows.collect()}
    assert got == {i: f"[PII-{i + 1:03d}]" for i in range(2500)}


@pytest.mark.parametrize("ignore_case", [False, True])
def test_allowlist_table(spark, docs, ignore_case):
    allow = ["common@x.com", "10.0.0.1", "MAIL3@y.org", " postgres://u:p@ ", "", "4111111111111111"]
    table = spark.createDataFrame([(a,) for a in allow], "value string")
    rows, found = exclude_allowed(docs, "id", "t", table, Policy(), ignore_case)
    plain = {a.strip() for a in allow if a.strip()}
    if ignore_case:
        seen = {f[3] for v in VALUES for f in all_candidates(v)}
        plain = {o for o in seen if o.lower() in {p.lower() for p in plain}}
    expect = {i: resolve(v, allow=plain) for i, v in enumerate(VALUES)}
    assert {r.id: r.t for r in rows.collect()} == {i: e[0] for i, e in expect.items()}
    got = sorted((r.id, r.seq, r.pattern, r.masked, r.start) for r in found.collect())
    want = sorted((i, n, f[0], f[4], f[5]) for i, e in expect.items() for n, f in enumerate(e[1]))
    assert got == want


def all_candidates(value):
    import re

    from brute import PATTERNS

    return [(n, c, f, m.group()) for n, c, f, rx in PATTERNS for m in re.finditer(rx, value or "")]


def test_null_id_is_masked(spark):
    from maskwell.operators.tokens import tokenize
    from maskwell.plans.policy import Policy

    rows = spark.createDataFrame([(1, "mail a@b.co"), (None, "mail c@d.co")], "id int, text string")
    out = {r["id"]: r["text"] for r in tokenize(rows, "id", "text", Policy()).rows.collect()}
    assert "@" not in out[1] and "@" not in out[None] and out[1] != out[None]


def test_large_allowlist(spark):
    from maskwell.operators.scrub import scrub_columns
    from maskwell.plans.policy import Policy

    policy = Policy(allowlist=frozenset(f"u{i}@b.co" for i in range(10_500)))
    rows = spark.createDataFrame([("u7@b.co x@b.co",)], "text string")
    text = scrub_columns(rows, "text", policy).first()["text"]
    assert text.startswith("u7@b.co ") and "x@b.co" not in text


def test_null_scope_is_a_scope(spark):
    rows = spark.createDataFrame([(None, 1, "mail a@b.co"), (None, 2, "mail c@d.co a@b.co"), (1, 3, "c@d.co")], "doc int, id int, t string")
    for split_rows in (0, 10**6):
        got = TK.tokenize(rows, ["doc", "id"], "t", scope=["doc"], split_rows=split_rows)
        assert {r.id: r.t for r in got.rows.collect()} == {1: "mail [PII-001]", 2: "mail [PII-002] [PII-001]", 3: "[PII-001]"}
        back = TK.detokenize(got.rows, ["doc", "id"], "t", got.tokens, scope=["doc"])
        assert {r.id: r.t for r in back.collect()} == {r.id: r.t for r in rows.collect()}
    with pytest.raises(Exception, match="several originals"):
        TK.detokenize(got.rows, ["doc", "id"], "t", got.tokens).collect()


def test_allowlist_table_with_python_mask(spark):
    from maskwell.functions.catalog import custom_pattern

    own = custom_pattern("employee_id", r"EMP-\d{6}", "pii", py_mask=lambda s: s[::-1].lower())
    df = spark.createDataFrame([(1, "id EMP-123456 and mail a@b.co, ok@b.co end")], "id int, t string")
    allow = spark.createDataFrame([("ok@b.co",)], "value string")
    rows, _ = exclude_allowed(df, "id", "t", allow, Policy(extra_patterns=(own,)))
    assert rows.first().t == "id 654321-pme and mail a***@b.co, ok@b.co end"


def test_ids_may_repeat_or_change(spark):
    texts = ["hello a@b.co", "mail a@b.co c@d.co", None, "mail a@b.co c@d.co", "plain"]
    df = spark.createDataFrame([(1, t) for t in texts], "id int, t string")
    got = TK.tokenize(df, "id", "t")
    made = {r.original: r.token for r in got.tokens.collect()}
    expect = sorted((t or "").replace("a@b.co", made["a@b.co"]).replace("c@d.co", made["c@d.co"]) for t in texts)
    assert sorted(r.t or "" for r in got.rows.collect()) == expect
    allow = spark.createDataFrame([("a@b.co",)], "value string")
    rows, _ = exclude_allowed(df, "id", "t", allow)
    assert sorted(r.t or "" for r in rows.collect()) == sorted((t or "").replace("c@d.co", "c***@d.co") for t in texts)
    moving = df.withColumn("id", F.monotonically_increasing_id() + (F.rand() * 1000).cast("long"))
    assert all("@" not in (r.t or "") for r in TK.tokenize(moving, "id", "t").rows.collect())


def test_input_is_read_once(spark):
    moving = spark.range(40).select("id", F.concat(F.lit("mail u"), (F.rand() * 10**9).cast("long").cast("string"), F.lit("@b.co end")).alias("t"))
    got = TK.tokenize(moving, "id", "t")
    assert all(r.t.startswith("mail [PII-") and r.t.endswith("] end") for r in got.rows.collect())
    back = {r.id: r.t for r in TK.detokenize(got.rows, "id", "t", got.tokens).collect()}
    assert {r.id: r.original for r in got.findings.collect()} == {i: t[5:-4] for i, t in back.items()}


def test_columns_of_any_type_and_name(spark):
    odd = spark.sql(
        "SELECT id, if(id % 2 = 0, concat('u', id, '@b.co'), 'plain') AS `my text`, 7 AS n, NULL AS nothing, array(struct(1 AS a, NULL AS b)) AS `_spans`, "
        "make_interval(0, 0, 0, CAST(id AS int)) AS gap, map('k', id) AS c0, 10.0 AS `a.b` FROM range(6)"
    )
    got = TK.tokenize(odd, "id", "my text,n").rows
    assert got.columns == odd.columns
    assert {r["id"]: r["my text"] for r in got.drop("gap").collect()} == {i: "plain" if i % 2 else f"[PII-{i // 2 + 1:03d}]" for i in range(6)}
    keep = got.drop("gap", "my text")
    assert sorted(map(repr, keep.collect())) == sorted(map(repr, odd.withColumn("n", F.lit("7")).drop("gap", "my text").collect()))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("small", [True, False])
def test_untouched_rows_meet_nothing(spark, monkeypatch, small):
    """Beyond the broadcast bounds only rows with findings are exchanged, one by one."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    if not small:
        monkeypatch.setattr(scratch, "BROADCAST_ROWS", 0)
    lines = ["the same hot line"] * 300 + [None] * 300 + [f"mail u{i}@b.co" for i in range(20)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "id int, t string")
    allow = spark.createDataFrame([("u3@b.co",)], "value string")
    for rows in (TK.tokenize(df, "id", "t").rows, exclude_allowed(df, "id", "t", allow)[0]):
        assert rows.count() == len(lines)
    routed = scan(df, ["t"], Policy())
    assert "Exchange" not in plan(routed.untouched) and routed.untouched.count() == 600
    assert routed.hits.count() == 20 and routed.hits.select("_row").distinct().count() == 20
    done = splice(routed, ["t"], span_rows(routed, {}, ["t"], Policy()).select("_row", "field_at", "b0", "b1", F.lit("x").alias("masked")), measured(routed.hits, 1))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before if small else -1)
    try:
        tree = done._jdf.queryExecution().executedPlan().toString().split("Union", 1)[1]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # the first branch of the union holds the rows that were left alone
    alone, hit = ("\n".join(x for x in tree.splitlines() if x.startswith("   :") == first) for first in (True, False))
    assert "Scan" in alone and "Join" not in alone and "Exchange" not in alone
    assert ("BroadcastHashJoin" in hit) == small and ("SortMergeJoin" in hit) == (not small)
    assert {r.t for r in done.collect()} == {"the same hot line", None, "mail x"}


def test_numbering_within_scopes_exchanges_rows_once(spark):
    doc = F.when(F.col("id") % 2 == 0, 3).otherwise(F.col("id") % 7)
    df = spark.range(5000).select(doc.alias("doc"), (F.lit(10_000) - F.col("id")).alias("o"))
    seen = []
    real = scratch.kept
    try:
        scratch.kept = lambda d, by=None: seen.append(plan(d)) or real(d, by)
        got = TK.number_rows(df, ["o"], ["doc"])
    finally:
        scratch.kept = real
    assert [p.count("Exchange rangepartitioning") + p.count("Exchange hashpartitioning") for p in seen] == [1]
    final = got._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in final and "SortMergeJoin" not in final
    n = {}
    for r in sorted(got.collect(), key=lambda r: (r.doc, r.o)):
        n[r.doc] = n.get(r.doc, 0) + 1
        assert r.n == n[r.doc]


@pytest.mark.parametrize("parts", [1, 13])
def test_numbers_in_scopes_of_all_sizes(spark, parts):
    rng = random.Random(parts)
    rows = [(rng.choice([None, "hot", "hot", "hot", *"abcdefgh"]), rng.choice([None, 1.0, float("nan")]), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "a string, b double, o int")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = TK.number_rows(df, ["o"], ["b", "a"]).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    n = {}
    for r in sorted(got, key=lambda r: r.o):
        key = (r.a, repr(r.b))
        n[key] = n.get(key, 0) + 1
        assert r.n == n[key]


def files_below(path):
    return [f for _, _, names in os.walk(path) for f in names]


def test_owned_storage_is_deleted(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setattr(scratch, "checkpoint_dir", lambda spark: str(tmp_path))
    with scratch.owned(spark):
        got = TK.tokenize(docs, ["doc", "id"], "t", scope=["doc"])
        assert got.rows.count() == len(VALUES) and files_below(tmp_path)
        allow = spark.createDataFrame([("common@x.com",)], "value string")
        exclude_allowed(docs, "id", "t", allow)[1].count()
    assert files_below(tmp_path) == []
    with pytest.raises(ZeroDivisionError), scratch.owned(spark):
        scratch.kept(docs)
        1 / 0  # noqa: B018
    assert files_below(tmp_path) == []
    scratch.kept(docs)
    assert files_below(tmp_path)
