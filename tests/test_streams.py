"""What streams carry along: the token store, and allowlists that workers hold."""

import pytest
from brute import resolve
from corpus import lines
from pyspark.sql import functions as F

from maskwell.functions.catalog import custom_pattern
from maskwell.operators.allow import exclude_allowed, held
from maskwell.operators.scrub import scrub_columns
from maskwell.plans import scratch
from maskwell.plans.policy import Policy
from maskwell.streaming.token_store import TokenStore


def tokens(spark, pairs):
    return spark.createDataFrame([(o, f"[PII-{n:03d}]", n) for o, n in pairs], "original string, token string, n long")


def test_token_store(spark, tmp_path):
    store = TokenStore(spark, str(tmp_path), buckets=16, merge_after=3)
    assert store.last() == 0 and store.table().count() == 0
    expect = {}
    for batch in range(7):
        pairs = [(f"u{batch}-{i}@b.co", 10 * batch + i + 1) for i in range(10)]
        store.merge(batch)
        assert store.last(batch) == 10 * batch and dict(store.table(batch).collect()) == expect
        for _ in range(2):  # a batch that is tried twice
            store.add(tokens(spark, pairs), batch)
        expect |= {o: f"[PII-{n:03d}]" for o, n in pairs}
        assert dict(store.table().collect()) == expect
    assert len(store._numbers("base")) == 1 and len(store._numbers("batch")) < 4
    store.add(tokens(spark, []), 7)
    assert store.last() == 70 and store.last(8) == 70 and dict(store.table().collect()) == expect


def test_only_buckets_of_the_batch_are_read(spark, tmp_path):
    store = TokenStore(spark, str(tmp_path), buckets=16)
    store.add(tokens(spark, [(f"u{i}@b.co", i + 1) for i in range(400)]), 0)
    asked = spark.createDataFrame([("u7@b.co",), ("u8@b.co",), ("new@b.co",)], "original string")
    found = store.lookup(asked, 1)
    buckets = {r[0] for r in asked.select(store.bucket()).distinct().collect()}
    files = {r[0] for r in found.select(F.regexp_extract(F.input_file_name(), "bucket=([0-9]+)", 1).cast("int")).distinct().collect()}
    assert files == buckets and len(buckets) < 4
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert {r.original for r in found.collect()} >= {"u7@b.co", "u8@b.co"}


VALUES = [f"{v} common@x.com 10.0.0.{i % 5} mail{i % 7}@y.org" for i, v in enumerate(lines(120, seed=4))] + [None, ""]
ALLOW = ["common@x.com", "10.0.0.1", " mail3@y.org ", "postgres://u:p@", "", None]


@pytest.mark.parametrize("style", ["partial", "label", "token"])
def test_held_allowlist(spark, style):
    df = spark.createDataFrame([(i, v, v and v[::-1]) for i, v in enumerate(VALUES)], "id int, t string, u string")
    allow = spark.createDataFrame([(a,) for a in ALLOW], "value string")
    policy = Policy(mask_style=style, allowlist=frozenset({"mail5@y.org"}))
    out = scrub_columns(df, "t,u", policy, allow=held(allow)).collect()
    plain = {a.strip() for a in ALLOW if a and a.strip()} | {"mail5@y.org"}
    for r in out:
        t, u = (resolve(v, style=style, allow=plain) for v in (VALUES[r.id], VALUES[r.id] and VALUES[r.id][::-1]))
        assert (r.t, r.u) == (t[0], u[0]) and (r.t_finding_count or 0) == len(t[1])
    rows, _ = exclude_allowed(df, "id", "t", allow, Policy())
    same = scrub_columns(df, "t", Policy(), report=False, allow=held(allow))
    assert {r.id: r.t for r in rows.collect()} == {r.id: r.t for r in same.collect()}


def test_held_allowlist_with_python_mask_and_bounds(spark, monkeypatch):
    own = custom_pattern("employee_id", r"EMP-\d{6}", "pii", py_mask=lambda s: s[::-1].lower())
    df = spark.createDataFrame([("EMP-123456 EMP-000000 a@b.co",)], "t string")
    allow = spark.createDataFrame([("EMP-000000",)], "value string")
    out = scrub_columns(df, "t", Policy(extra_patterns=(own,)), report=False, allow=held(allow))
    assert out.first().t == "654321-pme EMP-000000 a***@b.co"
    monkeypatch.setattr(scratch, "BROADCAST_ROWS", 0)
    with pytest.raises(ValueError, match="too many to hold"):
        held(allow)
    with pytest.raises(ValueError, match="by value"):
        scrub_columns(df, "t", Policy(mask_style="token"), token_scope="row", allow=spark.sparkContext.broadcast(frozenset()))
