"""Values in chunks against the same values as a whole."""

import os

import pytest
from pyspark.sql import functions as F

from maskwell.functions.catalog import custom_pattern
from maskwell.operators import long_values as LV
from maskwell.operators.scrub import findings, scrub_columns
from maskwell.plans.policy import Policy
from maskwell.sources import readers as RD

COLUMNS = ["id", "pattern", "category", "confidence", "original", "masked", "start", "end"]


def whole(df, policy):
    texts = {r.id: r.text for r in scrub_columns(df, "text", policy, report=False).collect()}
    return texts, sorted(tuple(r[c] for c in COLUMNS) for r in findings(df, "id", "text", policy).select(COLUMNS).collect())


def in_chunks(df, policy, size, halo):
    got = LV.scrub_chunks(LV.cut(df, "text", size), "id", policy, halo)
    texts = {}
    for r in sorted(got.chunks.collect(), key=lambda r: (r.id, r.chunk)):
        texts[r.id] = None if r.text is None else texts.get(r.id, "") + r.text
    return texts, sorted(tuple(r[c] for c in COLUMNS) for r in got.findings.collect())


@pytest.mark.parametrize("style", ["partial", "token"])
def test_all_documents_in_chunks(spark, sf_dir, style):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    policy = Policy(mask_style=style)
    assert in_chunks(docs, policy, 1000, 250) == whole(docs, policy)


@pytest.mark.parametrize("size", [37, 60])
def test_matches_on_borders(spark, size):
    """Chunks so short that most matches lie on a border, with overlaps and characters of several bytes."""
    line = "é mail u%d@b.co Bearer eyJabcdefgh.abcdefgh.abcdefgh postgres://u:p@10.0.0.%d 😀 4111 1111 1111 1111 10.1.2.%d, "
    rows = [(i, "x" * i + "".join(line % (i, k, k) for k in range(6))) for i in range(12)] + [(100, None), (101, ""), (102, "plain")]
    df = spark.createDataFrame(rows, "id int, text string")
    policy = Policy(mask_style="label", allowlist=frozenset({"10.1.2.3"}))
    assert in_chunks(df, policy, size, 12) == whole(df, policy)


def test_chains_of_matches_and_spans(spark):
    """Matches that follow each other without a gap, out of step with the chunks; spans that block each other."""
    three = custom_pattern("three", "[ab]{3}")
    five = custom_pattern("five", "b[ab]{4}", confidence=0.5)
    rows = [(i, (("ab" * 20 + "b" * i + " ") * 4 + "aab" * 12 + " ")[i:] * 3) for i in range(5)]
    df = spark.createDataFrame(rows, "id int, text string")
    policy = Policy(categories=frozenset(), extra_patterns=(three, five), mask_style="full")
    assert in_chunks(df, policy, 64, 16) == whole(df, policy)
    with pytest.raises(ValueError, match="longer than two chunks"):
        run = custom_pattern("run", "[ab]+")
        LV.scrub_chunks(LV.cut(df, "text", 10), "id", Policy(categories=frozenset(), extra_patterns=(run,)), 16)


def test_long_files(spark, tmp_path):
    text = "".join(f"line {i} é u{i % 40}@b.co\r\n" + ("\n" if i % 7 == 0 else "") for i in range(4000)) + "end 10.0.0.1"
    path = str(tmp_path / "big.log")
    with open(path, "wb") as f:
        f.write(text.encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 20_000)
    try:
        chunks = RD.read_long_text(spark, path, 3000)
        pieces = chunks.orderBy("chunk").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    plain = text.replace("\r\n", "\n") + "\n"
    assert "".join(r.text for r in pieces) == plain and [r.chunk for r in pieces] == list(range(len(pieces))) and len(pieces) > 20
    got = LV.scrub_chunks(chunks, "source", Policy(mask_style="token"), 400)
    one = spark.createDataFrame([(1, plain)], "id int, text string")
    texts, found = whole(one, Policy(mask_style="token"))
    assert "".join(r.text for r in got.chunks.orderBy("chunk").collect()) == texts[1]
    assert got.findings.count() == len(found)
    assert os.path.getsize(path) == len(text.encode())


def test_lengths_are_not_taken_for_each_candidate(spark, monkeypatch):
    """The length of a text is found by walking it, so it has no place in a test of each candidate."""
    seen = []
    monkeypatch.setattr(LV.scratch, "kept", lambda df, *_: seen.append(df) or df)
    LV._candidates(spark.createDataFrame([(1, 0, "a@b.co")], "id int, chunk int, text string"), ["id"], Policy(), 16, 4)
    plan = seen[-1]._jdf.queryExecution().optimizedPlan().toString()
    torn = plan[plan.index("exists(") : plan.index("AS _torn")]
    assert "length(" not in torn
