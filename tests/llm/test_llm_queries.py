"""The numbered queries: SQL where there is some, and the pipeline's stages on the smallest tables."""

import hashlib
import random

import duckdb
import pytest

import corpus_pipeline
from maskwell.llm import decontamination, jaccard_join, toxicity
from maskwell.llm.queries import ORACLE, QUERIES


def test_each_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", list(ORACLE))
def test_sql(spark, sf_dir, name):
    got = QUERIES[name](spark, sf_dir)
    con = duckdb.connect()
    for t in ("pages", "embeddings", "documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    cursor = con.execute(ORACLE[name])
    at = [[c[0] for c in cursor.description].index(c) for c in got.columns]
    assert sorted(map(repr, (tuple(r[i] for i in at) for r in cursor.fetchall()))) == sorted(repr(tuple(r)) for r in got.collect())


@pytest.mark.parametrize("name", ["op2_source_mix", "op10_url_rules"])
def test_native_queries_run_no_python(spark, sf_dir, name, capsys):
    QUERIES[name](spark, sf_dir).explain()
    assert not any(x in capsys.readouterr().out for x in ("Python", "Pandas", "Arrow"))


def test_suffix_dedup_counts_bytes_not_words(spark, tmp_path):
    rng = random.Random(4)
    words = lambda n: " ".join("".join(rng.choice("abcdeéü") for _ in range(rng.randint(2, 5))) for _ in range(n))
    rows, want = [], []
    for size in (330, 399, 400, 401, 600):
        passage = words(52)
        passage += "x" * (size - len(passage.encode()))
        assert len(passage.split()) > 50 and len(passage.encode()) == size
        for left, right in ("[]", "<>"):
            before, after = words(20) + left, right + words(20)
            text, removed = before + passage + after, size if size >= 400 else 0
            kept = before + after if removed else text
            want.append((len(rows), len(text.encode()), removed, int(removed > 0), hashlib.sha256(kept.encode()).hexdigest()))
            rows.append((len(rows), text))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, QUERIES["op1_suffix_dedup"](spark, str(tmp_path)).collect())) == want


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("labels", "benchmark"))
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    stages = [f for _, f in corpus_pipeline.STAGES]
    one = stages[0](spark, docs, sf_dir)
    assert ids(one) == ids(toxicity.scored(docs, labels).where("predicted = 0"))
    two = stages[1](spark, one, sf_dir)
    assert ids(two) == ids(jaccard_join.join(one, size=5, percent=80).where("doc_id = component_id"))
    three = stages[2](spark, two, sf_dir)
    leaked = {r["doc_id"] for r in decontamination.leaks(two, bench, shortest=1).collect()}
    assert leaked and ids(three) == [i for i in ids(two) if i not in leaked]
    four = stages[3](spark, three, sf_dir)
    assert all(s.columns == docs.columns for s in (one, two, three, four)) and set(ids(four)) <= set(ids(docs))
    last = corpus_pipeline.run(spark, sf_dir)
    assert last.count() and {r["shard"] for r in last.select("shard").distinct().collect()} <= set(range(8))


def test_pipeline_near_copies_share_four_fifths_of_five_words(spark, sf_dir):
    rng = random.Random(6)
    rows = []
    for n in (4, 30, 45, 52, 55, 58, 120, 300):
        base = [f"v{rng.randrange(9000)}" for _ in range(n)]
        for k in range(4):
            w = list(base)
            for _ in range(rng.randrange(k + 1)):
                w[rng.randrange(n)] = f"n{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    fixed = [f"f{i}" for i in range(55)]
    rows += [(900, " ".join(fixed)), (901, " ".join([*fixed[:27], "other", *fixed[28:]]))]  # 46 of 56; of three words 50 of 56
    sets = []
    for _, t in rows:
        w = t.split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    part = list(range(len(rows)))
    for a, x in enumerate(sets):
        for b, y in enumerate(sets[:a]):
            if 10 * len(x & y) >= 8 * len(x | y):
                part = [part[b] if p == part[a] else p for p in part]
    least = {}
    for (i, _), p in zip(rows, part, strict=True):
        least[p] = min(least.get(p, i), i)
    got = corpus_pipeline.without_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf_dir)
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(least.values())
    assert 900 in least.values() and 901 not in least.values()


def test_near_copies_are_told_apart_by_row(spark, sf_dir):
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [(1, a, 0), (1, b, 1), (2, a, 2), (None, b, 3), (None, "else " * 9, 4), (None, None, 5), (None, None, 6), (3, " ", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row int")
    got = corpus_pipeline.without_near_copies(spark, docs, sf_dir)
    assert got.columns == docs.columns and sorted(r["_row"] for r in got.collect()) == [0, 1, 4, 5, 6, 7]
    assert corpus_pipeline.without_near_copies(spark, docs.where("false"), sf_dir).count() == 0
