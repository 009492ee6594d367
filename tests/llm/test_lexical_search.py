"""Ranked search against scores of all documents, and the bounds it relies on."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from maskwell.llm import lexical_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(UPPER))


def brute(docs, items, k=10):
    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c, c.total()) for i, c in counted if c]
    n_docs, total = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c, n in counted:
            m = 100 - 75 + 75 * n * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if c[t])
            if s > 0:
                scores.append((-s, i is None, i))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(7)
    words = [f"w{int(rng.paretovariate(0.7)) % 300}" for _ in range(4000)] + ["É", "ünit", "The", "x9"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 60)))) for i in range(900)]
    docs += [(1000 + i, docs[5][1]) for i in range(80)]  # ties
    docs += [(2000, None), (2001, ""), (2002, " .,- "), (None, docs[5][1]), (None, docs[6][1]), (5, docs[5][1]), (2003, " ".join(rng.choice(words) for _ in range(30_000)))]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 25)))) for i in range(25)]
    items += [(100, docs[5][1]), (101, None), (102, ""), (103, "absent everywhere"), (None, docs[6][1]), (7, "the THE the"), (7, "the THE the")]
    return docs, items


@pytest.mark.parametrize(("tree_docs", "leaf", "block"), [(32_768, 64, 4096), (200, 4, 3), (50, 1, 4096)])
def test_search(spark, tables, monkeypatch, tree_docs, leaf, block):
    docs, items = tables
    monkeypatch.setattr(lexical_search, "TREE_DOCS", tree_docs)
    monkeypatch.setattr(lexical_search, "LEAF", leaf)
    monkeypatch.setattr(lexical_search, "SLICE", 100)
    d = spark.createDataFrame([(i, t, "x", "x", "x") for i, t in docs], "doc_id long, text string, rank string, score string, terms string")
    q = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    if block == 3:
        items, q = items[:8], q.where("item_id < 8").limit(8)
        items = [(r["item_id"], r["text"]) for r in q.collect()]
    got = lexical_search.search(d, q, block_items=block)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(docs, items)


def test_empty_tables(spark, tables):
    docs, items = (spark.createDataFrame(t[:20], f"{k} long, text string") for t, k in zip(tables, ("doc_id", "item_id"), strict=True))
    assert lexical_search.search(docs.where("false"), items).collect() == []
    assert lexical_search.search(docs, items.where("false")).collect() == []


def random_tree(leaf, monkeypatch):
    monkeypatch.setattr(lexical_search, "LEAF", leaf)
    rng = random.Random(leaf)
    docs = [sorted(rng.sample(range(30), rng.randint(1, 9))) for _ in range(300)] + [[0, 1, 2]] * 40
    first = np.r_[0, np.cumsum([len(d) for d in docs])]
    term = np.concatenate([np.array(d) for d in docs])
    order, shared = lexical_search.paths(first, term)
    docs = [docs[i] for i in order]
    tf = np.array([rng.randint(1, 5) for _ in range(len(term))])
    m = np.array([rng.randint(25, 300) for _ in docs])
    ends = np.r_[0, np.cumsum([len(d) for d in docs])]
    return docs, shared, ends, np.concatenate([np.array(d) for d in docs]), tf, m


@pytest.mark.parametrize("leaf", [1, 4, 64])
def test_tree_maxima_and_minima(leaf, monkeypatch):
    docs, shared, ends, term, tf, m = random_tree(leaf, monkeypatch)
    assert docs == sorted(docs)
    tree = lexical_search.grow(len(docs), shared, ends, term, tf, m, 30)
    most = {}
    for t in range(30):
        for at in range(tree.at[t], tree.at[t + 1]):
            most[int(tree.node[at]), t] = int(tree.most[at])
    covered = []
    for node, (a, b) in enumerate(zip(tree.low, tree.high, strict=True)):
        assert tree.least[node] == m[a:b].min()
        want = {}
        for x in range(ends[a], ends[b]):
            want[int(term[x])] = max(want.get(int(term[x]), 0), int(tf[x]))
        assert want == {t: v for (n, t), v in most.items() if n == node}
        inner = sorted((tree.low[c], tree.high[c]) for c in tree.children[node])
        if inner:
            assert [inner[0][0], *(h for _, h in inner)] == [a, *(lo for lo, _ in inner[1:]), b]
        else:
            covered.append((a, b))
    assert sum(b - a for a, b in covered) == len(docs)


def test_subtrees_are_left_out(monkeypatch):
    docs, _, ends, term, tf, m = random_tree(4, monkeypatch)
    visits = []
    real = lexical_search.np.add.at
    searcher = lexical_search.Searcher([(np.array([29, 28]), np.array([5000, 4000]))], 30, 3)
    calls = lambda *a: visits.append(1) or real(*a)
    monkeypatch.setattr(lexical_search, "np", type("N", (), {**vars(np), "add": type("A", (), {"at": staticmethod(calls)})}))
    searcher.search(list(range(len(docs))), ends, term, tf, m)
    assert len(searcher.best[0]) == 3 and len(visits) < len(docs) // 4 / 2
