"""Ranked lexical search: documents as a tree of frequency-ordered terms, searched depth first under bounds."""

from __future__ import annotations

import math
from bisect import insort
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import kept

#: Items, and bytes of their texts, that one pass over the documents looks for.
BLOCK_ITEMS, BLOCK_BYTES = 4096, 16_000_000
#: Documents, and their terms, in a tree; documents in a leaf.
TREE_DOCS, TREE_TERMS, LEAF = 32_768, 4_000_000, 64
#: Bytes of a text that are worked on at once.
SLICE = 1 << 22
#: Letters and digits of ASCII, letters in lower case, and all bytes above it; all others end a term.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def term_counts(text: bytes) -> Counter[bytes]:
    folded = text.translate(FOLD)
    out: Counter[bytes] = Counter()
    at = 0
    while at < len(folded):
        end = folded.find(b" ", at + SLICE)
        end = len(folded) if end < 0 else end
        out.update(folded[at:end].split())
        at = end
    return out


def gain(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What an occurrence count adds per unit of weight: larger for larger ``tf`` and for smaller ``m``."""
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def most_by(group: np.ndarray, term: np.ndarray, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The largest ``tf`` of each pair of a group and a term."""
    order = np.lexsort((term, group))
    group, term, tf = group[order], term[order], tf[order]
    first = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (term[1:] != term[:-1])]) if len(group) else order
    return group[first], term[first], np.maximum.reduceat(tf, first) if len(first) else tf


@dataclass
class Tree:
    """Documents in the order of their term sequences; nodes are ranges of them that share a path.

    Node 0 is the root. ``low`` and ``high`` are a node's documents, ``children`` its nodes (none: a leaf), ``least`` its
    smallest ``m``. ``at[t]:at[t + 1]`` in ``node`` and ``most`` are the nodes that hold term ``t`` and its largest ``tf``.
    """

    low: np.ndarray
    high: np.ndarray
    children: list[list[int]]
    least: np.ndarray
    at: np.ndarray
    node: np.ndarray
    most: np.ndarray


def paths(first: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of documents by their terms (already ascending), and how many leading terms each shares with the last."""
    raw = (term + 1).astype(">u4").tobytes()
    keys = [raw[4 * a : 4 * b] for a, b in zip(first[:-1], first[1:], strict=True)]
    order = sorted(range(len(keys)), key=keys.__getitem__)
    shared = np.zeros(len(keys), np.int64)
    for i in range(1, len(order)):
        a, b = order[i - 1], order[i]
        n = min(first[a + 1] - first[a], first[b + 1] - first[b])
        other = np.flatnonzero(term[first[a] : first[a] + n] != term[first[b] : first[b] + n])
        shared[i] = other[0] if len(other) else n
    return np.array(order, np.int64), shared


def ranges(shared: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of at least ``LEAF`` documents under a common path, outer ones first."""
    out: list[tuple[int, int]] = []
    open_at: list[tuple[int, int]] = [(0, 0)]  # depth and first document of the paths that are not left yet
    for i in range(1, len(shared) + 1):
        depth = int(shared[i]) if i < len(shared) else -1
        start = i - 1
        while open_at and open_at[-1][0] > depth:
            start = open_at.pop()[1]
            if i - start >= LEAF:
                out.append((start, i))
        if depth >= 0 and (not open_at or open_at[-1][0] < depth):
            open_at.append((depth, start))
    return sorted(out, key=lambda r: (r[0], -r[1]))


def grow(docs: int, shared: np.ndarray, first: np.ndarray, term: np.ndarray, tf: np.ndarray, m: np.ndarray, vocabulary: int) -> Tree:
    """The tree over documents in path order.

    A path gets a node if it halves the documents of the node above, so that no term is noted more than log2 times; what
    lies between the nodes goes into leaves.
    """
    low, high, children, up = [0], [docs], [[]], [-1]
    filled = [0]  # up to which document a node's children reach
    leaves: list[int] = []

    def add(parent: int, a: int, b: int) -> int:
        low.append(a)
        high.append(b)
        children.append([])
        up.append(parent)
        filled.append(a)
        children[parent].append(len(low) - 1)
        return len(low) - 1

    def leaf_up_to(parent: int, end: int) -> None:
        for a in range(filled[parent], end, LEAF):
            leaves.append(add(parent, a, min(a + LEAF, end)))
        filled[parent] = max(filled[parent], end)

    open_nodes = [0]
    for a, b in ranges(shared):
        while a >= high[open_nodes[-1]]:
            done = open_nodes.pop()
            leaf_up_to(done, high[done])
        top = open_nodes[-1]
        if 2 * (b - a) <= high[top] - low[top]:
            leaf_up_to(top, a)
            filled[top] = b
            open_nodes.append(add(top, a, b))
    while open_nodes:
        done = open_nodes.pop()
        leaf_up_to(done, high[done])
    nodes = len(low)
    of_doc = np.empty(docs, np.int64)
    least = np.full(nodes, np.iinfo(np.int64).max)
    for leaf in leaves:
        of_doc[low[leaf] : high[leaf]] = leaf
        least[leaf] = m[low[leaf] : high[leaf]].min()
    layer = most_by(np.repeat(of_doc, np.diff(first)), term, tf)
    above = np.array(up)
    depth = np.zeros(nodes, np.int64)
    for i in range(1, nodes):
        depth[i] = depth[up[i]] + 1
    for i in range(nodes - 1, 0, -1):  # children come after their parents
        least[up[i]] = min(least[up[i]], least[i])
    found = []
    for level in range(int(depth.max()), 0, -1):
        here = depth[layer[0]] == level
        mine = tuple(x[here] for x in layer)
        found.append(mine)
        rest = tuple(x[~here] for x in layer)
        layer = most_by(np.r_[above[mine[0]], rest[0]], np.r_[mine[1], rest[1]], np.r_[mine[2], rest[2]])
    found.append(layer)
    node, held, most = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(held, kind="stable")
    at = np.searchsorted(held[order], np.arange(vocabulary + 1))
    return Tree(np.array(low), np.array(high), children, least, at, node[order], most[order])


class Searcher:
    """The ``k`` best documents of each item so far, ties to the smaller id, null ids last."""

    def __init__(self, items: list[tuple[np.ndarray, np.ndarray]], vocabulary: int, k: int):
        self.items, self.vocabulary, self.k = items, vocabulary, k
        self.best: list[list[tuple[int, bool, Any]]] = [[] for _ in items]

    def search(self, ids: list[Any], first: np.ndarray, term: np.ndarray, tf: np.ndarray, m: np.ndarray) -> None:
        order, shared = paths(first, term)
        size = np.diff(first)[order]
        ends = np.r_[0, np.cumsum(size)]
        source = np.repeat(first[:-1][order] - ends[:-1], size) + np.arange(ends[-1])
        term, tf, m, ids = term[source], tf[source], m[order], [ids[i] for i in order]
        tree = grow(len(ids), shared, ends, term, tf, m, self.vocabulary)
        owner = np.repeat(np.arange(len(ids)), size)
        weight = np.zeros(self.vocabulary, np.int64)
        for best, (terms, weights) in zip(self.best, self.items, strict=True):
            bound = np.zeros(len(tree.low), np.int64)
            for t, w in zip(terms, weights, strict=True):
                holds = slice(tree.at[t], tree.at[t + 1])
                bound[tree.node[holds]] += w * gain(tree.most[holds], tree.least[tree.node[holds]])
            weight[terms] = weights
            stack = [0]
            while stack:
                node = stack.pop()
                if bound[node] <= 0 or (len(best) == self.k and bound[node] < -best[-1][0]):
                    continue
                if tree.children[node]:
                    stack += sorted(tree.children[node], key=bound.__getitem__)
                    continue
                a, b = tree.low[node], tree.high[node]
                part = slice(ends[a], ends[b])
                w = weight[term[part]]
                held = np.flatnonzero(w)
                doc = owner[part][held]
                scores = np.zeros(b - a, np.int64)
                np.add.at(scores, doc - a, w[held] * gain(tf[part][held], m[doc]))
                floor = -best[-1][0] if len(best) == self.k else 1
                for i in np.flatnonzero(scores >= max(floor, 1)):
                    insort(best, (-int(scores[i]), ids[a + i] is None, 0 if ids[a + i] is None else ids[a + i]))
                    del best[self.k :]
            weight[terms] = 0


def vectors(docs: DataFrame, words: dict[bytes, int], key: str, text: str) -> DataFrame:
    """``_id``, ``n`` and the counts of the ``words`` for all documents with a term."""
    shape = T.StructType([T.StructField("_id", docs.schema[key].dataType), T.StructField("n", T.LongType()), T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("tfs", T.ArrayType(T.LongType()))])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, sizes, at, terms, tfs = [], [], [0], [], []
            for row, value in enumerate(batch.column(1)):
                counts = term_counts(value.as_py() or b"")
                if not counts:
                    continue
                rows.append(row)
                sizes.append(counts.total())
                held = counts.keys() & words.keys()
                terms += [words[t] for t in held]
                tfs += [counts[t] for t in held]
                at.append(len(terms))
            lists = (pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x, kind)) for x, kind in ((terms, pa.int32()), (tfs, pa.int64())))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(sizes, pa.int64()), *lists], names=shape.names)

    return docs.select(F.col(key).alias("_id"), F.col(text).cast("string").cast("binary").alias("_text")).mapInArrow(count, shape)


def one_block(docs: DataFrame, items: list[tuple[Any, Counter[bytes]]], item_kind: T.DataType, k: int, item_key: str, key: str, text: str) -> DataFrame:
    words = {t: i for i, t in enumerate(sorted(set().union(*(c for _, c in items))))}
    rows = kept(vectors(docs, words, key, text), "vectors")
    n_docs, n_terms = rows.agg(F.count("*"), F.sum("n")).first()
    spread = {r["t"]: r["df"] for r in rows.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect()}
    # frequent terms first; the tree's paths follow this order
    by_use = sorted(range(len(words)), key=lambda t: (-spread.get(t, 0), t))
    place = np.empty(len(words), np.int64)
    place[by_use] = np.arange(len(words))
    held = [[(place[words[t]], q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * spread[words[t]] + 1)))) for t, q in c.items() if words[t] in spread] for _, c in items]
    asked = [(np.array([t for t, _ in h], np.int64), np.array([w for _, w in h], np.int64)) for h in held]
    names = [i for i, _ in items]
    item_arrow = to_arrow_type(item_kind)
    shape = T.StructType([T.StructField("_q", T.IntegerType()), T.StructField(item_key, item_kind), T.StructField(key, docs.schema[key].dataType), T.StructField("score", T.LongType())])

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(asked, len(words), k)
        waiting: list[pa.RecordBatch] = []
        id_kind: list[pa.DataType] = []

        def flush() -> None:
            ids = [i for b in waiting for i in b.column("_id").to_pylist()]
            n = np.concatenate([b.column("n").to_numpy() for b in waiting])
            size = np.concatenate([b.column("terms").value_lengths().to_numpy() for b in waiting]).astype(np.int64)
            term = place[np.concatenate([b.column("terms").flatten().to_numpy(zero_copy_only=False) for b in waiting])]
            tf = np.concatenate([b.column("tfs").flatten().to_numpy(zero_copy_only=False) for b in waiting])
            waiting.clear()
            first = np.r_[0, np.cumsum(size)]
            order = np.lexsort((term, np.repeat(np.arange(len(size)), size)))
            m = np.array([25 + 75 * int(v) * n_docs // n_terms for v in n], np.int64)
            searcher.search(ids, first, term[order], tf[order], m)

        for batch in batches:
            id_kind[:] = [batch.column("_id").type]
            for at in range(0, batch.num_rows, TREE_DOCS // 4):
                waiting.append(batch.slice(at, TREE_DOCS // 4))
                if sum(b.num_rows for b in waiting) >= TREE_DOCS or sum(len(b.column("terms").flatten()) for b in waiting) >= TREE_TERMS:
                    flush()
        if waiting:
            flush()
        out = [(q, None if null else i, -s) for q, best in enumerate(searcher.best) for s, null, i in best]
        if out:
            q, i, s = zip(*out, strict=True)
            yield pa.RecordBatch.from_pydict({"_q": pa.array(q, pa.int32()), item_key: pa.array([names[x] for x in q], item_arrow), key: pa.array(i, id_kind[0]), "score": pa.array(s, pa.int64())})

    best = Window.partitionBy("_q").orderBy(F.desc("score"), F.asc_nulls_last(key))
    return rows.where(F.size("terms") > 0).mapInArrow(find, shape).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(item_key, "rank", key, "score")


def search(docs: DataFrame, items: DataFrame, k: int = 10, item_key: str = "item_id", key: str = "doc_id", text: str = "text", block_items: int = BLOCK_ITEMS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``item_key``, ``rank``, ``key``, ``score``: the ``k`` best documents of each item, scores above 0, smaller ids first.

    Documents are cut down to the terms of the items. A task sorts their term vectors, most frequent term first, into
    trees whose nodes know the largest count of each term below and the smallest ``m``; it walks the trees depth first
    for each item, best child first, and leaves out what cannot reach the item's ``k`` best so far. The tasks' best are
    merged by rank. Items are asked in blocks of bounded size, one pass each; no pairs of items and documents arise but
    the ``k`` best of each task.

    Null and empty texts have no terms: such documents count nowhere, such items find nothing. Very long texts are
    counted slice by slice. Each row is a document or an item of its own, also if it repeats an id; null ids come last
    among equal scores. Empty tables give an empty result. Only the columns named are read.
    """
    n, size = items.agg(F.count("*"), F.sum(F.octet_length(text))).first()
    blocks = max(1, -(-n // block_items), -(-(size or 0) // block_bytes))
    asked = items.select(F.col(item_key).alias("_id"), F.col(text).cast("string").alias("_text"))
    out = []
    for block in range(blocks):
        mine = asked.where(F.pmod(F.xxhash64("_id", "_text"), F.lit(blocks)) == block).collect()
        counted = [(r["_id"], term_counts((r["_text"] or "").encode())) for r in mine]
        if counted:
            out.append(one_block(docs, counted, items.schema[item_key].dataType, k, item_key, key, text))
    if not out:
        return items.join(docs.select(key), F.lit(False)).select(item_key, F.lit(0).alias("rank"), key, F.lit(0).cast("long").alias("score"))
    return reduce(DataFrame.unionByName, out)
