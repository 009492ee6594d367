"""Exact top-k by inner product: term-at-a-time accumulation over blocks of queries and candidates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows in a block of queries and of candidates.
QUERY_BLOCK, CANDIDATE_BLOCK = 512, 8192


def weighted(vectors: DataFrame, scale: int, key: str, vector: str) -> DataFrame:
    """``_id`` and ``terms``: ``floor(scale * x)`` of every component; only vectors whose components are all finite."""
    x = F.col(vector)
    fine = x.isNotNull() & F.col(key).isNotNull() & F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))
    return vectors.where(fine).select(F.col(key).alias("_id"), F.transform(x, lambda v: F.floor(F.lit(float(scale)) * v.cast("double"))).cast("array<long>").alias("terms")).distinct()


def matrix(rows: pd.Series) -> np.ndarray:
    """Vectors as rows, short ones filled with zeros."""
    width = max(map(len, rows))
    out = np.zeros((len(rows), width), np.int64)
    for row, v in zip(out, rows, strict=True):
        row[: len(v)] = v
    return out


def accumulate(queries: np.ndarray, candidates: np.ndarray, part: int = 1024) -> np.ndarray:
    """Scores of all candidates for each query: each term's postings are scattered, weighted by the queries that hold it.

    Candidates go by parts whose scores stay in the processor's cache. Where most of a part holds the term, the whole
    column is added (other rows add zero). Numbers are 32 bits wide if no score can be larger, else 64.
    """
    width = min(queries.shape[1], candidates.shape[1])
    queries, candidates = queries[:, :width], candidates[:, :width]
    most = [float(np.abs(x.astype(np.float64)).max(initial=0)) for x in (queries, candidates)]
    kind = np.int32 if width * most[0] * most[1] < 2**31 and max(most) < 2**31 else np.int64
    weights = np.ascontiguousarray(queries.T, dtype=kind)
    terms = np.ascontiguousarray(candidates.T, dtype=kind)
    out = np.empty((len(queries), len(candidates)), np.int64)
    for at in range(0, len(candidates), part):
        column = terms[:, at : at + part]
        scores = np.zeros((len(queries), column.shape[1]), kind)
        room = np.empty_like(scores)
        for term in np.flatnonzero(weights.any(axis=1)):
            postings = np.flatnonzero(column[term])
            if 2 * len(postings) > column.shape[1]:
                np.multiply(weights[term][:, None], column[term][None, :], out=room)
                scores += room
            elif len(postings):
                scores[:, postings] += weights[term][:, None] * column[term, postings][None, :]
        out[:, at : at + part] = scores
    return out


def best(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places ``(query, candidate)`` of each query's ``k`` highest scores, ties to the smaller id (``ids`` ascend)."""
    qs, cs = [], []
    for q, row in enumerate(scores):
        there = np.flatnonzero(ids != own[q])
        row = row[there]
        if len(row) > k:
            edge = np.partition(row, len(row) - k)[len(row) - k]
            above = np.flatnonzero(row > edge)
            level = np.flatnonzero(row == edge)[: k - len(above)]
            there = there[np.concatenate((above, level))]
        qs.append(np.full(len(there), q))
        cs.append(there)
    return np.concatenate(qs), np.concatenate(cs)


def search(vectors: DataFrame, every: int = 20, k: int = 20, scale: int = 64, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: for each row whose id is divisible by ``every`` the ``k`` highest
    inner products among all other rows, on components ``floor(scale * x)``; ties go to the smaller id.

    Blocks of queries meet blocks of candidates in a task each; the task accumulates the scores of its block term by
    term, takes the ``k`` best of each query by partition, and the blocks' winners are merged by rank. No side is
    broadcast, and no task holds more than a block of scores.

    Vectors that are null, or hold a null or non-finite component, and null ids take no part; empty vectors score 0; of
    vectors of different length the missing components count as zero. A row repeated with the same vector counts
    once; other vectors under a query's id are no candidates for it. Fewer candidates than ``k`` give fewer rows. An
    empty table gives an empty result; only the two columns named are read.
    """
    rows = weighted(vectors, scale, key, vector)
    sizes = rows.agg(F.count("*"), F.count_if(F.col("_id") % every == 0)).first()
    cb, qb = (max(1, -(-n // size)) for n, size in zip(sizes, (CANDIDATE_BLOCK, QUERY_BLOCK), strict=True))
    block = F.pmod(F.xxhash64("_id", "terms"), F.lit(cb)).cast("int")
    candidates = rows.select("_id", "terms", block.alias("c"), F.explode(F.sequence(F.lit(0), F.lit(qb - 1))).alias("q"))
    asked = rows.where(F.col("_id") % every == 0).withColumn("q", F.pmod(F.xxhash64("_id", "terms", F.lit(1)), F.lit(qb)).cast("int"))
    asked = asked.select("_id", "terms", "q", F.explode(F.sequence(F.lit(0), F.lit(cb - 1))).alias("c"))

    def tile(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "q_no": [], "vec_id": [], "score": []}).astype("int64")
        right = right.sort_values("_id", kind="stable").reset_index(drop=True)
        ids = right["_id"].to_numpy()
        weights, terms = matrix(left["terms"]), matrix(right["terms"])
        out = []
        for at in range(0, len(left), 64):
            own = left["_id"].to_numpy()[at : at + 64]
            scores = accumulate(weights[at : at + 64], terms)
            q, c = best(scores, ids, own, k)
            out.append(pd.DataFrame({"query_id": own[q], "q_no": left["q_no"].to_numpy()[at : at + 64][q], "vec_id": ids[c], "score": scores[q, c]}))
        return pd.concat(out)

    # several vectors under one id are several queries
    asked = asked.withColumn("q_no", F.xxhash64("terms"))
    found = asked.groupBy("q", "c").cogroup(candidates.groupBy("q", "c")).applyInPandas(tile, "query_id long, q_no long, vec_id long, score long")
    order = Window.partitionBy("query_id", "q_no").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
