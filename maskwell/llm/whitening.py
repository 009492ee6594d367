"""Whitening of embeddings: the covariance of distinct vectors, weighted by multiplicity or by one, and its projection."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import kept

#: A vector with more than 1 / HOT_SHARE of the rows is hot, so fewer than HOT_SHARE vectors are.
HOT_SHARE = 1000
#: Tables with at most this many rows are joined without a part for hot vectors.
PLAIN_ROWS = 1_000_000
#: Partial sums that are added in one group.
FAN = 512
#: Eigenvalues below this share of the largest, times the dimension, count as zero.
NOISE = 1e-12
LONG = 2**63 - 1


def grid(vectors: DataFrame, scale: int, key: str, vector: str) -> DataFrame:
    """``_id`` and ``x``: ``floor(scale * c)`` of every component; only vectors whose components are all finite."""
    c = F.col(vector)
    fine = c.isNotNull() & F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    x = F.transform(c, lambda v: F.floor(F.lit(float(scale)) * v.cast("double")) + F.lit(0)).cast("array<long>")
    return vectors.where(F.coalesce(fine, F.lit(False))).select(F.col(key).alias("_id"), x.alias("x"))


def padded(x: Column, width: int) -> Column:
    return F.concat(x, F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size(x)))


def matrices(batches: Iterable[pa.RecordBatch], width: int, weights: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Each batch of distinct vectors as a matrix, with its fit weights."""
    for batch in batches:
        if batch.num_rows:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)
            uses = batch.column("uses").to_numpy()
            yield batch, x, uses if weights == "count" else np.ones_like(uses)


def exact_dot(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Integer ``x @ y``; beyond 64 bits with Python's numbers."""
    most = [max((abs(int(v)) for v in (a.min(initial=0), a.max(initial=0))), default=0) for a in (x, y)]
    wide = most[0] * most[1] * max(1, x.shape[-1]) > LONG
    return x.astype(object) @ y.astype(object) if wide else x.astype(np.int64) @ y.astype(np.int64)


def sums(distinct: DataFrame, width: int, weights: str) -> list[int]:
    """Exact weighted sums of every dimension."""
    shape = "i int, s decimal(38,0)"

    def part(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * width
        for _, x, w in matrices(batches, width, weights):
            total = [a + int(b) for a, b in zip(total, exact_dot(w, x), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(total, pa.decimal128(38, 0))], names=["i", "s"])

    rows = distinct.mapInArrow(part, shape).groupBy("i").agg(F.sum("s").alias("s")).collect()
    return [int(r["s"]) for r in sorted(rows, key=lambda r: r["i"])]


def products(table: DataFrame, rows: int, part: Callable[[Iterable[pa.RecordBatch]], np.ndarray]) -> np.ndarray:
    """The sum over all partitions of a small matrix; the same on every run."""
    shape = "i int, part int, v array<double>"

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = part(batches)
        at = TaskContext.get().partitionId()
        columns = [pa.array(range(rows), pa.int32()), pa.array([at] * rows, pa.int32()), pa.array(list(m), pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["i", "part", "v"])

    def add(group: pd.DataFrame) -> pd.DataFrame:
        v = np.stack(group["v"].to_list())
        return pd.DataFrame({"i": group["i"].iloc[:1], "part": group["part"].iloc[:1] // FAN, "v": [[math.fsum(c) for c in v.T]]})

    parts = table.mapInArrow(partial, shape)
    some = parts.groupBy("i", F.floor(F.col("part") / FAN)).applyInPandas(add, shape)
    found = some.groupBy("i").applyInPandas(add, shape).collect()
    return np.array([r["v"] for r in sorted(found, key=lambda r: r["i"])]).reshape(rows, -1)


def covariance(distinct: DataFrame, width: int, weights: str, n: int, total: list[int]) -> np.ndarray:
    """Centred before multiplying, divided by the sum of the weights."""
    mean = np.array([s / n for s in total])

    def part(batches: Iterable[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros((width, width))
        for _, x, w in matrices(batches, width, weights):
            centred = x - mean
            out += (centred * w[:, None]).T @ centred
        return out

    return products(distinct, width, part) / n


def whiten(vectors: DataFrame, scale: int = 256, components: int = 4, weights: str = "one", key: str = "vec_id", vector: str = "embedding", plain_rows: int = PLAIN_ROWS) -> DataFrame:
    """``key``, ``component``, ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error`` of every row.

    Rows are grouped by their vector ``x = floor(scale * c)``. The distinct vectors, weighted by ``one`` or by their
    ``count``, are summed exactly, centred and multiplied partition by partition; only matrices of the dimension's size
    are added up and reach the driver. Each distinct vector is whitened once and joined back; vectors that hold more
    than one in ``HOT_SHARE`` of the rows are joined by broadcast, of which there are fewer than ``HOT_SHARE``.

    Rows whose vector is null, or holds a null or non-finite component, are left out; repeated rows and null ids stay as
    they are. Shorter vectors count as filled up with zeros. Components without variance have a null ``whitened``,
    the identity then being that of the others; with no variance at all ``explained`` is null too. A ``deviation`` (sum
    of ``(n * x - S)^2``, S the sums) beyond 64 bits is null; components beyond 64 bits saturate. Empty tables and empty
    vectors give no rows. Texts do not matter here; only the two columns named are read.
    """
    if weights not in ("one", "count"):
        raise ValueError("weights are 'one' or 'count'")
    rows = grid(vectors, scale, key, vector)
    width = rows.agg(F.max(F.size("x"))).first()[0] or 0
    rows = rows.select("_id", padded(F.col("x"), width).alias("x"))
    distinct = kept(rows.groupBy("x").agg(F.count("*").alias("uses")), "distinct")
    several, used = distinct.agg(F.count("*"), F.sum("uses")).first()
    shown = min(components, width)
    if not several or not shown:
        empty = rows.where("false").select(F.col("_id").alias(key))
        return empty.select("*", *(F.lit(None).cast(t).alias(c) for c, t in RESULT.items()))
    n = several if weights == "one" else used
    total = sums(distinct, width, weights)
    v = covariance(distinct, width, weights, n, total)
    values, axes = np.linalg.eigh((v + v.T) / 2)
    values, axes = values[::-1][:shown], axes[:, ::-1][:, :shown]
    seen = int((values > NOISE * width * max(values[0], 0)).sum())
    mean = np.array([s / n for s in total])
    turn = axes[:, :seen] / np.sqrt(values[:seen])
    square = sum(s * s for s in total)
    shape = T.StructType([distinct.schema["x"], distinct.schema["uses"], T.StructField("deviation", T.LongType()), T.StructField("w", T.ArrayType(T.DoubleType()))])

    def project(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = np.array(total, dtype=object)
        sizes = sizes.astype(np.int64) if max(map(abs, total)) <= LONG else sizes
        for batch, x, _ in matrices(batches, width, weights):
            most = max(abs(int(x.min())), abs(int(x.max())))
            wide = x.astype(object) if most * most * width > LONG else x
            own, with_sums = (wide * wide).sum(axis=1), exact_dot(x, sizes)
            far = [n * n * int(a) - 2 * n * int(b) + square for a, b in zip(own, with_sums, strict=True)]
            out = np.full((len(x), shown), np.nan)
            out[:, :seen] = (x - mean) @ turn
            w = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, shown), pa.int32()), pa.array(out.ravel(), from_pandas=True))
            yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("uses"), pa.array([d if d <= LONG else None for d in far], pa.int64()), w], names=shape.names)

    done = kept(distinct.mapInArrow(project, shape), "whitened")

    def spread(batches: Iterable[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros((seen + 1, seen))
        for batch in batches:
            w = batch.column("w").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, shown)[:, :seen]
            weight = batch.column("uses").to_numpy() if weights == "count" else np.ones(len(w))
            out[:seen] += (w * weight[:, None]).T @ w
            out[seen] += weight @ w
        return out

    error = None
    if seen:
        moments = products(done, seen + 1, spread) / n
        error = float(np.abs(moments[:seen] - np.outer(moments[seen], moments[seen]) - np.eye(seen)).max())
    trace = float(np.trace(v))
    share = [float(e) / trace if trace > 0 else None for e in values]
    lean = done.drop("uses")
    if used <= plain_rows:
        joined = rows.join(lean, "x")
    else:
        hot = done.where(F.col("uses") > used / HOT_SHARE)
        cold = rows.join(F.broadcast(hot.select("x")), "x", "left_anti").join(done.where(F.col("uses") <= used / HOT_SHARE).drop("uses"), "x")
        joined = rows.join(F.broadcast(hot.drop("uses")), "x").unionByName(cold)
    out = joined.select("_id", "deviation", F.posexplode("w").alias("_at", "whitened"))
    return out.select(
        F.col("_id").alias(key),
        (F.col("_at") + 1).cast("int").alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(F.array(*(F.lit(s).cast("double") for s in share)), F.col("_at")).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )


RESULT = {"component": "int", "n": "long", "deviation": "long", "whitened": "double", "explained": "double", "identity_error": "double"}
