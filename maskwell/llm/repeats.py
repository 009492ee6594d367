"""Repeated windows of fixed length across a corpus, found through anchors.

Every window of ``length`` units holds an anchor: the least ``k``-unit hash among its positions. The consecutive
windows of a text that share an anchor form a block. Equal windows lie at the same place of blocks with the same anchor
hash, so blocks are gathered by that hash and nothing else has to meet. Steps:

1. Blocks of all texts, as hash, 128-bit digest and place (no text); kept. Those whose hash is seen once are dropped.
2. Equal blocks become one class with a count. Classes of a count above one are repeated as a whole.
3. Where one hash has several classes, one copy of each class is cut from a text that holds it and compared inside the
   hash's group (``compare``): which stretch of each class is covered by windows that also occur in another class or
   twice in it. Hashes of more classes than ``wide`` are taken apart into single windows, counted by digest.
4. The covered stretch of each class goes back to all blocks of the class.

Texts are identified by 128 bits of their content: equal texts have equal results, and a text with copies is covered as
a whole if it holds a window at all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept
from .winnow import segments

BLOCKS = "h long, d1 long, d2 long, t1 long, t2 long, at long, n int, off int"
WIDE = 4096
OUT_ROWS = 100_000


@dataclass(frozen=True)
class Units:
    """How a text is read as units (bytes or words).

    ``blocks(raw)`` gives numpy arrays ``(hash, place, first, last)``; ``cut(raw)`` an object with ``piece(at, n)``
    bytes; ``compare(pieces, offsets)`` for the classes of one hash the covered ``(start, end)`` or ``None`` of each;
    ``windows(piece)`` the bytes of each window of a piece.
    """

    length: int
    blocks: Callable
    cut: Callable
    compare: Callable
    windows: Callable


def digest(b: bytes) -> bytes:
    return hashlib.blake2b(b, digest_size=16).digest()


def longs(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)


def identified(docs: DataFrame, text: str) -> DataFrame:
    """The rows with ``raw`` (UTF-8 bytes, null as empty) and its 128 bits ``t1``, ``t2``."""
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    return docs.withColumn("raw", raw).withColumns({"t1": F.xxhash64("raw"), "t2": F.xxhash64(F.lit(7), "raw")})


def block_rows(units: Units) -> Callable:
    """Blocks of the texts of a partition; copies of a text inside the partition are taken once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        cols: list[list] = [[] for _ in range(8)]
        digs: list[bytes] = []

        def flush() -> pa.RecordBatch:
            h, _, _, t1, t2, at, n, off = (np.concatenate(c) if c else np.zeros(0) for c in cols)
            d = longs(digs)
            arrays = [pa.array(x, t) for x, t in ((h.view(np.int64), pa.int64()), (d[:, 0], pa.int64()), (d[:, 1], pa.int64()), (t1, pa.int64()), (t2, pa.int64()), (at, pa.int64()), (n, pa.int32()), (off, pa.int32()))]
            for c in cols:
                c.clear()
            digs.clear()
            return pa.RecordBatch.from_arrays(arrays, names=["h", "d1", "d2", "t1", "t2", "at", "n", "off"])

        for batch in batches:
            for raw, t1, t2 in zip(batch.column("raw"), batch.column("t1").to_pylist(), batch.column("t2").to_pylist(), strict=True):
                if (t1, t2) in seen:
                    continue
                seen.add((t1, t2))
                b = raw.as_py()
                h, place, first, last = units.blocks(b)
                if not len(h):
                    continue
                cut = units.cut(b)
                n = last - first + units.length
                digs.extend(digest(cut.piece(a, m)) for a, m in zip(first.tolist(), n.tolist(), strict=True))
                for c, x in zip(cols, (h, h, h, np.full(len(h), t1), np.full(len(h), t2), first, n, place - first), strict=True):
                    c.append(x)
                if len(digs) >= OUT_ROWS:
                    yield flush()
        if digs:
            yield flush()

    return run


def cut_pieces(units: Units) -> Callable:
    """The bytes of the wanted blocks of each text; blocks of wide hashes as the digests of their windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            size = 0
            for i in range(batch.num_rows):
                cut = units.cut(batch.column("raw")[i].as_py())
                for w in batch.column("wanted")[i].as_py():
                    piece = cut.piece(w["at"], w["n"])
                    if w["wide"]:
                        for j, x in enumerate(units.windows(piece)):
                            a, b = np.frombuffer(digest(x), np.int64).tolist()
                            rows.append((w["h"], w["d1"], w["d2"], j, None, a, b))
                    else:
                        rows.append((w["h"], w["d1"], w["d2"], w["off"], piece, None, None))
                        size += len(piece)
                if len(rows) >= OUT_ROWS or size > 32 << 20:
                    yield piece_batch(rows)
                    rows, size = [], 0
            if rows:
                yield piece_batch(rows)

    return run


PIECES = "h long, d1 long, d2 long, off int, piece binary, w1 long, w2 long"


def piece_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["h", "d1", "d2", "off", "piece", "w1", "w2"])


def grouped(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[list[tuple]]:
    """The rows of each value of the first column, which come one after the other."""
    rows: list[tuple] = []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            if rows and rows[0][0] != row[0]:
                yield rows
                rows = []
            rows.append(row)
    if rows:
        yield rows


COVERS = "d1 long, d2 long, lo int, hi int"


def cover_rows(units: Units) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for rows in grouped(batches, ("h", "d1", "d2", "off", "piece")):
            found = units.compare([r[4] for r in rows], [r[3] for r in rows])
            out.extend((r[1], r[2], *c) for r, c in zip(rows, found, strict=True) if c)
            if len(out) >= OUT_ROWS:
                yield covers(out)
                out = []
        if out:
            yield covers(out)

    return run


def covers(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["d1", "d2", "lo", "hi"])


@dataclass
class Found:
    """``texts``: identified rows; ``blocks``: all blocks; ``classes``: repeated classes; ``pieces``: those that were
    compared; ``covered``: ``t1, t2, at, end`` stretches of texts, repeated ones not merged."""

    texts: DataFrame
    blocks: DataFrame
    pieces: DataFrame
    covered: DataFrame


def twice(apart: DataFrame) -> DataFrame:
    """The single windows of wide hashes whose content occurs more than once."""
    return apart.join(apart.groupBy("w1", "w2").agg(F.count("*").alias("c")).where("c > 1"), ["w1", "w2"])


def find(docs: DataFrame, units: Units, text: str = "text", wide: int = WIDE) -> Found:
    texts = identified(docs, text)
    made = texts.select("raw", "t1", "t2").where(F.octet_length("raw") >= units.length)
    blocks = kept(made.mapInArrow(block_rows(units), BLOCKS), "blocks")
    copies = kept(texts.groupBy("t1", "t2").agg(F.count("*").alias("c")).where("c > 1").select("t1", "t2", F.lit(True).alias("copied")), "copies")

    # partial sums before the shuffles, so a hot hash or class is one row for each task; a hash seen once meets nothing,
    # so only hashes travel to find those out, and the wide rows of the others once
    met = blocks.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h")
    again = kept(blocks.join(met, "h", "left_semi"), "met")
    classes = again.groupBy("h", "d1", "d2").agg(F.count("*").alias("c"), *(F.first(x).alias(x) for x in ("t1", "t2", "at", "n", "off")))
    classes = kept(classes, "counted")
    classes = kept(classes.join(classes.groupBy("h").agg(F.count("*").alias("kinds")), "h"), "classes")
    whole = classes.where("c > 1").select("d1", "d2", F.lit(0).alias("lo"), F.col("n").alias("hi"))

    several = classes.where("kinds > 1").withColumn("wide", F.col("kinds") > wide)
    wanted = several.groupBy("t1", "t2").agg(F.collect_list(F.struct("h", "d1", "d2", "at", "n", "off", "wide")).alias("wanted"))
    pieces = kept(texts.select("t1", "t2", "raw").join(wanted, ["t1", "t2"]).select("raw", "wanted").mapInArrow(cut_pieces(units), PIECES).dropDuplicates(["d1", "d2", "w1", "w2", "off"]), "pieces")
    near = pieces.where("piece is not null").select("h", "d1", "d2", "off", "piece")
    parts = near.repartition("h").sortWithinPartitions("h", "d1", "d2").mapInArrow(cover_rows(units), COVERS)
    apart = pieces.where("piece is null")
    split = twice(apart).groupBy("d1", "d2").agg(F.min("off").alias("lo"), (F.max("off") + units.length).alias("hi"))
    cover = whole.unionByName(parts).unionByName(split).groupBy("d1", "d2").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    # kept, so that the join has plain exchanges below it and Spark can split a hot class
    cover = kept(cover, "cover")
    stretches = again.select("d1", "d2", "t1", "t2", "at").join(cover, ["d1", "d2"])
    covered = stretches.select("t1", "t2", (F.col("at") + F.col("lo")).alias("at"), (F.col("at") + F.col("hi")).alias("end"))
    return Found(texts.join(copies, ["t1", "t2"], "left"), blocks, pieces, covered)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint maximal stretches."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def with_spans(found: Found, *columns: str) -> DataFrame:
    """Each row of the documents with ``raw``, ``copied`` (null or true) and ``spans`` (null if there are none)."""
    spans = found.covered.groupBy("t1", "t2").agg(F.collect_set(F.struct("at", "end")).alias("spans"))
    spans = kept(spans, "spans")
    return found.texts.join(spans, ["t1", "t2"], "left").select(*columns, "raw", "copied", "spans")


def over_segments(hashes: Callable, n: int, length: int, w: int, anchors: Callable):
    """Blocks of a long text, segment by segment."""
    parts = []
    for a, b in segments(n, length - 1):
        h = hashes(a, b)
        place, first, last = anchors(h, w)
        parts.append((h[place], place + a, first + a, last + a))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))
