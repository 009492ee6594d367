"""Byte-exact substring dedup: an interval tree over sparse suffix arrays of anchored blocks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import WIDE, Found, Units, find, grouped, merged, over_segments, twice, with_spans
from .winnow import anchors, byte_values, rolling

TABLE = byte_values()


class Bytes:
    def __init__(self, raw: bytes):
        self.raw = raw

    def piece(self, at: int, n: int) -> bytes:
        return self.raw[at : at + n]


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while lo + 1 < hi:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def intervals(rights: list[bytes]) -> Iterator[tuple[int, list[list[int]]]]:
    """The common-prefix intervals of the sorted suffixes, children before parents: ``(depth, members of the children)``.

    One scan over the suffix array and its common-prefix lengths with a stack of open intervals.
    """
    order = sorted(range(len(rights)), key=rights.__getitem__)
    stack: list[tuple[int, list[list[int]]]] = []
    for i, here in enumerate(order):
        node = [here]
        depth = common(rights[here], rights[order[i + 1]]) if i + 1 < len(order) else -1
        while stack and stack[-1][0] > depth:
            d, children = stack.pop()
            children.append(node)
            yield d, children
            node = [x for c in children for x in c]
        if stack and stack[-1][0] == depth:
            stack[-1][1].append(node)
        else:
            stack.append((depth, [node]))


def left_classes(members: list[int], lefts: list[bytes], least: int) -> Iterator[tuple[int, list[int]]]:
    """Left extensions inside an interval: ``(depth, members)`` of each class that agrees to the left on at least
    ``least`` bytes and then differs, by the same scan over the reversed left sides."""
    sides = [lefts[m] for m in members]
    if least == 0:
        yield 0, members
    for d, children in intervals(sides):
        if d >= max(least, 1):
            yield d, [members[x] for c in children for x in c]


def maximal_repeats(pieces: list[bytes], offsets: list[int], length: int) -> Iterator[tuple[int, int, list[int]]]:
    """``(left, right, members)``: the members agree on ``left`` bytes before and ``right`` bytes after their anchor,
    ``left + right >= length``, and on neither side would all agree further (or a piece ends there)."""
    rights = [p[o:] for p, o in zip(pieces, offsets, strict=True)]
    lefts = [p[:o][::-1] for p, o in zip(pieces, offsets, strict=True)]
    for depth, children in intervals(rights):
        child = {m: i for i, c in enumerate(children) for m in c}
        for left, members in left_classes(list(child), lefts, max(0, length - depth)):
            if left + depth >= length and len({child[m] for m in members}) > 1:
                yield left, depth, members


def compare(length: int):
    def run(pieces: list[bytes], offsets: list[int]) -> list[tuple[int, int] | None]:
        rights = [p[o:] for p, o in zip(pieces, offsets, strict=True)]
        lefts = [p[:o][::-1] for p, o in zip(pieces, offsets, strict=True)]
        far = [(0, 0)] * len(pieces)
        for depth, children in intervals(rights):
            members = [m for c in children for m in c]
            # the longest agreement to the left is with a neighbour in the order of the left sides
            members.sort(key=lefts.__getitem__)
            best = [0] * len(members)
            for i in range(1, len(members)):
                n = common(lefts[members[i - 1]], lefts[members[i]])
                best[i - 1] = max(best[i - 1], n)
                best[i] = max(best[i], n)
            for m, n in zip(members, best, strict=True):
                if n + depth >= length:
                    far[m] = (max(far[m][0], n), max(far[m][1], depth))
        return [(o - a, o + b) if a + b else None for o, (a, b) in zip(offsets, far, strict=True)]

    return run


def units(length: int, k: int) -> Units:
    def blocks(raw: bytes):
        data = np.frombuffer(raw, np.uint8)
        return over_segments(lambda a, b: rolling(TABLE[data[a:b]], k), len(data), length, length - k + 1, anchors)

    def windows(piece: bytes) -> list[bytes]:
        return [piece[i : i + length] for i in range(len(piece) - length + 1)]

    return Units(length, blocks, Bytes, compare(length), windows)


def group_rows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in grouped(batches, ("h", "d1", "d2", "off", "piece")):
            out = []
            for left, right, members in maximal_repeats([r[4] for r in rows], [r[3] for r in rows], length):
                first = rows[members[0]]
                text = first[4][first[3] - left : first[3] + right]
                name = hashlib.blake2b(text, digest_size=16).hexdigest()
                out.extend((name, len(text), rows[m][1], rows[m][2], rows[m][3] - left) for m in members)
            if out:
                kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["repeat", "n_bytes", "d1", "d2", "lo"])

    return run


def repeat_groups(docs: DataFrame, length: int = 400, key: str = "doc_id", text: str = "text", wide: int = WIDE) -> DataFrame:
    """All occurrences of the maximal repeats of at least ``length`` bytes: ``repeat``, ``n_bytes``, ``key``, ``at``.

    A group is maximal inside its blocks, which reach at most ``length`` bytes past an anchor on the right; a longer
    repeat comes as a chain of overlapping groups. Blocks that are equal as a whole are a group of their own. Anchors
    with more than ``wide`` different blocks give their repeats as chains of windows of ``length`` bytes.
    """
    found = find(docs, units(length, length // 2), text, wide)
    near = found.pieces.where("piece is not null").select("h", "d1", "d2", "off", "piece")
    parts = near.repartition("h").sortWithinPartitions("h", "d1", "d2").mapInArrow(group_rows(length), "repeat string, n_bytes int, d1 long, d2 long, lo int")
    split = twice(found.pieces.where("piece is null"))
    name = F.concat(F.hex("w1"), F.hex("w2"))
    parts = parts.unionByName(split.select(name.alias("repeat"), F.lit(length).alias("n_bytes"), "d1", "d2", F.col("off").alias("lo")))
    seen = found.texts.select(F.col(key).alias("_key"), "t1", "t2")
    placed = found.blocks.select("d1", "d2", "t1", "t2", "at", "n").join(seen, ["t1", "t2"])
    same = placed.groupBy("d1", "d2").agg(F.count("*").alias("c")).where("c > 1")
    name = F.concat(F.hex("d1"), F.hex("d2"))
    whole = placed.join(same, ["d1", "d2"]).select(name.alias("repeat"), F.col("n").alias("n_bytes"), "_key", "at")
    out = placed.join(parts, ["d1", "d2"]).select("repeat", "n_bytes", "_key", (F.col("at") + F.col("lo")).alias("at"))
    return out.unionByName(whole).distinct().withColumnRenamed("_key", key)


def kept_rows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for raw, copied, spans in zip(batch.column("raw"), batch.column("copied").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                b = raw.as_py()
                found = [(0, len(b))] if copied and len(b) >= length else merged([(s["at"], s["end"]) for s in spans or ()])
                at, left = 0, hashlib.sha256()
                for s, e in found:
                    left.update(b[at:s])
                    at = e
                left.update(b[at:])
                rows.append((len(b), sum(e - s for s, e in found), len(found), left.hexdigest()))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 4
            arrays = [batch.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, names=["_key", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def without_repeats(docs: DataFrame, length: int = 400, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept_sha256`` for each row of ``docs``.

    Removed is every byte covered by a string of ``length`` bytes that also starts anywhere else, in the same text or
    another one, overlaps counted, judged on the input. See :mod:`repeats` for the steps; inside the group of an anchor
    hash, the pieces after the anchor form a suffix array whose common-prefix intervals are scanned with a stack, and
    the extensions to the left are told apart in each interval.

    Null and empty texts have no bytes; texts shorter than ``length`` lose none. Repeated rows count as occurrences of
    each other. Long texts are read in overlapping segments. An empty table gives an empty result; only ``key`` and
    ``text`` are read.
    """
    found: Found = find(docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")), units(length, length // 2), "_text")
    kind = docs.schema[key].dataType.simpleString()
    out = with_spans(found, "_key").mapInArrow(kept_rows(length), f"_key {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return out.withColumnRenamed("_key", key)
