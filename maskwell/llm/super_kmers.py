"""Word-exact substring dedup: super-k-mers travel to the bucket of their minimiser and windows are counted by sorting."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import Found, Units, find, merged, over_segments, with_spans
from .winnow import anchors, byte_values, ranges, rolling, sums

TABLE = byte_values()
SPACE = 32


class Words:
    """A text as its words joined by one space; words are runs without ASCII white space."""

    def __init__(self, raw: bytes):
        self.packed = b" ".join(raw.split())
        data = np.frombuffer(self.packed, np.uint8)
        gaps = np.flatnonzero(data == SPACE)
        self.start = np.concatenate(([0], gaps + 1)) if len(data) else gaps
        self.end = np.concatenate((gaps, [len(data)])) if len(data) else gaps

    def piece(self, at: int, n: int) -> bytes:
        return self.packed[self.start[at] : self.end[at + n - 1]]

    def hashes(self) -> np.ndarray:
        out = np.zeros(len(self.start), np.uint64)
        step = 1 << 16
        data = np.frombuffer(self.packed, np.uint8)
        for i in range(0, len(out), step):
            s, e = self.start[i : i + step], self.end[i : i + step]
            p = sums(TABLE[data[s[0] : e[-1]]])
            out[i : i + step] = ranges(p, s - s[0], e - s[0])
        return out


def word_windows(piece: bytes, length: int) -> list[bytes]:
    w = Words(piece)
    return [piece[s:e] for s, e in zip(w.start[: len(w.start) - length + 1].tolist(), w.end[length - 1 :].tolist(), strict=True)]


def compare(length: int):
    def run(pieces: list[bytes], offsets: list[int]) -> list[tuple[int, int] | None]:
        """Sorts the windows of the bucket and marks those seen more than once."""
        windows = sorted((w, i, j) for i, p in enumerate(pieces) for j, w in enumerate(word_windows(p, length)))
        out: list[tuple[int, int] | None] = [None] * len(pieces)
        for k, (w, i, j) in enumerate(windows):
            if k and windows[k - 1][0] == w or k + 1 < len(windows) and windows[k + 1][0] == w:
                lo, hi = out[i] or (j, j)
                out[i] = (min(lo, j), max(hi, j))
        return [(c[0], c[1] + length) if c else None for c in out]

    return run


def units(length: int, k: int) -> Units:
    def blocks(raw: bytes):
        h = Words(raw).hashes()
        return over_segments(lambda a, b: rolling(h[a:b], k), len(h), length, length - k + 1, anchors)

    return Units(length, blocks, Words, compare(length), lambda p: word_windows(p, length))


def kept_rows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for raw, copied, spans in zip(batch.column("raw"), batch.column("copied").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                words = raw.as_py().split()
                n = len(words)
                found = [(0, n)] if copied and n >= length else merged([(s["at"], s["end"]) for s in spans or ()])
                left, at = [], 0
                for s, e in found:
                    left += words[at:s]
                    at = e
                left += words[at:]
                rows.append((n, n - len(left), hashlib.sha256(b" ".join(left)).hexdigest()))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 3
            arrays = [batch.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string()), strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, names=["_key", "n_words", "n_removed", "kept_sha256"])

    return run


def without_repeats(docs: DataFrame, length: int = 35, k: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_words``, ``n_removed`` and ``kept_sha256`` for each row of ``docs``.

    Removed is every word covered by a window of ``length`` words whose sequence also starts anywhere else, in the same
    text or another one, judged on the input. The minimiser of a window is its least hash of ``k`` words; consecutive
    windows that share it are one super-k-mer. Super-k-mers are first counted by digest; those whose minimiser holds
    several different ones travel to its bucket as one packed string, where their windows are sorted and counted.

    Null, empty and blank texts have no words; texts of fewer words than ``length`` lose none. Repeated rows count as
    occurrences of each other. An empty table gives an empty result; only ``key`` and ``text`` are read.
    """
    found: Found = find(docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")), units(length, k), "_text")
    kind = docs.schema[key].dataType.simpleString()
    out = with_spans(found, "_key").mapInArrow(kept_rows(length), f"_key {kind}, n_words long, n_removed long, kept_sha256 string")
    return out.withColumnRenamed("_key", key)
