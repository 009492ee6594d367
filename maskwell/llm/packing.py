"""Harmonic packing: pieces of a length class ``(C / (k + 1), C / k]`` fill sequences by ``k`` each."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate, chain, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import kept

#: Pieces that a worker packs on its own.
WORKER_PIECES = 100_000
#: Words whose ids are remembered in a task, and how many go to the tokenizer at once.
CACHE_WORDS, BATCH_WORDS = 500_000, 8192
#: Words that the tokenizer gets as one text.
RUN_WORDS = 512
#: Characters that are worked on at once, and of one text at most.
STEP, SLICE = 1 << 22, 1 << 20
#: Documents whose ids are held at once.
ROWS = 1024
MARK = "\x00"
# No token of a byte-level BPE reaches across these places: before the last of some white space, and before a sign that
# follows a letter or digit. Left alone are characters of which some tables say that they are white space, letters
# beyond Latin, and signs of contractions and special tokens.
NO_SEAM = re.compile("\x00(?=[ \n](?:[\x00<\\s\u180e\u200b-\u200f\ufeff]|\\Z))")
SIGN = r"([0-9A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}])([.,;:!?)\"/@-])"
SEAM = re.compile(r" (?=[0-9A-Za-z])")
PLAIN = re.compile(r" [0-9A-Za-z][^\W_]*").fullmatch
WIDE = "<u4"


def lengths(n: int, capacity: int, slack: int) -> list[int]:
    """The pieces of a document of ``n`` ids, in order.

    Full sequences are cut off first. What is left stays whole if ``k`` pieces of its length leave at most ``slack``
    ids of a sequence free, else a piece of the next class's greatest length goes first: three cuts or so reach that.
    """
    out = [capacity] * (n // capacity)
    left = n % capacity
    while left:
        k = capacity // left
        piece = left if capacity - k * left <= slack else capacity // (k + 1)
        out.append(piece)
        left -= piece
    return out


def slices(text: str) -> Iterator[str]:
    """A text in parts of about ``SLICE`` characters, cut at seams."""
    at = 0
    while at < len(text):
        seam = SEAM.search(text, at + SLICE)
        end = seam.start() if seam else len(text)
        yield text[at:end]
        at = end


def words(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words of texts cut at all seams, the word at each place, and the place where each text starts."""
    marked = [NO_SEAM.sub("", t.replace(" ", MARK + " ").replace("\n", MARK + "\n")) for t in texts]
    parts = pc.split_pattern(pc.replace_substring_regex(pa.array(marked, pa.large_string()), SIGN, r"\1" + MARK + r"\2"), MARK)
    coded = parts.flatten().dictionary_encode()
    uniques = pc.binary_join(pa.ListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary.cast(pa.string())), MARK)[0].as_py().split(MARK)
    return uniques, coded.indices.to_numpy().astype(np.int64), parts.offsets.to_numpy()


def encoder(tokenizer: str) -> Callable[[Iterable[str]], list[bytes]]:
    """A function from texts to their ids, as little-endian 32-bit numbers.

    No token reaches across a seam, so the tokenizer sees each word once and the texts are put together from words.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; threads would each keep memory
    from tokenizers import Tokenizer

    bpe = Tokenizer.from_file(tokenizer)
    known: dict[str, bytes] = {}

    # bytes of each token, as a byte-level vocabulary writes a byte as a character
    vocabulary = bpe.get_vocab(with_added_tokens=True)
    token_bytes = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
    token_bytes[list(vocabulary.values())] = list(map(len, vocabulary))

    def take(part: list[str], flat: bytes, ends: list[int]) -> None:
        known.update(zip(part, map(flat.__getitem__, map(slice, [0, *ends], ends)), strict=False))

    def run_together(part: list[str]) -> bool:
        """Encodes words as one text, whose ids fall into words by their bytes; false where they do not."""
        ids = np.array(bpe.encode_batch_fast(["".join(part)], add_special_tokens=False)[0].ids, WIDE)
        stops, want = np.cumsum(token_bytes[ids]), np.cumsum(pc.binary_length(pa.array(part)).to_numpy())
        at = np.searchsorted(stops, want)
        if not len(stops) or at[-1] != len(stops) - 1 or (stops[at] != want).any():
            return False
        take(part, ids.tobytes(), (4 * (at + 1)).tolist())
        return True

    def learn(fresh: list[str]) -> None:
        # before a space and a letter or digit there is a seam whatever comes before (see SEAM)
        plain, left = [], []
        for w in fresh:
            (plain if PLAIN(w) else left).append(w)
        for at in range(0, len(plain), RUN_WORDS):
            part = plain[at : at + RUN_WORDS]
            if not run_together(part):
                left += part
        for at in range(0, len(left), BATCH_WORDS):
            part = left[at : at + BATCH_WORDS]
            ids = [e.ids for e in bpe.encode_batch_fast(part, add_special_tokens=False)]
            take(part, np.fromiter(chain.from_iterable(ids), WIDE).tobytes(), [4 * n for n in accumulate(map(len, ids))])

    def joined(texts: list[str]) -> list[bytes]:
        if len(known) > CACHE_WORDS:
            known.clear()
        uniques, place, first = words(texts)
        learn([w for w in uniques if w not in known])
        raws = [known[w] for w in uniques]
        # the ids of each word as one value: put together by copying runs of bytes, not id by id
        values = pa.array(raws, pa.large_binary()).take(pa.array(place))
        ends = np.frombuffer(values.buffers()[1], np.int64)[: len(values) + 1]
        ids = memoryview(values.buffers()[2] or b"")
        return [bytes(ids[a:b]) for a, b in pairwise(ends[first].tolist())]

    def encode(texts: Iterable[str]) -> list[bytes]:
        out: list[list[bytes]] = []
        rows: list[int] = []
        parts: list[str] = []
        waiting = 0

        def flush() -> None:
            for row, raw in zip(rows, joined(parts) if parts else (), strict=True):
                out[row].append(raw)
            rows.clear()
            parts.clear()

        for row, text in enumerate(texts):
            out.append([])
            if MARK in text:
                whole = bpe.encode(text, add_special_tokens=False).ids
                out[row].append(np.array(whole, WIDE).tobytes())
                continue
            for part in slices(text):
                rows.append(row)
                parts.append(part)
                waiting += len(part)
                if waiting >= STEP:
                    flush()
                    waiting = 0
        flush()
        return [b"".join(raws) for raws in out]

    return encode


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, slack: int = 64, end: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens`` of every piece of every document, and its ``_row``."""
    kind = docs.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), *(T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens", "_row"))])
    stop = np.array([end], WIDE).tobytes()

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        cuts: dict[int, list[int]] = {}
        seen = TaskContext.get().partitionId() << 33
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            rows, numbers = [], []
            for row, ids in enumerate(encode(value or "" for value in batch.column(1).to_pylist())):
                raw = memoryview(ids + stop)
                n, at = len(raw) // 4, 0
                left = n % capacity
                if left not in cuts:
                    cuts[left] = lengths(left, capacity, slack)
                for size in [capacity] * (n // capacity) + cuts[left]:
                    rows.append(row)
                    numbers.append((at, size, zlib.crc32(raw[4 * at : 4 * (at + size)]), n, seen + row))
                    at += size
            columns = np.array(numbers, np.int64).reshape(-1, 5).T
            seen += batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *map(pa.array, columns)], names=schema.names)

    return docs.select(F.col(key), F.col(text).cast("string")).mapInArrow(cut, schema)


def fill(length: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece; pieces of a class go by the class's count into each bin.

    The classes' last, unfilled bins are emptied into common ones: longest piece first, into the first with room.
    A worker has fewer such pieces than the sum of the classes' counts.
    """
    per_bin = capacity // length
    order = np.argsort(per_bin, kind="stable")
    count = per_bin[order]
    first = np.flatnonzero(np.r_[True, count[1:] != count[:-1]]) if len(count) else np.zeros(0, np.int64)
    size = np.diff(np.r_[first, len(count)])
    place = np.arange(len(count)) - np.repeat(first, size)
    full = size // count[first]
    own = place < np.repeat(full * count[first], size)
    base = np.r_[0, np.cumsum(full)]
    bins = np.where(own, np.repeat(base[:-1], size) + place // np.maximum(count, 1), -1)
    room = np.zeros(0, np.int64)
    rest = np.flatnonzero(~own)
    for i in rest[np.argsort(-length[order[rest]], kind="stable")]:
        n = length[order[i]]
        fits = np.flatnonzero(room >= n)
        if not len(fits):
            room = np.append(room, capacity)
            fits = [len(room) - 1]
        room[fits[0]] -= n
        bins[i] = base[-1] + fits[0]
    out = np.empty(len(length), np.int64)
    out[order] = bins
    by_bin = np.argsort(out, kind="stable")
    sizes = length[by_bin]
    ends = np.cumsum(sizes) - sizes
    heads = np.flatnonzero(np.r_[True, out[by_bin][1:] != out[by_bin][:-1]]) if len(by_bin) else by_bin
    offset = np.empty(len(length), np.int64)
    offset[by_bin] = ends - np.repeat(ends[heads], np.diff(np.r_[heads, len(by_bin)]))
    return out, offset


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, slack: int = 64, end: int = 1, worker_pieces: int = WORKER_PIECES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset`` of every piece.

    A document is the ids of its text and the id ``end``. Pieces are dealt evenly to workers; each fills the bins of its
    classes by itself, so no numbers are shared and no group holds more than about ``worker_pieces`` pieces. A bin
    leaves at most ``slack`` ids free, or for very short pieces fewer than their length; a worker's last pieces share
    their bins.

    Null and empty texts are one piece, the ``end`` alone. Very long texts are encoded slice by slice, and their ids held
    as four bytes each. Repeated rows and null ids are documents of their own; an empty table gives an empty result;
    only the two columns named are read, so others may have any name.
    """
    cut = kept(pieces(docs, tokenizer, capacity, slack, end, key, text), "pieces")
    workers = max(1, -(-cut.count() // worker_pieces))
    schema = T.StructType([*cut.drop("_row").schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def worker(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([key, "start", "_row"], kind="stable")
        bins, offset = fill(rows["length"].to_numpy(), capacity)
        return rows.assign(sequence_id=bins * workers + rows["_worker"].to_numpy(), offset=offset)[schema.names]

    dealt = cut.withColumn("_worker", F.pmod(F.xxhash64(key, "start", "_row"), F.lit(workers)))
    return dealt.groupBy("_worker").applyInPandas(worker, schema)
