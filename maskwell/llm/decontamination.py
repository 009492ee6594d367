"""Benchmark decontamination by canonical templates, hash-joined windows and slot consistency."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import identified
from .winnow import byte_values, mixed, ranges, rolling, sums

TABLE = byte_values()
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
UNITS = "mm cm m km mi ft in mg g kg lb oz t ml cl l s min h sec hr hrs hour hours day days week weeks month months year years mph kmh usd eur dollars euros cents percent degrees".split()
NUMBER, NAME, UNIT = (mixed(np.array([i], np.uint64))[0] for i in (1, 2, 3))
#: Up to so many windows of the benchmark are looked up in each task; beyond, all windows go through the join.
LOOKUP = 2_000_000
#: Shorter items are only matched literally, as a whole, and only if asked for.
SHORTEST = 5
#: Number of readings of a text, and the places of the one without placeholders and of the one whose names may open a sentence.
FORMS, LITERAL, OPENED = 4, 2, 3


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    out = np.zeros(len(start), np.uint64)
    for i in range(0, len(start), 1 << 16):
        s, e = start[i : i + (1 << 16)], end[i : i + (1 << 16)]
        out[i : i + (1 << 16)] = ranges(sums(TABLE[data[s[0] : e[-1]]]), s - s[0], e - s[0])
    return out


UNIT_HASHES = np.sort([word_hashes(np.frombuffer(u.encode(), np.uint8), np.array([0]), np.array([len(u)]))[0] for u in UNITS])


class Template:
    """A text as tokens: runs of letters or of digits (with points and commas between digits).

    ``forms`` are canonical readings: numbers, names (capital inside a sentence) and units (after a number) replaced by
    typed placeholders; only numbers replaced, for texts whose case says nothing; nothing replaced; and, as in the first,
    but words that open a sentence with a capital are names too. ``slots`` marks the placeholders of each form,
    ``number`` the numbers.
    """

    def __init__(self, raw: bytes):
        self.raw = raw
        data = np.frombuffer(raw, np.uint8)
        digit = (data >= 48) & (data <= 57)
        lower = np.frombuffer(raw.translate(LOWER), np.uint8)
        letter = ((lower >= 97) & (lower <= 122)) | (data > 127)
        if len(data) > 2:
            joint = ((data == 44) | (data == 46))[1:-1] & digit[:-2] & digit[2:]
            digit[1:-1] |= joint
        kind = digit + 2 * letter
        edge = np.flatnonzero(np.diff(kind, prepend=0, append=0))
        begin, stop = edge[:-1], edge[1:]
        here = kind[begin] > 0 if len(begin) else np.zeros(0, bool)
        self.start, self.end = begin[here], stop[here]
        n = len(self.start)
        if not n:
            self.forms = [(np.zeros(0, np.uint64), np.zeros(0, bool))] * FORMS
            self.number = np.zeros(0, bool)
            return
        self.number = number = kind[self.start] == 1
        literal = word_hashes(lower, self.start, self.end)
        ends = np.cumsum((data == 46) | (data == 33) | (data == 63) | (data == 10))
        opens = np.concatenate(([True], ends[self.start[1:]] != ends[self.end[:-1] - 1]))
        first = data[self.start]
        capital = (first >= 65) & (first <= 90)
        name = capital & ~opens
        unit = np.concatenate(([False], number[:-1])) & np.isin(literal, UNIT_HASHES)
        plain = np.where(number, NUMBER, literal)
        typed = np.where(unit, UNIT, np.where(name, NAME, plain))
        opened = np.where(unit, UNIT, np.where(capital, NAME, plain))
        self.forms = [(typed, number | name | unit), (plain, number), (literal, np.zeros(n, bool)), (opened, number | capital | unit)]

    def windows(self, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Of each form: its number, window hashes, which windows count, the slots.

        Windows with placeholders need enough literal words. Those of too many numbers count in the literal form, and
        so do all of fewer than ``SHORTEST`` tokens; any other literal copy is found in the second form.
        """
        for i, (x, slot) in enumerate(self.forms):
            if size < SHORTEST and i != LITERAL:
                continue
            h = rolling(x, size)
            if len(h):
                held = np.concatenate(([0], np.cumsum(self.number if i == LITERAL else slot)))
                few = held[size:] - held[:-size] <= size // 2
                fit = few if i != LITERAL else ~few if size >= SHORTEST else np.ones(len(h), bool)
                yield i, mixed(h + np.uint64(size * 4 + i)), fit, slot

    def values(self, at: int, size: int, slot: np.ndarray) -> list[str]:
        """What fills the slots of a window, each with its place in it."""
        return [f"{i}:{self.raw[self.start[at + i] : self.end[at + i]].decode('utf-8', 'replace').lower()}" for i in np.flatnonzero(slot[at : at + size])]


def window_rows(sizes: list[int] | None, size: int, wanted: np.ndarray | None, shortest: int = SHORTEST):
    """``_key``, ``t1``, ``t2``, ``n`` (tokens), ``h``, ``at``, ``size``, ``opened`` (form), ``slots`` of the windows.

    ``sizes``: window lengths to take, or ``None`` for ``size`` or the whole text if that is shorter (``shortest`` at least).
    ``wanted``: sorted hashes to keep, or ``None`` for all.
    """
    names = ["_key", "t1", "t2", "n", "h", "at", "size", "opened", "slots"]
    kinds = [None, pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.list_(pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rough = None
        if wanted is not None:
            rough = np.zeros(1 << 20, bool)
            rough[(wanted >> np.uint64(44)).astype(np.int64)] = True

        def batch_of(rows: list[tuple], key: pa.DataType) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t or key) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            rows: list[tuple] = []
            key = batch.schema.field("_key").type
            for name, raw, t1, t2 in zip(batch.column("_key").to_pylist(), batch.column("raw"), batch.column("t1").to_pylist(), batch.column("t2").to_pylist(), strict=True):
                t = Template(raw.as_py())
                n = len(t.start)
                for w in sizes if sizes is not None else [min(size, n)] * (n >= max(shortest, 1)):
                    for i, h, fit, slot in t.windows(w):
                        if rough is not None:
                            at = np.flatnonzero(rough[(h >> np.uint64(44)).astype(np.int64)] & fit)
                            j = np.minimum(np.searchsorted(wanted, h[at]), len(wanted) - 1)
                            at = at[wanted[j] == h[at]]
                        else:
                            at = np.flatnonzero(fit)
                        for p in at.tolist():
                            rows.append((name, t1, t2, n, int(h[p].view(np.int64)), p, w, i == OPENED, t.values(p, w, slot)))
                            if len(rows) >= 50_000:
                                yield batch_of(rows, key)
                                rows = []
            if rows:
                yield batch_of(rows, key)

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, size: int = 8, run: int = 13, share: float = 0.5, key: str = "doc_id", item: str = "item_id", text: str = "text", lookup: int = LOOKUP, shortest: int = SHORTEST) -> DataFrame:
    """Leaked items of each document: ``key``, ``item``, ``matched`` (tokens of the item), ``longest`` (in a row),
    ``covered`` (share of the item) and ``changed`` (slots filled with other values).

    Texts become templates (:class:`Template`); windows of ``size`` tokens (the whole item if shorter, at least
    ``shortest`` tokens) with no more than half of them slots are joined by hash, those of more numbers, and items of
    fewer than five tokens, literally. A window counts if the values of the item's slots
    turn one to one into those of the document; and so must all windows that lie on one alignment of item and
    document (those in which names may open a sentence apart from the others), else only its windows with equal values count. An item leaks into a document if ``run`` tokens in a row
    or the ``share`` of its tokens are matched.

    Windows of the benchmark are looked up inside the scan if there are at most ``lookup`` of them, else all windows of
    the documents go through the join; rows are the same. Null and empty texts match nothing, and so do items of fewer
    than ``shortest`` tokens. Repeated documents, or items, give repeated rows only once for each pair of keys. Empty
    tables give an empty result; only the key and ``text`` of either table are read.
    """
    spark = docs.sparkSession
    kinds = [t.schema[k].dataType.simpleString() for t, k in ((docs, key), (benchmark, item))]
    shape = "t1 long, t2 long, n int, h long, at int, size int, opened boolean, slots array<string>"

    def read(df: DataFrame, name: str) -> DataFrame:
        return identified(df.select(F.col(name).alias("_key"), F.col(text).alias("_text")), "_text").select("_key", "raw", "t1", "t2")

    items = read(benchmark, item).mapInArrow(window_rows(None, size, None, shortest), f"_key {kinds[1]}, {shape}")
    sizes = sorted(r[0] for r in items.select("size").distinct().collect())  # at most `size` values
    hashes = items.select("h").distinct()
    wanted = None
    if hashes.count() <= lookup:
        wanted = np.sort(np.array([r[0] for r in hashes.toLocalIterator()], np.int64).view(np.uint64))
        if not len(wanted):
            sizes = []
    shared = spark.sparkContext.broadcast(wanted)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return window_rows(sizes, size, shared.value)(batches)

    found = read(docs, key).mapInArrow(scan, f"_key {kinds[0]}, {shape}")
    left = found.select(F.col("_key").alias("_doc"), "t1", "t2", "h", F.col("at").alias("_at"), "size", "opened", F.col("slots").alias("_filled"))
    right = items.select(F.col("_key").alias("_item"), F.col("t1").alias("_i"), "n", "h", "at", "slots")
    pairs = F.expr("transform(sequence(1, size(slots)), i -> struct(substring_index(slots[i - 1], ':', -1) AS a, substring_index(_filled[i - 1], ':', -1) AS b))")
    pairs = F.when(F.size("slots") > 0, pairs).otherwise(F.expr("cast(array() as array<struct<a:string,b:string>>)"))
    hits = left.join(right, "h").where(F.size("slots") == F.size("_filled")).withColumn("_pairs", F.array_distinct(pairs))
    hits = hits.withColumn("_same", F.forall("_pairs", lambda p: p["a"] == p["b"]))

    def one_to_one(p: str) -> F.Column:
        return (F.size(p) == F.size(F.array_distinct(F.transform(p, lambda x: x["a"])))) & (F.size(p) == F.size(F.array_distinct(F.transform(p, lambda x: x["b"]))))

    hits = hits.where(F.col("_same") | one_to_one("_pairs"))
    place = ["_doc", "t1", "t2", "_item", "_i", "n"]
    # lists below hold no more than the tokens of one item
    # the form whose names may open a sentence is judged by itself, so that an opening word never unsettles the others
    lines = hits.groupBy(*place, "opened", (F.col("_at") - F.col("at")).alias("_shift")).agg(
        F.array_distinct(F.flatten(F.collect_set("_pairs"))).alias("_pairs"),
        F.collect_set(F.struct("at", "size")).alias("_all"),
        F.collect_set(F.when(F.col("_same"), F.struct("at", "size"))).alias("_equal"),
    )
    lines = lines.withColumn("_good", one_to_one("_pairs")).select(
        *place, F.when(F.col("_good"), F.col("_all")).otherwise(F.col("_equal")).alias("_windows"), (F.col("_good") & F.exists("_pairs", lambda p: p["a"] != p["b"])).alias("changed")
    )
    lines = lines.withColumn("_tokens", F.flatten(F.transform("_windows", lambda w: F.sequence(w["at"], w["at"] + w["size"] - 1))))
    whole = lines.groupBy(*place).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("_tokens")))).alias("_tokens"), F.max("changed").alias("changed"))
    longest = F.aggregate(
        "_tokens",
        F.struct(F.lit(-2).alias("last"), F.lit(0).alias("now"), F.lit(0).alias("best")),
        lambda s, x: F.struct(
            x.alias("last"),
            F.when(x == s["last"] + 1, s["now"] + 1).otherwise(F.lit(1)).alias("now"),
            F.greatest(s["best"], F.when(x == s["last"] + 1, s["now"] + 1).otherwise(F.lit(1))).alias("best"),
        ),
        lambda s: s["best"],
    )
    out = whole.select("_doc", "_item", F.size("_tokens").alias("matched"), longest.alias("longest"), (F.size("_tokens") / F.col("n")).alias("covered"), "changed")
    out = out.where((F.col("longest") >= run) | (F.col("covered") >= share))
    best = out.groupBy("_doc", "_item").agg(*(F.max(c).alias(c) for c in ("matched", "longest", "covered", "changed")))
    return best.withColumnsRenamed({"_doc": key, "_item": item})


def without_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", item: str = "item_id", text: str = "text", shortest: int = SHORTEST) -> DataFrame:
    """The rows of ``docs``, with all their columns, into which no item leaks."""
    found = leaks(docs, benchmark, key=key, item=item, text=text, shortest=shortest).select(F.col(key).alias("_hit")).distinct()
    return docs.join(found, docs[key].eqNullSafe(F.col("_hit")), "left_anti")
