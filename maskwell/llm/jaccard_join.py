"""Exact Jaccard join of word-shingle sets: size-banded tiles, bitmap bounds, sorted-array intersections."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept
from .components import components
from .repeats import grouped, identified
from .super_kmers import Words
from .winnow import mixed, rolling

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: A block of a tile holds at most so many bytes of sorted arrays and so many sets.
BLOCK_BYTES, BLOCK_SETS = 16 << 20, 2000
#: At least so many segments may stay empty.
SPARE = 2


def shingle_set(raw: bytes, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; of all words as one if there are fewer."""
    h = Words(raw.translate(LOWER)).hashes()
    return np.unique(rolling(h, min(size, len(h)))) if len(h) else h


def set_id(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


class Levels:
    """Sizes in classes ``[least[j], least[j + 1])``, a factor of about 1.4 apart.

    Two sets of Jaccard similarity ``percent`` or more, the smaller of size x, differ in at most
    ``x * (100 - percent) / percent`` elements. Dealt by hash to more segments than that, ``spare`` further ones among
    them, they agree on ``spare + 1`` segments at least. Segments that hold elements are keys. Only if all segments they
    agree on are empty could that miss the pair; then both have more than ``spare`` empty ones, and such a set also has
    its least elements as keys, so many that similar sets share one. No key stands for a lack of elements, so sets
    without a common shingle never meet.
    """

    def __init__(self, percent: int):
        self.percent = percent
        self.least = [1]
        while self.least[-1] < 1 << 40:
            self.least.append(max(self.least[-1] + 8, int(self.least[-1] * 1.4)))
        self.differ = [(m - 1) * (100 - percent) // percent for m in self.least[1:]]
        self.spare = [self._spare(x, d) for x, d in zip(self.least, self.differ, strict=False)]

    @staticmethod
    def _spare(x: int, d: int) -> int:
        """So many that fewer segments are expected to stay empty; ``SPARE`` where up to half of ``d`` are not enough."""
        s = SPARE
        while s < 1.5 * (d + 1 + s) * math.exp(-x / (d + 1 + s)):
            s += max(1, s // 16)
            if 2 * s > d:
                return SPARE
        return s

    def of(self, n: int) -> list[int]:
        """Levels that a set of ``n`` elements takes part in: its own, and the one below if a partner can be there."""
        j = int(np.searchsorted(self.least, n, "right")) - 1
        return [j - 1, j] if j and n * self.percent <= (self.least[j] - 1) * 100 else [j]

    def keys(self, s: np.ndarray) -> np.ndarray:
        out = []
        for j in self.of(len(s)):
            d = self.differ[j]
            spare = self.spare[j] if d else 0
            g = d + 1 + spare
            segment = ((s >> np.uint64(32)) * np.uint64(g)) >> np.uint64(32)
            at = np.flatnonzero(np.concatenate(([True], segment[1:] != segment[:-1])))
            total = np.add.reduceat(mixed(s * np.uint64(0x9FB21C651E98DF25)), at)
            name = np.uint64(j) << np.uint64(32)
            out.append(mixed(total + (segment[at] + name + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)))
            if g - len(at) > spare:
                ranked = np.sort(mixed(s * np.uint64(0xD1342543DE82EF95)))
                shared = -(-len(s) * self.percent // 100)
                out.append(mixed(ranked[: len(s) - shared + 1] ^ mixed(np.full(1, name + np.uint64(1)))))
        return np.concatenate(out)


def bit_rows(s: np.ndarray) -> np.ndarray:
    """The bitmap of a set: a power of two of bits, two to four for each element."""
    bits = 1 << min(16, max(7, (2 * len(s)).bit_length()))
    flags = np.zeros(bits, bool)
    flags[((s >> np.uint64(20)) & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(flags)


def set_rows(size: int, key_type: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, ids, maps = [], [], []
            for raw in batch.column("raw"):
                s = shingle_set(raw.as_py(), size)
                n.append(len(s))
                ids.append(set_id(s))
                maps.append(bit_rows(s).tobytes())
            d = np.frombuffer(b"".join(ids), np.int64).reshape(-1, 2)
            cols = [batch.column("_key"), pa.array(n, pa.int64()), pa.array(d[:, 0]), pa.array(d[:, 1]), batch.column("t1"), batch.column("t2"), pa.array(maps, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["_key", "n", "s1", "s2", "t1", "t2", "bits"])

    return run


def segment_rows(size: int, percent: int):
    """``h``, ``s1``: the segments of every set, once for each set of a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, seen = Levels(percent), set()
        keys: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        rows = 0

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(ids))], names=["h", "s1"])
            keys.clear()
            ids.clear()
            return out

        for batch in batches:
            for raw in batch.column("raw"):
                s = shingle_set(raw.as_py(), size)
                name = set_id(s)
                if not len(s) or name in seen:
                    continue
                seen.add(name)
                k = levels.keys(s)
                keys.append(k)
                ids.append(np.full(len(k), np.frombuffer(name, np.int64)[0]))
                rows += len(k)
                if rows >= 200_000:
                    yield flush()
                    rows = 0
        if rows:
            yield flush()

    return run


def star_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in the order of ``h, s1``: each further set of a segment with the segment's first set."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        h, s1 = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("h", "s1"))
        if last is not None:
            h, s1 = (np.concatenate(([x], y)) for x, y in zip(last[:2], (h, s1), strict=True))
        new = np.concatenate(([True], h[1:] != h[:-1]))
        other = np.concatenate(([False], s1[1:] != s1[:-1]))
        at = np.flatnonzero(new)
        first = s1[at][np.cumsum(new) - 1]
        if last is not None:  # the first row went out before; its group began with last[2]
            end = at[1] if len(at) > 1 else len(h)
            first[:end] = last[2]
        keep = other & ~new
        last = (h[-1], s1[-1], first[-1])
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(s1[keep]), pa.array(first[keep])], names=["a", "b"])


def array_rows(size: int):
    """The sorted arrays; once for each set of a partition, where all copies of a text meet unless a skewed join splits them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            new = []
            for i, rid in enumerate(batch.column("rid").to_pylist()):
                if rid not in seen:
                    seen.add(rid)
                    new.append(i)
            batch = batch.take(pa.array(new, pa.int64()))
            arrays = pa.array([shingle_set(raw.as_py(), size).tobytes() for raw in batch.column("raw")], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("cluster"), batch.column("rid"), batch.column("n"), arrays], names=["cluster", "rid", "n", "items"])

    return run


def bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    bits = 1 << min(16, max(7, (2 * max(map(len, sets))).bit_length()))
    out = np.zeros((len(sets), bits // 8), np.uint8)
    for row, s in zip(out, sets, strict=True):
        flags = np.zeros(bits, bool)
        flags[((s >> np.uint64(20)) & np.uint64(bits - 1)).astype(np.int64)] = True
        row[:] = np.packbits(flags)
    return out.view(np.uint64)


def folded(maps: np.ndarray, width: int) -> np.ndarray:
    """Bitmaps of more bits at the width of smaller ones; an element's place is given by the low bits of its hash."""
    return np.bitwise_or.reduce(maps.reshape(len(maps), -1, width), axis=1)


def possible(n: np.ndarray, maps: list[bytes], side: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
    """Pairs of a tile that their bitmaps do not rule out, as far as they join parts that are not joined yet."""
    order = np.argsort(n, kind="stable")
    n, side = n[order], side[order]
    rows = [np.frombuffer(maps[i], np.uint64) for i in order]
    widths = np.array([len(r) for r in rows])
    stacks = {int(w): (int(np.searchsorted(widths, w)), np.stack(rows[np.searchsorted(widths, w) : np.searchsorted(widths, w, "right")])) for w in np.unique(widths)}
    narrow: dict[tuple[int, int], np.ndarray] = {}
    part = np.arange(len(n))
    for x in range(len(n) - 1):
        end = int(np.searchsorted(n, n[x] * 100 // percent, "right"))
        for w, (start, stack) in stacks.items():
            lo, hi = max(start, x + 1), min(start + len(stack), end)
            if lo >= hi:
                continue
            own_width = int(widths[x])
            if w != own_width and (w, own_width) not in narrow:
                narrow[w, own_width] = folded(stack, own_width)
            block = (stack if w == own_width else narrow[w, own_width])[lo - start : hi - start]
            ys = np.flatnonzero((part[lo:hi] != part[x]) & ((side[lo:hi] == 0) | (side[lo:hi] != side[x])))
            if not len(ys):
                continue
            theirs = block[ys]
            both = np.bitwise_count(rows[x] & theirs).sum(axis=1, dtype=np.int64)
            own = np.bitwise_count(rows[x]).sum(dtype=np.int64) - both
            their = np.bitwise_count(theirs).sum(axis=1, dtype=np.int64) - both
            ys = ys + lo
            most = np.minimum(n[x] - own, n[ys] - their)
            for y in ys[(100 + percent) * most >= percent * (n[x] + n[ys])]:
                if part[y] != part[x]:
                    part[part == part[y]] = part[x]
                    yield int(order[x]), int(order[y])


def linked(sets: list[np.ndarray], sides: list[int], percent: int) -> Iterator[tuple[int, int]]:
    """Links of a tile, as far as they join parts that are not joined yet. Sides 1 and 2 only meet each other."""
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    sets = [sets[i] for i in order]
    side = np.array([sides[i] for i in order])
    n = np.array([len(s) for s in sets])
    maps = bitmaps(sets)
    part = np.arange(len(sets))
    for x in range(len(sets) - 1):
        end = np.searchsorted(n, n[x] * 100 // percent, "right")
        ys = np.arange(x + 1, end)
        ys = ys[(part[ys] != part[x]) & ((side[ys] == 0) | (side[ys] != side[x]))]
        if not len(ys):
            continue
        own = np.bitwise_count(maps[x] & ~maps[ys]).sum(axis=1, dtype=np.int64)
        their = np.bitwise_count(maps[ys] & ~maps[x]).sum(axis=1, dtype=np.int64)
        most = np.minimum(n[x] - own, n[ys] - their)
        for y in ys[(100 + percent) * most >= percent * (n[x] + n[ys])]:
            if part[y] == part[x]:
                continue
            both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
            if 100 * both >= percent * (n[x] + n[y] - both):
                part[part == part[y]] = part[x]
                yield order[x], order[y]


def pair_batch(rows: list[tuple], found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([rows[x][2] for x, _ in found], pa.int64()), pa.array([rows[y][2] for _, y in found], pa.int64())], names=["a", "b"])


def possible_rows(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in grouped(batches, ("tile", "side", "rid", "n", "items")):
            found = list(possible(np.array([r[3] for r in rows], np.int64), [r[4] for r in rows], np.array([r[1] for r in rows]), percent))
            if found:
                yield pair_batch(rows, found)

    return run


def link_rows(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in grouped(batches, ("tile", "side", "rid", "items")):
            rows = [r for i, r in enumerate(rows) if not i or r[2] != rows[i - 1][2]]
            found = list(linked([np.frombuffer(r[3], np.uint64) for r in rows], [r[1] for r in rows], percent))
            if found:
                yield pair_batch(rows, found)

    return run


def tiles(arrays: DataFrame, percent: int) -> DataFrame:
    """Deals the sets of each cluster to tiles: ``tile``, ``side``, ``rid``, ``n``, ``items`` (bitmaps or sorted arrays).

    A small cluster is one tile. A larger one is cut into bands of sizes, a factor of ``100 / percent`` wide, and bands
    into blocks by hash; blocks of one band or of neighbouring bands meet in a tile each.
    """
    sized = arrays.withColumn("band", F.expr(f"cast(floor(ln(n) / ln(100 / {percent}.0) + 1e-9) as int)"))
    blocks = F.greatest(F.ceil(F.sum(F.octet_length("items")) / BLOCK_BYTES), F.ceil(F.count("*") / BLOCK_SETS)).cast("int")
    bands = sized.groupBy("cluster", "band").agg(blocks.alias("k"), F.sum(F.octet_length("items")).alias("_b"), F.count("*").alias("_m"))
    total = bands.groupBy("cluster").agg(((F.sum("_b") <= BLOCK_BYTES) & (F.sum("_m") <= BLOCK_SETS)).alias("small"))
    small = sized.join(total.where("small"), "cluster").select(F.concat_ws("/", "cluster").alias("tile"), F.lit(0).alias("side"), "rid", "n", "items")
    bands = bands.join(total.where("not small").select("cluster"), "cluster").select("cluster", "band", "k")
    upper = bands.select("cluster", (F.col("band") - 1).alias("band"), F.col("k").alias("above"))
    lower = bands.select("cluster", (F.col("band") + 1).alias("band"), F.col("k").alias("below"))
    bands = bands.join(upper, ["cluster", "band"], "left").join(lower, ["cluster", "band"], "left")
    own = sized.join(bands, ["cluster", "band"]).withColumn("r", F.expr("pmod(xxhash64(rid), k)"))
    places = """concat(
      transform(sequence(0, k - 1), x -> struct(concat_ws('/', cluster, band, least(x, r), band, greatest(x, r)) AS tile,
                                                case when x = r then 0 when r < x then 1 else 2 end AS side)),
      if(above is null, array(), transform(sequence(0, above - 1), x -> struct(concat_ws('/', cluster, band, r, band + 1, x) AS tile, 1 AS side))),
      if(below is null, array(), transform(sequence(0, below - 1), x -> struct(concat_ws('/', cluster, band - 1, x, band, r) AS tile, 2 AS side))))"""
    large = own.select(F.explode(F.expr(places)).alias("p"), "rid", "n", "items").select("p.tile", "p.side", "rid", "n", "items")
    return small.unionByName(large)


def join(docs: DataFrame, size: int = 3, percent: int = 90, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_shingles`` and ``component_id`` (smallest key reachable by links) for each row of ``docs``.

    A-Z are lower-cased; a document's set holds its distinct ``size``-word shingles (with fewer words, all words as
    one). Documents link when ``100 * shared >= percent * union``. Steps:

    1. Equal sets are one set, known by the smallest key that has it.
    2. Sets are dealt into segments by hash, so many that linked sets agree on one (:class:`Levels`). Sets that share a
       segment belong to one cluster; the others can have no link.
    3. Each cluster is a tile of pairs, or many size-banded ones. First only the bitmaps of the sets meet in the tiles:
       the counts of bits that one of two has alone bound the overlap from above, and clusters fall apart into what is
       left of them.
    4. The sorted arrays of these parts are dealt to tiles in the same way, and the pairs that the bound lets pass,
       unless already joined, are intersected exactly.
    5. Components of the links.

    Null, empty and blank texts have an empty set, link with nothing and keep their own key as component. A null key
    counts as a key above all others; a component of null keys alone is null. Repeated rows are in one component; a key
    may name several texts, each row then has the component of its own text. Very long texts are read whole. An empty table gives an empty result; only ``key`` and ``text`` are read.
    """
    kind = docs.schema[key].dataType.simpleString()
    texts = identified(docs.select(F.col(key).cast("long").alias("_key"), F.col(text).alias("_text")), "_text").select("_key", "raw", "t1", "t2")
    rows = kept(texts.mapInArrow(set_rows(size, kind), "_key long, n long, s1 long, s2 long, t1 long, t2 long, bits binary"), "sets")
    sets = rows.where("n > 0").groupBy("s1", "s2").agg(F.min("_key").alias("least"), *(F.first(x).alias(x) for x in ("n", "t1", "t2", "bits")))
    # numbered once and stored: keys may be null or name several sets
    sets = kept(sets.withColumn("rid", F.monotonically_increasing_id()), "reps")
    segments = texts.select("raw").mapInArrow(segment_rows(size, percent), "h long, s1 long")
    stars = segments.repartition("h").sortWithinPartitions("h", "s1").mapInArrow(star_rows, "a long, b long")
    clusters = components(kept(stars.distinct(), "stars")).select(F.col("v").alias("s1"), F.col("c").alias("cluster"))
    met = sets.join(clusters, "s1").select("cluster", "rid", "n", F.col("bits").alias("items"))
    dealt = tiles(met, percent).repartition("tile").sortWithinPartitions("tile", "rid")
    clusters = components(dealt.mapInArrow(possible_rows(percent), "a long, b long"))
    wanted = sets.select("t1", "t2", "rid", "n").join(clusters.select(F.col("v").alias("rid"), F.col("c").alias("cluster")), "rid")
    one_each = texts.select("t1", "t2", "raw").join(wanted, ["t1", "t2"]).select("cluster", "rid", "n", "raw")
    arrays = kept(one_each.mapInArrow(array_rows(size), "cluster long, rid long, n long, items binary"), "arrays")
    dealt = tiles(arrays, percent).repartition("tile").sortWithinPartitions("tile", "rid")
    parts = components(dealt.mapInArrow(link_rows(percent), "a long, b long"))
    named = sets.select("s1", "s2", "rid", "least").join(parts.select(F.col("v").alias("rid"), F.col("c")), "rid", "left")
    named = named.select("s1", "s2", F.coalesce("c", "rid").alias("_c"), "least")
    named = named.join(named.groupBy("_c").agg(F.min("least").alias("_first")), "_c").select("s1", "s2", "_first")
    component = F.when(F.col("n") > 0, F.col("_first")).otherwise(F.col("_key"))
    return rows.join(named, ["s1", "s2"], "left").select(F.col("_key").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"))
