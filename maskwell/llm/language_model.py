"""A log-bilinear language model, trained in numpy by noise-contrastive estimation, and a smoothed unigram base."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, fields
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, kept
from .jaccard_join import LOWER
from .winnow import byte_values, mixed, ranges, sums

FOLDS, HELD_OUT = 7, 2
#: Outcomes of each decision on the way to a word; the least number of the model's own words. All others share the last.
BRANCH = 32
LEAST = 4096
#: Words of so many training tokens are the model's own, beyond the least number; decisions grow with the logarithm.
OWN = 5
WIDTH, CONTEXT = 16, 2
#: So many tokens, the most frequent ones, are looked up inside tasks; the rest is joined.
HEAD = 1_000_000
BATCH, NOISE = 16_384, 24
#: Places and nodes handled at once, so that their rows stay in the cache; tokens scored and words hashed at once.
PLACES, NODES, STEP, HASHED = 8192, 256, 65_536, 1 << 14
#: Nodes with so many places are handled one by one, without copies of their places.
LARGE = 1024
#: Numbers in a row of parameters: a word's as context and as outcome.
ROW = 2 * WIDTH + 1
END = mixed(np.array([0x1234567], np.uint64))[0]


TABLE = byte_values()
IN_WORD = ~np.isin(np.arange(256), [32, *range(9, 14)])


def sequences(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of several texts in a row, each with its end, and where each text begins."""
    data = np.frombuffer(b" ".join(raws).translate(LOWER), np.uint8)
    word = np.zeros(len(data) + 2, bool)
    word[1:-1] = IN_WORD[data]
    edges = np.flatnonzero(word[1:] != word[:-1])
    start, end = edges[::2], edges[1::2]
    behind = np.searchsorted(start, np.cumsum([len(raw) + 1 for raw in raws]))
    ends = behind + np.arange(len(raws))
    out = np.empty(len(start) + len(raws), np.uint64)
    words = np.ones(len(out), bool)
    words[ends], out[ends] = False, END
    h = np.empty(len(start), np.uint64)
    for i in range(0, len(h), HASHED):
        s, e = start[i : i + HASHED], end[i : i + HASHED]
        h[i : i + HASHED] = ranges(sums(TABLE[data[s[0] : e[-1]]]), s - s[0], e - s[0])
    out[words] = h
    return out, np.append(0, ends[:-1] + 1)


def count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            h, c = np.unique(np.concatenate([sequences(raws)[0] for _, _, raws in chunks(batch)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], names=["h", "c"])


class Sorted:
    """Sorted hashes and where each value of their leading bits begins, about one hash for each."""

    def __init__(self, h: np.ndarray):
        bits = max(1, len(h).bit_length())
        self.h, self.shift = np.append(h, np.uint64(2**64 - 1)), np.uint64(64 - bits)
        self.first = np.zeros(1 << bits, np.int32)
        np.cumsum(np.bincount((h >> self.shift).astype(np.int64), minlength=1 << bits)[:-1], out=self.first[1:])

    def find(self, h: np.ndarray) -> np.ndarray:
        """What ``np.searchsorted`` gives, but at most the last place."""
        at = self.first[h >> self.shift]
        left = np.flatnonzero(self.h[at] < h)
        while len(left):
            at[left] += 1
            left = left[self.h[at[left]] < h[left]]
        return np.minimum(at, len(self.h) - 2)


@dataclass
class Vocabulary:
    """``head``: sorted hashes of the most frequent tokens; ``counts`` and ``ids`` (of the model) beside them; ``own``:
    sorted hashes of the model's words with ``own_ids``; ``word_counts`` by id; ``total``, ``types``: N and V."""

    head: np.ndarray
    counts: np.ndarray
    ids: np.ndarray
    own: np.ndarray
    own_ids: np.ndarray
    word_counts: np.ndarray
    total: int
    types: int

    @property
    def other(self) -> int:
        return len(self.word_counts) - 1

    @cached_property
    def sorted_head(self) -> Sorted:
        return Sorted(self.head)

    @cached_property
    def sorted_own(self) -> Sorted:
        return Sorted(self.own)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Model id and count of each token; count -1 for tokens outside the head."""
        if not len(self.head):
            return np.full(len(h), self.other), np.full(len(h), -1)
        i = self.sorted_head.find(h)
        hit = self.head[i] == h
        return np.where(hit, self.ids[i], self.other), np.where(hit, self.counts[i], -1)

    def model_ids(self, h: np.ndarray) -> np.ndarray:
        i = self.sorted_own.find(h)
        return np.where(self.own[i] == h, self.own_ids[i], self.other)


def vocabulary(counts: DataFrame, head: int = HEAD) -> Vocabulary:
    """``counts``: ``h``, ``c``. The head is cut at a count, so that it never depends on the order of equal counts."""
    total, types = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    cut = 1
    if types > head:
        # rows by power of two of the count, then by count inside the power that crosses the bound: few values each
        power = F.floor(F.log2("c")).cast("int")
        above, low = 0, 0
        for p, n in counts.groupBy(power.alias("p")).count().orderBy(F.desc("p")).collect():
            if above + n > head:
                low = p
                break
            above += n
        step = max(1, (1 << low) // 1024)
        cut = 1 << (low + 1)
        for b, n in counts.where(power == low).groupBy(F.floor((F.col("c") - (1 << low)) / step).cast("long").alias("b")).count().orderBy(F.desc("b")).collect():
            if above + n > head:
                break
            above += n
            cut = (1 << low) + b * step
    top = counts.where(F.col("c") >= cut).toArrow()  # at most `head` rows of two numbers
    h, c = top["h"].to_numpy().view(np.uint64), top["c"].to_numpy()
    order = np.argsort(h)
    h, c = h[order], c[order]
    m = max(LEAST, (int((c >= OWN).sum()) // BRANCH + 1) * BRANCH)
    own = np.lexsort((h, -c))[: m - 1]
    ids = np.full(len(h), m - 1, np.int64)
    ids[own] = np.arange(len(own))
    word_counts = np.zeros(m)
    word_counts[: len(own)] = c[own]
    word_counts[-1] = total - c[own].sum() + types - len(own) + 1
    sorted_own = np.sort(own)
    names, own_ids = (h[sorted_own], ids[sorted_own]) if len(own) else (np.zeros(1, np.uint64), np.array([m - 1]))
    return Vocabulary(h, c, ids, names, own_ids, word_counts, int(total), int(types))


def by_value(x: np.ndarray) -> np.ndarray:
    """The places of small numbers, sorted by number, equal ones in their order."""
    bits = len(x).bit_length()
    return np.sort(x << bits | np.arange(len(x))) & ((1 << bits) - 1)


def runs(group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray | slice]]:
    """Sorted groups with about equally many places: the groups, and the places as one row for each.

    Rows are filled up, by a quarter at most, with the place behind the last one. Large groups come alone, as a slice.
    """
    first = np.flatnonzero(np.diff(group, prepend=-1))
    sizes = np.diff(np.append(first, len(group)))
    large = sizes >= LARGE
    for a, n in zip(first[large].tolist(), sizes[large].tolist(), strict=True):
        yield group[a : a + 1], slice(a, a + n)
    first, sizes = first[~large], sizes[~large]
    grain = 1 << np.maximum(np.frexp(sizes)[1] - 3, 0)
    rounded = -(-sizes // grain) * grain
    for n in np.unique(rounded):
        which = np.flatnonzero(rounded == n)
        most = max(1, min(NODES, PLACES // int(n)))
        for i in range(0, len(which), most):
            part = which[i : i + most]
            reach = np.arange(n)
            yield group[first[part]], np.where(reach < sizes[part, None], first[part, None] + reach, len(group))


class LogBilinear:
    """Predicted vector ``sum over j of q[context j] @ C[j]``; it decides by inner products and biases among ``BRANCH``
    outcomes at each node of a tree whose leaves are the words by falling frequency."""

    def __init__(self, word_counts: np.ndarray):
        rng = np.random.default_rng(7)
        m = len(word_counts)
        f = np.float32
        self.q = rng.standard_normal((m, WIDTH), f)
        self.q *= f(0.1)
        self.c = np.stack([np.eye(WIDTH) + rng.normal(0, 0.05, (WIDTH, WIDTH)) for _ in range(CONTEXT)]).astype(f)
        mass = [np.maximum(word_counts, 0.5).reshape(-1, BRANCH)]
        while len(mass[0]) > 1:
            up = mass[0].sum(axis=1)
            mass.insert(0, np.pad(up, (0, -len(up) % BRANCH)).reshape(-1, BRANCH))
        # from the root to the words: shares of the outcomes, how many words lie below one, weights and biases
        shares = [np.maximum(x / x.sum(axis=1, keepdims=True), 1e-12).astype(f) for x in mass]
        self.below = [BRANCH**i for i in reversed(range(len(mass)))]
        self.noise = [NOISE * x for x in shares]
        self.log_noise = [np.log(x) for x in self.noise]
        # a node's weights lie outcome beside outcome, as its products need them
        self.tables = [np.zeros((len(x), WIDTH + 1, BRANCH), f) for x in shares]
        for t, x in zip(self.tables, shares, strict=True):
            t[:, WIDTH] = np.log(x)

    def params(self) -> list[np.ndarray]:
        return [self.q, self.c, *self.tables]

    def state(self) -> list[np.ndarray]:
        """What AdaGrad sums up: squared slopes by row."""
        return [np.ones(n, np.float32) for n in (len(self.q), self.c.shape[:-1], *((len(t), BRANCH) for t in self.tables))]

    def rows(self, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number, tokens and values of each row of parameters with tokens; ``seen``: the tokens of each word."""
        ids = np.arange(len(seen))
        weights = [np.full(CONTEXT * WIDTH, seen.sum())]
        weights += [np.bincount(ids // b, seen, t.shape[0] * BRANCH) for t, b in zip(self.tables[:-1], self.below, strict=False)]
        inner, words = np.concatenate(weights), np.flatnonzero(seen)
        met = np.flatnonzero(inner)
        rows = [self.c.reshape(-1, WIDTH), *(t.transpose(0, 2, 1).reshape(-1, WIDTH + 1) for t in self.tables[:-1])]
        values = np.concatenate([np.pad(v, ((0, 0), (0, ROW - v.shape[1]))) for v in rows])[met]
        own = np.concatenate([self.q[words], self.tables[-1][words // BRANCH, :, words % BRANCH]], axis=1)
        return np.append(met, words + len(inner)), np.append(inner[met], seen[words]), np.concatenate([values, own])

    def load(self, at: np.ndarray, values: np.ndarray) -> None:
        """Takes over rows by number; the others stay as they are."""
        flat, base = self.c.reshape(-1, WIDTH), CONTEXT * WIDTH
        s = slice(0, np.searchsorted(at, base))
        flat[at[s]] = values[s, :WIDTH]
        for t in self.tables[:-1]:
            s = slice(*np.searchsorted(at, [base, base + len(t) * BRANCH]))
            t[(at[s] - base) // BRANCH, :, (at[s] - base) % BRANCH] = values[s, : WIDTH + 1]
            base += len(t) * BRANCH
        words, values = at[s.stop :] - base, values[s.stop :]
        self.q[words] = values[:, :WIDTH]
        self.tables[-1][words // BRANCH, :, words % BRANCH] = values[:, WIDTH:]

    @staticmethod
    def contexts(ids: np.ndarray, start: np.ndarray, end_id: int) -> list[np.ndarray]:
        """The tokens before each one; before a text stand ends."""
        out = []
        for j in range(1, CONTEXT + 1):
            x = np.full(len(ids), end_id)
            x[j:] = ids[:-j]
            for k in range(j):
                at = start + k
                x[at[at < len(ids)]] = end_id
            out.append(x)
        return out

    def learn(self, ids: np.ndarray, contexts: list[np.ndarray], state: list[np.ndarray], rate: float) -> None:
        """A pass over the tokens in batches, with steps by AdaGrad on the rows that a batch meets, one rate a row."""

        def step(p: np.ndarray, s: np.ndarray, at, old: np.ndarray, g: np.ndarray, axis: int = -1) -> None:
            s[at] += np.einsum("...i,...i->..." if axis == -1 else "...ij,...ij->...j", g, g) / g.shape[axis]
            g *= np.expand_dims(rate / np.sqrt(s[at]), axis)
            p[at] = np.subtract(old, g, out=g)

        for a in range(0, len(ids), BATCH):
            x = ids[a : a + BATCH]
            order = by_value(x)
            x = x[order]
            ctx = [c[a : a + BATCH][order] for c in contexts]
            gathered = [self.q.take(c, axis=0) for c in ctx]
            r, back = inputs(sum(g @ self.c[j] for j, g in enumerate(gathered))), np.zeros((len(x) + 1, WIDTH), np.float32)
            level = np.zeros_like(back)
            for table, noise, logs, below, s in zip(self.tables, self.noise, self.log_noise, self.below, state[2:], strict=True):
                node = x // below
                target = np.append(node % BRANCH, 0)
                for group, at in runs(node // BRANCH):
                    w, here = table.take(group, axis=0), rows_at(r, at)
                    spread = contrast(here @ w, rows_at(target, at), noise[group][:, None], logs[group][:, None])
                    level[at] = (spread @ w[:, :WIDTH].transpose(0, 2, 1)).reshape(*target[at].shape, WIDTH)
                    step(table, s, group, w, products(here, spread), -2)
                back += level
            back = back[:-1]
            down = np.concatenate([back @ c.T for c in self.c])
            step(self.c, state[1], slice(None), self.c, np.stack([g.T @ back for g in gathered]))
            ctx = np.concatenate(ctx)
            o = by_value(ctx)
            at = np.flatnonzero(np.diff(ctx[o], prepend=-1))
            rows = ctx[o[at]]
            step(self.q, state[0], rows, self.q.take(rows, axis=0), np.add.reduceat(down.take(o, axis=0), at))

    def log10(self, ids: np.ndarray, contexts: list[np.ndarray]) -> np.ndarray:
        """Normalised log10 probability of each token, by batched matrix products over the nodes on its way."""
        out = np.empty(len(ids), np.float64)
        for a in range(0, len(ids), STEP):
            x = ids[a : a + STEP]
            order = by_value(x)
            x = x[order]
            r, value = inputs(sum(self.q.take(c[a : a + STEP][order], axis=0) @ self.c[j] for j, c in enumerate(contexts))), np.zeros(len(x) + 1)
            for table, below in zip(self.tables, self.below, strict=True):
                node = x // below
                target = np.append(node % BRANCH, 0)
                for group, at in runs(node // BRANCH):
                    own = picked(rows_at(r, at) @ table.take(group, axis=0), rows_at(target, at))
                    value[at] += own.reshape(target[at].shape)
            out[a + order] = value[:-1]
        return out / np.log(10)


def inputs(vectors: np.ndarray) -> np.ndarray:
    """The vectors with a one for the bias, and a row of zeros behind them."""
    r = np.zeros((len(vectors) + 1, WIDTH + 1), np.float32)
    r[:-1, :WIDTH] = vectors
    r[:-1, WIDTH] = 1
    return r


def places(target: np.ndarray) -> np.ndarray:
    """Where the targets lie among the outcomes of all rows, one after the other."""
    return np.arange(0, target.size * BRANCH, BRANCH) + target.reshape(-1)


def rows_at(x: np.ndarray, at: np.ndarray | slice) -> np.ndarray:
    """Values at the places of several groups; those of a group that comes alone are one row, without a copy."""
    return x[at][None] if isinstance(at, slice) else x.take(at, axis=0)


def products(here: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Slopes of the weights of each node, summed over its places; matrix products of a single place are slow."""
    return np.einsum("gni,gnj->gij", here, spread) if here.shape[1] == 1 else here.transpose(0, 2, 1) @ spread


def contrast(scores: np.ndarray, target: np.ndarray, noise: np.ndarray, log_noise: np.ndarray) -> np.ndarray:
    """Slopes of the noise-contrastive loss by score: each target against ``NOISE`` draws from the node's shares.

    A node has few outcomes, so the draws enter by their expectation, which has no sampling error.
    """
    odds = np.subtract(log_noise, scores, out=scores)
    with np.errstate(over="ignore"):  # what is divided by infinity is 0
        np.exp(odds, out=odds)
    odds += 1
    at = places(target)
    own = 1 - 1 / odds.reshape(-1)[at]
    spread = np.divide(noise, odds, out=odds)
    spread.reshape(-1)[at] -= own
    return spread


def picked(scores: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log of the softmax at one place of each row."""
    own = scores.reshape(-1)[places(target)].reshape(target.shape).astype(np.float64)
    with np.errstate(over="ignore"):
        total = (np.exp(scores).reshape(-1, BRANCH) @ np.ones(BRANCH, np.float32)).reshape(target.shape)
    if len(total) and not 1e-30 < total.min() <= total.max() < 1e30:
        top = scores.max(axis=-1)
        return own - top - np.log(np.exp(scores - top[..., None]).sum(axis=-1))
    return own - np.log(total)


def chunks(batch: pa.RecordBatch, most: int = 4 << 20) -> Iterator[tuple[int, int, list[bytes]]]:
    """Rows ``[a, b)`` of a batch whose texts have about ``most`` bytes."""
    a, size, held = 0, 0, []
    for i, raw in enumerate(batch.column("raw")):
        held.append(raw.as_py())
        size += len(held[-1])
        if size >= most:
            yield a, i + 1, held
            a, size, held = i + 1, 0, []
    if held:
        yield a, batch.num_rows, held


def packed(values: np.ndarray) -> pa.Array:
    """Rows of parameters as 16-bit numbers."""
    flat = np.ascontiguousarray(values, np.float16)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * ROW), len(flat), [None, pa.py_buffer(flat)]).cast(pa.binary())


def unpacked(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float16).reshape(-1, ROW)


def averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each number, weighted by tokens; rows come sorted by number."""
    at, n, v = np.zeros(0, np.int64), np.zeros(0), np.zeros((0, ROW))

    def made(rows: slice) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(at[rows]), packed(v[rows] / n[rows, None])], names=["row", "v"])

    for batch in batches:
        if not batch.num_rows:
            continue
        more = batch.column("seen").to_numpy()
        at, n = np.append(at[-1:], batch.column("row").to_numpy()), np.append(n[-1:], more)
        v = np.concatenate([v[-1:], unpacked(batch.column("v")) * more[:, None]])
        first = np.flatnonzero(np.diff(at, prepend=-1))
        at, n, v = at[first], np.add.reduceat(n, first), np.add.reduceat(v, first)
        yield made(slice(0, -1))
    if len(at):
        yield made(slice(-1, None))


def train(texts: DataFrame, words: Vocabulary, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Every task learns from all its texts, starting from the same parameters. It hands on the rows of the words and
    nodes it has met, as 16-bit numbers; each row is averaged over its tasks by the tokens that met it. So what is
    exchanged grows with the texts, not with tasks times vocabulary. Gives numbers and values of all rows."""
    shared = texts.sparkSession.sparkContext.broadcast((words.own, words.own_ids, words.word_counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, own_ids, word_counts = shared.value
        v = Vocabulary(own, own, own_ids, own, own_ids, word_counts, 0, 0)
        local = LogBilinear(word_counts)
        state = local.state()
        end_id = int(v.model_ids(np.array([END]))[0])
        seen = np.zeros(len(word_counts))
        for batch in batches:
            for _, _, raws in chunks(batch):
                h, start = sequences(raws)
                ids = v.model_ids(h)
                local.learn(ids, local.contexts(ids, start, end_id), state, rate)
                seen += np.bincount(ids, minlength=len(seen))
        if seen.any():
            at, n, values = local.rows(seen)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n), packed(values)], names=["row", "seen", "v"])

    found = texts.mapInArrow(run, "row long, seen double, v binary")
    mean = found.repartition("row").sortWithinPartitions("row", "seen", "v").mapInArrow(averaged, "row long, v binary")
    table = mean.toArrow().combine_chunks()  # one row for each row of parameters
    order = np.argsort(table["row"].to_numpy())
    return table["row"].to_numpy()[order], unpacked(table["v"])[order]


def scored(docs: DataFrame, key: str = "doc_id", text: str = "text", head: int = HEAD) -> DataFrame:
    """``key``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` for each row.

    Tokens are the words of the whole text (A-Z lower-cased) and one end. Counts cover all rows outside the held-out
    fold. ``base_score`` adds ``log10((c + 1) / (N + V + 1))``. The model knows all words of ``OWN`` or more
    training tokens in the head, as leaves of a tree; the log-bilinear vector of the two tokens before predicts the branch at
    each of its nodes, normalised. All other words share one place of the model, times ``c + 1`` over the sum of that for them.

    Counts of the ``head`` most frequent tokens are looked up inside the tasks, those of the others are joined by
    token. Null and empty texts consist of the end alone. Repeated rows count and are scored each. Without training
    rows, N and V are 0. An empty table gives an empty result; only ``key`` and ``text`` are read.
    """
    kind = docs.schema[key].dataType.simpleString()
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary").alias("raw")
    texts = docs.select(F.col(key).alias("_key"), raw, (fold(key, FOLDS) == HELD_OUT).alias("held_out"))
    known = texts.where("not held_out").select("raw")
    counts = kept(known.mapInArrow(count_rows, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")), "counts")
    words = vocabulary(counts, head)
    shared = docs.sparkSession.sparkContext.broadcast((*(getattr(words, f.name) for f in fields(words)), *train(known, words)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *held, at, values = shared.value
        v = Vocabulary(*held)
        m = LogBilinear(v.word_counts)
        m.load(at, values)
        end_id = int(v.find(np.array([END]))[0][0])
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            for a, b, raws in chunks(batch):
                h, start = sequences(raws)
                ids, c = v.find(h)
                value = m.log10(ids, m.contexts(ids, start, end_id))
                out = c < 0
                log_c = np.log10(np.maximum(c, 0) + 1.0)
                other = ids == v.other
                doc = np.repeat(np.arange(len(raws)), np.diff(np.append(start, len(h))))
                far, far_doc = h[out], doc[out]
                sums = [np.add.reduceat(x, start) for x in (np.ones(len(h), np.int64), (~out).astype(np.int64), log_c, value + np.where(other, log_c, 0), other.astype(np.int64))]
                offsets = np.searchsorted(far_doc, np.arange(len(raws) + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(far.view(np.int64)))
                cols = [batch.column("_key").slice(a, b - a), batch.column("held_out").slice(a, b - a), pa.array(number + np.arange(len(raws))), *map(pa.array, sums), lists]
                number += len(raws)
                yield pa.RecordBatch.from_arrays(cols, names=["_key", "held_out", "row", "n_tokens", "n_head", "log_c", "value", "n_other", "far"])

    shape = f"_key {kind}, held_out boolean, row long, n_tokens long, n_head long, log_c double, value double, n_other long, far array<long>"
    each = kept(texts.mapInArrow(run, shape), "scores")
    far = each.select("row", F.explode("far").alias("h")).join(counts, "h")
    far = far.groupBy("row").agg(F.count("*").alias("n_far"), F.sum(F.log10(F.col("c") + 1.0)).alias("far_log"))
    n, v = words.total, words.types
    z = float(words.word_counts[-1])
    out = each.drop("far").join(far, "row", "left")
    far_log = F.coalesce("far_log", F.lit(0.0))
    return out.select(
        F.col("_key").alias(key),
        "held_out",
        "n_tokens",
        (F.col("n_head") + F.coalesce("n_far", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("log_c") + far_log - F.col("n_tokens") * F.log10(F.lit(float(n + v + 1)))).alias("base_score"),
        (F.col("value") + far_log - F.col("n_other") * F.log10(F.lit(z))).alias("score"),
    )
