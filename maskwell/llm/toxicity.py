"""Toxicity by multiple-instance learning: sentence scores, joined by noisy-or, learn from labels of documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold
from .winnow import byte_values, ranges, sums

#: About so many labelled documents are learned from, chosen by a hash of their id.
LEARN = 10_000
FOLDS, HELD_OUT, THRESHOLD, LEAK = 4, 2, 0.3, 0.05

#: Bytes of the word beginnings that are features beside the words, as words of one stem differ in their ends.
BEGINNINGS = (4, 6, 8)
SALTS = tuple(np.uint64(n * 0x9E3779B97F4A7C15 % 2**64) for n in BEGINNINGS)
#: Training documents that must hold a feature, and the L1 pull, which is less the more documents there are.
LEAST, PULL = 5, 0.02
#: Weights below this share of the strongest are zero but for the size of the steps.
ZERO = 0.001

TABLE = byte_values()
#: 1 ends a sentence, 32 separates words; letters are lower-cased; other bytes of UTF-8 stay.
KINDS = bytes(1 if c in b".!?\n" else c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def features(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, sentence and start of every word and of its beginnings, in order of the words."""
    data = np.frombuffer(raw.translate(KINDS), np.uint8)
    inside = data > 32
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64), start, start
    hashes, places = [], []
    for i in range(0, len(start), 1 << 16):
        s, e = start[i : i + (1 << 16)], end[i : i + (1 << 16)]
        summed = sums(TABLE[data[s[0] : e[-1]]])
        parts, owners = [ranges(summed, s - s[0], e - s[0])], [np.arange(len(s))]
        for size, salt in zip(BEGINNINGS, SALTS, strict=True):
            long = np.flatnonzero(e - s >= size)
            parts.append(ranges(summed, s[long] - s[0], s[long] - s[0] + size) ^ salt)
            owners.append(long)
        owner = np.concatenate(owners)
        order = np.argsort(owner, kind="stable")
        hashes.append(np.concatenate(parts)[order])
        places.append(owner[order] + i)
    place = np.concatenate(places)
    return np.concatenate(hashes), np.cumsum(data == 1)[start][place], start[place]


def softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


class Model:
    """Weights of the known words and beginnings (by sorted hash), the score of a sentence without any, and the leak."""

    def __init__(self, names: np.ndarray, weights: np.ndarray, bias: float, leak: float):
        self.names, self.weights, self.bias, self.leak = names, weights, bias, leak
        self.rough = np.zeros(1 << 16, bool)
        self.rough[(names >> np.uint64(48)).astype(np.int64)] = True

    def sentences(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Log-odds of the sentences that hold words, and the start of each."""
        word, sentence, start = features(raw)
        if not len(word):
            return np.zeros(0), start
        number = np.cumsum(np.diff(sentence, prepend=-1) != 0) - 1
        z = np.full(number[-1] + 1, self.bias)
        known = np.flatnonzero(self.rough[(word >> np.uint64(48)).astype(np.int64)])
        if len(known):
            i = np.minimum(np.searchsorted(self.names, word[known]), len(self.names) - 1)
            hit = self.names[i] == word[known]
            once = np.unique(number[known[hit]] * len(self.names) + i[hit])
            z += np.bincount(once // len(self.names), weights=self.weights[once % len(self.names)], minlength=len(z))
        return z, start[np.flatnonzero(np.diff(number, prepend=-1))]

    def score(self, raw: bytes) -> float:
        z, _ = self.sentences(raw)
        return float(-np.expm1(-softplus(z).sum() + np.log1p(-self.leak)))


def learn(docs: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray, rounds: int = 100, rate: float = 0.1, leak: float = LEAK) -> Model:
    """Full-batch Adam on the likelihood of the documents' labels under a leaky noisy-or.

    The fixed ``leak`` stands for labels that no sentence explains, so that these don't press weight on chance words; an
    L1 pull keeps the rest at zero; what it keeps is fitted again without it. A feature counts once in a sentence; those
    in fewer than ``LEAST`` documents are left out.
    """
    n = max(len(docs), 1)
    sparse = PULL / n**0.5
    seen, times = np.unique(np.concatenate([np.unique(w) for w, _ in docs] or [np.zeros(0, np.uint64)]), return_counts=True)
    names = seen[times >= LEAST]
    k = len(names)
    words, owner, of_doc, base = [], [], [], 0
    for d, (word, sentence) in enumerate(docs):
        if not len(word):
            continue
        number = np.cumsum(np.diff(sentence, prepend=-1) != 0) - 1
        i = np.searchsorted(names, word)
        known = np.flatnonzero(i < k)
        known = known[names[i[known]] == word[known]]
        once = np.unique(number[known] * max(k, 1) + i[known])
        words.append((once % max(k, 1)).astype(np.int32))
        owner.append((once // max(k, 1) + base).astype(np.int32))
        of_doc.append(np.full(int(number[-1]) + 1, d))
        base += int(number[-1]) + 1
    if not base or not k or not toxic.any():
        return Model(names[:0], np.zeros(0), -12.0, leak)
    words, owner, of_doc = np.concatenate(words), np.concatenate(owner), np.concatenate(of_doc)
    theta = np.zeros(k + 1)
    base_total = -np.log1p(-leak)
    share = max(toxic.mean(), 1e-4)
    theta[k] = np.log(share / 2 / max(1.0, base / len(docs)))

    def descend(words: np.ndarray, owner: np.ndarray, rounds: int, pressure: float) -> None:
        nonlocal theta
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for t in range(1, rounds + 1):
            z = np.bincount(owner, weights=theta[words], minlength=base) + theta[k]
            p = 1 / (1 + np.exp(-z))
            total = np.bincount(of_doc, weights=softplus(z), minlength=len(docs)) + base_total
            pull = np.where(toxic, -1 / np.maximum(np.expm1(np.minimum(total, 500)), 1e-9), 1.0)
            g = p * pull[of_doc]
            grad = np.append(np.bincount(words, weights=g[owner], minlength=k), g.sum()) / len(docs)
            grad[:k] += pressure * np.sign(theta[:k])
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
            new = theta - rate * (1 - t / (rounds + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
            crossed = np.sign(new) * np.sign(theta) < 0
            crossed[k] = False
            new[crossed] = 0
            theta = new

    descend(words, owner, rounds, sparse)
    # steps of finite size leave weights near zero that the pull holds at zero; it also shrinks what it keeps
    theta[:k][np.abs(theta[:k]) < ZERO * np.abs(theta[:k]).max()] = 0
    stay = theta[words] != 0
    descend(words[stay], owner[stay], rounds, 0.0)
    stay = np.flatnonzero(theta[:k])
    return Model(names[stay], theta[stay], float(theta[k]), leak)


def feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words, sentences = [], []
        for raw in batch.column("raw"):
            word, sentence, _ = features(raw.as_py())
            words.append(word.tobytes())
            sentences.append(sentence.astype(np.int32).tobytes())
        cols = [pa.array(c, pa.binary()) for c in (words, sentences)]
        yield pa.RecordBatch.from_arrays([batch.column("toxic"), *cols], names=["toxic", "word", "sentence"])


def learned_row(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    docs, toxic = [], []
    for batch in batches:
        for t, b, s in zip(*(batch.column(c).to_pylist() for c in ("toxic", "word", "sentence")), strict=True):
            docs.append((np.frombuffer(b, np.uint64), np.frombuffer(s, np.int32)))
            toxic.append(t == 1)
    model = learn(docs, np.array(toxic, bool))
    cols = [pa.array([model.names.view(np.int64).tolist()], pa.list_(pa.int64())), pa.array([model.weights.tolist()], pa.list_(pa.float64())), pa.array([model.bias])]
    yield pa.RecordBatch.from_arrays(cols, names=["names", "weights", "bias"])


def train(docs: DataFrame, labels: DataFrame, learn_rows: int = LEARN, key: str = "doc_id", text: str = "text") -> Model:
    """Learns from labelled rows outside the held-out fold, in one task, of about ``learn_rows`` documents.

    A document counts as toxic if any of its labels says so; null labels are no labels.
    """
    marks = labels.where(F.col("toxic").isNotNull() & F.col(key).isNotNull() & (fold(key, FOLDS) != HELD_OUT)).groupBy(key).agg(F.max("toxic").cast("int").alias("toxic"))
    n = marks.count()
    part = F.pmod(F.xxhash64(key), F.lit(1_000_000)) < int(1_000_000 * min(1.0, learn_rows / max(n, 1)))
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary").alias("raw")
    rows = docs.select(key, raw).join(marks.where(part), key).select("toxic", "raw")
    made = rows.mapInArrow(feature_rows, "toxic int, word binary, sentence binary").repartition(1)
    row = made.mapInArrow(learned_row, "names array<long>, weights array<double>, bias double").first()
    return Model(np.array(row["names"], np.int64).view(np.uint64), np.array(row["weights"]), row["bias"], LEAK)


def score_rows(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(raw.as_py()) for raw in batch.column("raw")]
            yield pa.RecordBatch.from_arrays([*batch.select(batch.schema.names[:-1]).columns, pa.array(scores, pa.float64())], names=[*batch.schema.names[:-1], "score"])

    return run


def scored(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``held_out``, ``score`` and ``predicted`` for each row of ``docs``.

    A sentence (up to ``.``, ``!``, ``?`` or a line end) has the log-odds of its words' weights and a bias; a document
    is toxic if any sentence is, or by the leak: ``1 - (1 - leak) * product(1 - p)``. Weights are learned from document labels alone, on rows whose
    fold is not the held-out one (:func:`train`), then every whole text is scored.

    Null, empty and wordless texts score as the leak. Repeated rows have equal scores. Without labels, or with none that is
    toxic, all scores are near 0. An empty table gives an empty result; only ``key`` and ``text`` are read.
    """
    model = train(docs, labels, key=key, text=text)
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary").alias("raw")
    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(F.col(key).alias("_key"), raw).mapInArrow(score_rows(model), f"_key {kind}, score double")
    return out.select(F.col("_key").alias(key), (fold("_key", FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score is below ``threshold``."""
    model = train(docs, labels, key=key, text=text)
    extra = F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_raw")
    names = docs.columns
    staged = docs.select(*(F.col(c) for c in names), extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fine = pa.array([model.score(raw.as_py()) < threshold for raw in batch.column("_raw")], pa.bool_())
            yield batch.select(names).filter(fine)

    return staged.mapInArrow(run, docs.schema)


def offending_sentences(docs: DataFrame, model: Model, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``at`` (byte), ``sentence`` and ``score`` of every sentence that alone reaches ``threshold``."""
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary").alias("raw")
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for name, b in zip(batch.column("_key").to_pylist(), batch.column("raw").to_pylist(), strict=True):
                z, at = model.sentences(b)
                ends = np.append(at[1:], len(b))
                for i in np.flatnonzero(1 / (1 + np.exp(-z)) >= threshold):
                    rows.append((name, int(at[i]), b[at[i] : ends[i]].decode("utf-8", "replace").strip(), float(1 / (1 + np.exp(-z[i])))))
            if rows:
                cols = list(zip(*rows, strict=True))
                kinds = (batch.schema.field("_key").type, pa.int64(), pa.string(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["_key", "at", "sentence", "score"])

    return docs.select(F.col(key).alias("_key"), raw).mapInArrow(run, f"_key {kind}, at long, sentence string, score double").withColumnRenamed("_key", key)
