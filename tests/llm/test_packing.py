"""Packing: ids, pieces and bins against the tokenizer itself."""

import random
import zlib

import numpy as np
import pytest

from maskwell.llm import packing

tokenizers = pytest.importorskip("tokenizers")
PATH = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def bpe():
    return tokenizers.Tokenizer.from_file(PATH)


def ids(bpe, text):
    return np.array([*bpe.encode(text or "", add_special_tokens=False).ids, 1], "<u4")


@pytest.mark.parametrize("slice_chars", [5, 1 << 20])
def test_words_give_the_tokenizers_ids(bpe, slice_chars, monkeypatch):
    monkeypatch.setattr(packing, "SLICE", slice_chars)
    monkeypatch.setattr(packing, "CACHE_WORDS", 50)
    monkeypatch.setattr(packing, "STEP", 90 if slice_chars == 5 else 1 << 23)
    rng = random.Random(3)
    plain, odd = " \n\t\rabcZ19'é漢.,!?😀_-", " \x0b\x0c\x1c\x85\xa0᠎ ​　ab.'9"
    texts = ["", " ", "nul \x00 in\x00 it", "a.b,c-d_e. f's 'x .y", "x-_-y @z) \u00df.\u01c5! \u0250.", "<|endoftext|>", "a <|endoftext|> b", "don't  do\n\nthat ", "x" * 200 + " y"]
    for letters in (plain, odd, plain + odd, "aß9. ,'|<>\n"):
        texts += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(600)]
    encode = packing.encoder(PATH)
    assert encode(texts) == [bpe_ids[:-1].tobytes() for bpe_ids in (ids(bpe, t) for t in texts)]


@pytest.mark.parametrize("capacity", [1, 7, 64, 2048])
def test_lengths_waste_little(capacity):
    for slack in (0, capacity // 32):
        for n in {*range(1, 130), 2047, 2048, 2049, 10_000}:
            cut = packing.lengths(n, capacity, slack)
            assert sum(cut) == n and all(0 < x <= capacity for x in cut)
            for x in cut:
                assert capacity - capacity // x * x <= max(slack, capacity // x)


def check(got, rows, bpe, capacity):
    docs = {}
    for r in got:
        docs.setdefault(r["doc_id"], []).append(r)
    assert sorted(docs, key=repr) == sorted({i for i, _ in rows}, key=repr)
    for i, parts in docs.items():
        texts = [t for j, t in rows if j == i]
        if len(texts) > 1:
            assert len(set(texts)) == 1 and len(parts) % len(texts) == 0
            parts = sorted(parts, key=lambda r: r["start"])[:: len(texts)]
        all_ids = ids(bpe, texts[0])
        at = 0
        for r in sorted(parts, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(all_ids)
            assert r["ids_crc32"] == zlib.crc32(all_ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(all_ids)
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return [sum(n for _, n in parts) for parts in bins.values()]


def test_pack(spark, sf_dir, bpe):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    sizes = check(packing.pack(docs, PATH).collect(), rows, bpe, 2048)
    assert sum(sizes) > 0.98 * 2048 * (len(sizes) - 1)


@pytest.mark.parametrize("worker_pieces", [100_000, 4])
def test_pack_of_odd_rows(spark, bpe, worker_pieces):
    words = "one two three four five ".split()
    rows = [(1, "a b c " * 400), (2, None), (3, ""), (None, "null id " * 9), (4, "same"), (4, "same"), (5, " ".join(words * 30)), (6, "z")]
    shape = "doc_id long, text string, start string, length string, _worker string, sequence_id string"
    docs = spark.createDataFrame([(i, t, "x", "x", "x", "x") for i, t in rows], shape)
    out = packing.pack(docs, PATH, capacity=64, worker_pieces=worker_pieces)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    check(out.collect(), rows, bpe, 64)
    assert packing.pack(docs.where("false"), PATH).collect() == []
    again = packing.pack(docs, PATH, capacity=64, worker_pieces=worker_pieces)
    assert sorted(map(repr, again.collect())) == sorted(map(repr, out.collect()))


def test_classes_take_a_fixed_count():
    rng = np.random.default_rng(2)
    length = rng.integers(1, 65, 3000)
    bins, offset = packing.fill(length, 64)
    held = {}
    for b, n in zip(bins, length, strict=True):
        held.setdefault(b, []).append(64 // n)
    full = [k for k in held.values() if len(set(k)) == 1 and len(k) == k[0]]
    assert len(full) > 0.9 * len(held) and (offset + length <= 64).all()


def test_plain_words_go_to_the_tokenizer_together(monkeypatch):
    """Runs of words as one text; their ids are those of each word, and of the whole text."""
    import public_tokenizers
    import tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = tokenizers.Tokenizer.from_file(path)
    sizes = []

    class Counted:
        def __init__(self, inner):
            self.inner = inner

        def encode_batch_fast(self, texts, **how):
            sizes.append(len(texts))
            return self.inner.encode_batch_fast(texts, **how)

        def __getattr__(self, name):
            return getattr(self.inner, name)

    class Source:
        from_file = staticmethod(lambda p: Counted(whole))

    monkeypatch.setattr(tokenizers, "Tokenizer", Source)
    texts = ["the " + " ".join(f"w{i} Straße{i} {i}été don't{i}, x́{i} 中{i}" for i in range(700)), " a", "", "a  b\n c"]
    from maskwell.llm import packing

    got = packing.encoder(path)(texts)
    assert [list(np.frombuffer(g, "<u4")) for g in got] == [whole.encode(t, add_special_tokens=False).ids for t in texts]
    # more than a thousand plain words took a few calls of one text each
    assert 1 <= sizes.count(1) <= 6 and sum(sizes) < 3 * 700 + 100
