"""Every operator against plain Python on small tables with nulls, blanks, ties, copies and odd columns."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from maskwell.llm import decontamination, jaccard_join, language_model, mixing, sharding, suffix_dedup, super_kmers, topk, toxicity, url_filters, winnow
from maskwell.llm.components import components

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
# columns whose names clash with those the operators use inside
SHAPE = "doc_id long, text string, source string, raw string, t1 string, shard string, _key string, size string, score string"


def frame(spark, rows, extra=("x",) * 6):
    return spark.createDataFrame([(i, t, s, *extra) for i, t, s in rows], SHAPE)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)] + ["É", "Ünit", "the", "THE"]
    prose = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 300))) for _ in range(40)]
    long = " ".join(rng.choice(words) for _ in range(6000))
    shared = prose[0][:700]
    out = [(i, t, f"s{i % 3}") for i, t in enumerate(prose)]
    out += [(100, prose[3], None), (101, prose[3], "s1"), (102, prose[4] + " tail", "s1"), (103, long, "s0")]
    out += [(104, "a " + shared + " b", "s0"), (105, shared + shared, "s0"), (106, "ab" * 600, "s0"), (107, "z " * 120, "s2")]
    out += [(108, None, "s1"), (109, "", None), (110, " \n\t", "s2"), (111, "one", "s2"), (112, "One", "s2"), (112, "One", "s2"), (None, prose[5], "s1")]
    return out


def key(r):
    return tuple((x is None, x) for x in r)


def covered(seqs, length):
    seen = Counter(s[i : i + length] for s in seqs for i in range(len(s) - length + 1))
    for s in seqs:
        marks = [False] * len(s)
        for i in range(len(s) - length + 1):
            if seen[s[i : i + length]] > 1:
                marks[i : i + length] = [True] * length
        yield marks


@pytest.mark.parametrize("wide", [4096, 1])
def test_suffix_dedup(spark, rows, wide, monkeypatch):
    monkeypatch.setattr(suffix_dedup.find, "__defaults__", ("text", wide))
    got = suffix_dedup.without_repeats(frame(spark, rows), 60).collect()
    raws = [(t or "").encode() for _, t, _ in rows]
    want = []
    for (i, _, _), b, m in zip(rows, raws, covered(raws, 60), strict=True):
        spans = sum(m[j] and not (j and m[j - 1]) for j in range(len(b)))
        want.append((i, len(b), sum(m), spans, hashlib.sha256(bytes(x for x, d in zip(b, m, strict=True) if not d)).hexdigest()))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_repeat_groups_hold_all_occurrences(spark):
    rng = random.Random(8)
    part = "".join(chr(97 + rng.randrange(26)) for _ in range(90))
    docs = spark.createDataFrame([(1, "x" + part + "1"), (2, "y" + part + "2"), (3, part)], "doc_id long, text string")
    found = {}
    for r in suffix_dedup.repeat_groups(docs, 60).collect():
        found.setdefault((r["repeat"], r["n_bytes"]), set()).add((r["doc_id"], r["at"]))
    at = {(i, s): n for (_, n), v in found.items() for i, s in v}
    assert all(n >= 60 and {i for i, _ in v} == {1, 2, 3} for (_, n), v in found.items())
    assert {x for (i, s), n in at.items() if i == 1 for x in range(s, s + n)} == set(range(1, 91))


@pytest.mark.parametrize("wide", [4096, 1])
def test_repeat_groups_cover_what_repeats(spark, wide):
    rng = random.Random(9)
    part = "".join(chr(97 + rng.randrange(26)) for _ in range(90))
    texts = [str(i) * 3 + part + str(i) * 5 for i in range(6)] + [part[:20] * 5, "q" * 70 + part, "z" * 59]
    docs = spark.createDataFrame(list(enumerate(texts + texts[-2:])), "doc_id long, text string").coalesce(1)
    marks = {i: set() for i in range(len(texts) + 2)}
    for r in suffix_dedup.repeat_groups(docs, 60, wide=wide).collect():
        marks[r["doc_id"]] |= set(range(r["at"], r["at"] + r["n_bytes"]))
    raws = [t.encode() for t in texts + texts[-2:]]
    for i, m in enumerate(covered(raws, 60)):
        assert marks[i] == {j for j, x in enumerate(m) if x}


def test_long_texts_are_cut_into_segments_without_loss(monkeypatch):
    raw = random.Random(3).randbytes(5000)
    whole = suffix_dedup.units(60, 30).blocks(raw)
    monkeypatch.setattr(winnow, "SEGMENT", 700)
    parts = suffix_dedup.units(60, 30).blocks(raw)

    def anchor_of(blocks):
        return {at: place for _, place, first, last in zip(*(x.tolist() for x in blocks), strict=True) for at in range(first, last + 1)}

    assert len(parts[0]) > len(whole[0]) and anchor_of(parts) == anchor_of(whole) and len(anchor_of(whole)) == 5000 - 59


def test_interval_scan_finds_every_group():
    texts = [b"abcx", b"abcy", b"abd", b"q", b"abcx"]
    groups = {(d, tuple(sorted(m for c in cs for m in c))) for d, cs in suffix_dedup.intervals(texts)}
    assert {(4, (0, 4)), (3, (0, 1, 4)), (2, (0, 1, 2, 4)), (0, (0, 1, 2, 3, 4))} <= groups


@pytest.mark.parametrize("wide", [4096, 1])
def test_super_kmers(spark, rows, wide, monkeypatch):
    monkeypatch.setattr(super_kmers.find, "__defaults__", ("text", wide))
    got = super_kmers.without_repeats(frame(spark, rows), 9, 4).collect()
    words = [tuple((t or "").encode().split()) for _, t, _ in rows]
    want = []
    for (i, _, _), w, m in zip(rows, words, covered(words, 9), strict=True):
        want.append((i, len(w), sum(m), hashlib.sha256(b" ".join(x for x, d in zip(w, m, strict=True) if not d)).hexdigest()))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_mixing(spark, rows):
    mix = mixing.mix(frame(spark, rows), block=64)
    got = mix.documents.collect()
    sizes = [len((t or "").split()) for _, t, _ in rows]
    assert sorted(((r["doc_id"], r["size"]) for r in got), key=key) == sorted(((i, n) for (i, _, _), n in zip(rows, sizes, strict=True)), key=key)
    per = Counter()
    for (_, _, s), n in zip(rows, sizes, strict=True):
        per[s] += n
    weight = dict(zip(["s0", "s1", "s2", None], (5, 2, 1, 5), strict=True))
    lo, hi = 0.0, 1e9
    for _ in range(200):  # the level where the capped shares add up
        level = (lo + hi) / 2
        lo, hi = (level, hi) if sum(min(level * weight[s], 3 * n) for s, n in per.items()) < sum(sizes) else (lo, level)
    for r in mix.sources.collect():
        assert math.isclose(r["target"], min(lo * weight[r["source"]], 3 * per[r["source"]]), rel_tol=1e-9)
    assert all(r["taken"] <= 3 * r["size"] for r in got)
    for target, n in {(r["target"], r["source_size"]) for r in got}:
        assert abs(sum(r["taken"] for r in got if (r["target"], r["source_size"]) == (target, n)) - target) <= 1
    assert sorted(got, key=key) == sorted(mixing.mix(frame(spark, rows), block=64).documents.collect(), key=key)


def test_sharding(spark, rows):
    got = sharding.with_byte_shards(frame(spark, rows)).collect()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    for s in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    order = sorted(got, key=lambda r: (r["shard"], r["slot"]))
    ids = [r["doc_id"] if r["doc_id"] is not None else -1 for r in order]
    assert ids == sorted(ids)
    whole, at = sum(r["size"] for r in got), 0
    for r in order:
        assert r["shard"] == min(7, (2 * at + r["size"]) * 8 // (2 * whole))
        at += r["size"]


def test_url_rules(spark):
    urls = [None, "", "no-scheme/en/", "http://a.NET/x", "http://a.example.net/en/1?q", "http://example.com/de/", "http://xexample.com/de/", "http://b.org/fr/#t", "http://net", "http://net?/x", "ftp://deep.a.b.example.com/de/x", "http://a.net/x", "http://" + "a." * 3000 + "net/", "://net/"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(3, urls[3], "h")], "page_id long, url string, host string")
    rules = spark.createDataFrame(url_filters.RULES, "host string, path string, verdict string")
    want = Counter()
    for i, u in [*enumerate(urls), (3, urls[3])]:
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, tail = rest[:cut].lower(), rest[cut:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
        fits = [(len(h + p), len(h), h + p, v) for h, p, v in url_filters.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits) if fits else (0, 0, None, "allow")
        want[(i, host, path, best[2], best[3])] += 1
    assert Counter(map(tuple, url_filters.judge(pages, rules).collect())) == want


def test_cascade_is_exact_on_its_universe(spark, monkeypatch):
    monkeypatch.setattr(url_filters, "LEAST_BITS", 64)
    universe = spark.range(3000).selectExpr("cast(id as string) key")
    listed = universe.where("key % 7 = 0")
    cascade = url_filters.Cascade(listed, universe)
    assert len(cascade.levels) > 1
    wrong = universe.where(cascade.has(universe["key"]) != (universe["key"] % 7 == 0)).count()
    assert wrong == 0


def test_topk(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(0, 0.3, 6)]) for i in range(90)] + [(90 + i, [0.5, 0.0, 0.0, 0.0, 0.0, 0.0]) for i in range(30)]
    rows += [(500, None), (520, [float("nan"), 1.0]), (540, [None, 1.0]), (560, []), (20, rows[20][1]), (None, [1.0])]
    vectors = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string")
    kept = {(i, tuple(math.floor(64 * float(np.float32(x))) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    want = []
    for q, a in kept:
        if q % 20 == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), c) for c, b in kept if c != q)[:20]
            want += [(q, n + 1, c, -s) for n, (s, c) in enumerate(scores)]
    assert sorted(map(tuple, topk.search(vectors).collect())) == sorted(want)


def shingles(text, n=3):
    w = (text or "").encode().translate(LOWER).split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


@pytest.mark.parametrize("limit", [2000, 3])
def test_jaccard_join(spark, limit, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", limit)
    rng = random.Random(9)
    base = [[f"v{rng.randrange(500)}" for _ in range(n)] for n in (2, 8, 11, 12, 30, 60, 200, 400)]
    rows = []
    for b in base:
        for _ in range(8):
            w = list(b)
            for _ in range(rng.randrange(0, max(2, len(w) // 40))):
                w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(w + [f"e{rng.randrange(3)}"] * rng.randrange(2)), "s"))
    rows += [(900, None, "s"), (901, "", "s"), (902, "  ", "s"), (903, rows[0][1].upper(), "s"), (3, rows[3][1], "s")]
    sets = [(i, shingles(t)) for i, t, _ in rows]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a + 1, len(sets)):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 90 * len(x | y):
                root[find(b)] = find(a)
    least = {}
    for a, (i, _) in enumerate(sets):
        least[find(a)] = min(least.get(find(a), i), i)
    want = sorted((i, len(s), least[find(a)]) for a, (i, s) in enumerate(sets))
    assert sorted(map(tuple, jaccard_join.join(frame(spark, rows)).collect())) == want
    assert len({c for _, _, c in want}) < len(want)


def test_sets_without_a_common_shingle_share_no_key():
    rng = random.Random(3)
    levels, seen = jaccard_join.Levels(80), Counter()
    for i in range(3000):
        text = " ".join(f"u{i}x{rng.randrange(10**6)}" for _ in range(rng.randint(13, 22)))
        seen.update(set(levels.keys(jaccard_join.shingle_set(text.encode(), 5)).tolist()))
    assert max(seen.values()) == 1


@pytest.mark.parametrize("percent", [80, 90])
def test_similar_sets_share_a_key(percent):
    rng = random.Random(percent)
    levels = jaccard_join.Levels(percent)
    for n in [*range(1, 60), 100, 250, 700, 2500]:
        for _ in range(20):
            a = {rng.randrange(1 << 64) for _ in range(n)}
            gone = rng.randint(0, n * (100 - percent) // 100)
            b = set(rng.sample(sorted(a), n - gone))
            while 100 * len(a & b) >= percent * (len(a | b) + 1) and rng.random() < 0.9:
                b.add(rng.randrange(1 << 64))
            x, y = (np.array(sorted(s), np.uint64) for s in (a, b))
            assert np.intersect1d(levels.keys(x), levels.keys(y)).size


def test_bitmaps_rule_out_no_link():
    rng = random.Random(8)
    sets = []
    for n in (1, 5, 63, 64, 65, 127, 129, 300, 520):
        a = [rng.randrange(1 << 64) for _ in range(n)]
        sets += [a, a[: max(1, n - n // 12)], a + [rng.randrange(1 << 64) for _ in range(n // 6)]]
    arrays = [np.unique(np.array(a, np.uint64)) for a in sets]
    n = np.array([len(a) for a in arrays])
    found = list(jaccard_join.possible(n, [jaccard_join.bit_rows(a).tobytes() for a in arrays], np.zeros(len(n), int), 80))
    root = list(range(len(n)))
    for x, y in found:
        root = [root[x] if r == root[y] else r for r in root]
    for x in range(len(n)):
        for y in range(x):
            both = len(np.intersect1d(arrays[x], arrays[y]))
            assert 100 * both < 80 * (n[x] + n[y] - both) or root[x] == root[y]


def test_jaccard_join_of_a_key_with_several_texts(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(50)) for c in "ab")
    rows = [(1, a, "s"), (1, b, "s"), (2, a + " x", "s"), (0, b + " x", "s"), (None, a, "s"), (None, "alone here", "s")]
    got = sorted(((r[0], r[2]) for r in jaccard_join.join(frame(spark, rows)).collect()), key=key)
    assert got == sorted([(1, 1), (1, 0), (2, 1), (0, 0), (None, 1), (None, None)], key=key)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 100), (7, 7)]
    got = {r["v"]: r["c"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 103: 100}


def test_toxicity(spark):
    rng = random.Random(2)
    plain = [f"w{i}" for i in range(60)]
    rows, labels = [], []
    for i in range(900):
        w = [rng.choice(plain) for _ in range(rng.randint(5, 60))]
        bad = i % 9 == 0
        if bad:
            w[rng.randrange(len(w))] = "nasty"
        rows.append((i, ". ".join(" ".join(w[j : j + 9]) for j in range(0, len(w), 9)), "s"))
        labels.append((i, 1 if bad else 0))
    rows += [(2000, None, "s"), (2001, "", "s"), (2002, "!!", "s"), (2003, "so NASTY!", "s"), (2003, "so NASTY!", "s"), (None, "nasty w1", "s")]
    marks = spark.createDataFrame([*labels, (5, None), (7, 0)], "doc_id long, toxic int")
    docs = frame(spark, rows)
    got = toxicity.scored(docs, marks).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"] if r["doc_id"] is not None else "").encode()) % 4 == 2) for r in got)
    said = {r["doc_id"]: r["predicted"] for r in got}
    assert sum(said[i] != y for i, y in labels) == 0
    assert [said[2000], said[2001], said[2002], said[2003], said[None]] == [0, 0, 0, 1, 1]
    assert {r["doc_id"] for r in toxicity.without_toxic(docs, marks).collect()} == {i for i, p in said.items() if not p}
    model = toxicity.train(docs, marks)
    spots = toxicity.offending_sentences(docs.where("doc_id = 2003 or doc_id = 0"), model).collect()
    assert {r["doc_id"] for r in spots} == {0, 2003} and all("nasty" in r["sentence"].lower() for r in spots)
    assert toxicity.scored(docs, marks.where("false")).where("predicted = 1").count() == 0


def test_toxic_words_that_share_only_a_stem(spark):
    rng = random.Random(12)
    syllables = [a + b for a in "bdfgklmnprst" for b in "aeiou"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(2, 5)))
    rows, labels = [], []
    for i in range(1500):
        w = [word() for _ in range(rng.randint(10, 50))]
        bad = i % 8 == 0
        if bad:
            w[rng.randrange(len(w))] = rng.choice(("\u00f6dzork", "grumpf")) + word()
        rows.append((i, ". ".join(" ".join(w[j : j + 9]) for j in range(0, len(w), 9)), "s"))
        labels.append((i, int(bad)))
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.scored(frame(spark, rows), marks).where("held_out").collect()
    truth = dict(labels)
    caught = [r["predicted"] for r in got if truth[r["doc_id"]]]
    left = [r["predicted"] for r in got if not truth[r["doc_id"]]]
    assert sum(caught) >= 0.95 * len(caught) and sum(left) <= 0.01 * len(left)


def test_features_of_long_and_odd_texts():
    words = ["ab", "abcd", "abcdef", "abcdefghi", "\u00e9\u00e9\u00e9\u00e9x"] * 20_000
    found, sentence, start = toxicity.features(" ".join(words).encode())
    sizes = [sum(len(w.encode()) >= n for n in toxicity.BEGINNINGS) + 1 for w in words]
    assert len(found) == sum(sizes) == len(sentence) == len(start) and (np.diff(start) >= 0).all()
    few, _, _ = toxicity.features(" ".join(words[:5]).encode())
    assert (found[: len(few)] == few).all() and (found[-len(few) :] == few).all() and len(set(few.tolist())) == 11
    assert all(len(x) == 0 for x in toxicity.features(b" . ! "))


def test_decontamination(spark):
    rng = random.Random(4)
    words = [f"q{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    item = "the shop sold 12 apples to Anna and 7 pears to Boris for 12 euros last week"
    items = [(1, item), (2, prose(30)), (3, "a b c d e f"), (4, "too short"), (5, None), (2, None)]
    items[5] = (2, items[1][1])
    docs = [
        (1, prose(50) + " " + item + " " + prose(5), "s"),
        (2, prose(9) + " The shop sold 31 apples to Clara and 5 pears to Dimitri for 31 euros last week.", "s"),
        (3, "the shop sold 31 apples to Clara and 5 pears to Clara for 9 euros last week", "s"),
        (4, items[1][1].upper(), "s"),
        (5, prose(4000), "s"),
        (6, "x a b c d e f y", "s"),
        (7, "too short", "s"),
        (8, None, "s"),
        (9, "", "s"),
        (1, prose(3) + " " + item, "s"),
        (None, item, "s"),
    ]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, size string")
    for lookup in (10**6, 0):
        got = decontamination.leaks(frame(spark, docs), bench, lookup=lookup).collect()
        assert {(r["doc_id"], r["item_id"], r["changed"]) for r in got} == {(1, 1, False), (2, 1, True), (4, 2, False), (6, 3, False), (None, 1, False)}
        assert len(got) == 5
    stay = decontamination.without_leaks(frame(spark, docs), bench)
    assert sorted(r["doc_id"] for r in stay.collect()) == [3, 5, 7, 8, 9] and stay.columns == frame(spark, docs).columns


def test_decontamination_finds_literal_copies_of_numbers_and_short_items(spark):
    items = [(1, "What is 12 + 7 * 3 - 4 / 2?"), (2, "1 2 3 4 5 6 7 8 9 10 11 12"), (3, "Who wrote Faust"), (4, "so it is")]
    docs = [
        (1, "Solve this: what is 12 + 7 * 3 - 4 / 2? Then rest.", "s"),
        (2, "Solve this: what is 13 + 7 * 3 - 4 / 2? Then rest.", "s"),
        (3, "Count 1 2 3 4 5 6 7 8 9 10 11 12 now", "s"),
        (4, "Tell me: who wrote Faust?", "s"),
        (5, "who has written Faust", "s"),
    ]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for lookup in (10**6, 0):
        found = lambda **k: {(r["doc_id"], r["item_id"], r["changed"]) for r in decontamination.leaks(frame(spark, docs), bench, lookup=lookup, **k).collect()}  # noqa: B023, E731
        assert found(shortest=1) == {(1, 1, False), (3, 2, False), (4, 3, False)}
        assert found() == {(1, 1, False), (3, 2, False)}


def test_decontamination_finds_changed_names_that_open_sentences(spark):
    items = [(1, "Tom has 3 apples. Mary has 4 apples. Anna has 9 apples. How many apples are there?"), (2, "Clara ran 5 km before lunch"), (3, "Paul saw Rita because Paul liked cake")]
    docs = [
        (1, "Solve. Ben has 5 apples. Lucy has 8 apples. Olga has 2 apples. How many apples are there?", "s"),
        (2, "Rain fell. Ivan saw Olga because Ivan liked cake.", "s"),
        (3, "It was late. Boris ran 9 km before lunch.", "s"),
        (4, "Then Boris ran 9 km before lunch.", "s"),
        (5, "Boris swam 9 km before lunch.", "s"),
        (6, "Rain fell. Ivan saw Olga because Egon liked cake.", "s"),
    ]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for lookup in (10**6, 0):
        got = decontamination.leaks(frame(spark, docs), bench, lookup=lookup).collect()
        assert {(r["doc_id"], r["item_id"], r["changed"]) for r in got} == {(1, 1, True), (2, 3, True), (3, 2, True), (4, 2, True)}


@pytest.mark.parametrize("head", [10**6, 50])
def test_language_model(spark, rows, head):
    got = language_model.scored(frame(spark, rows), head=head).collect()
    texts = [(i, [*(t or "").encode().translate(LOWER).split(), None], zlib.crc32(str(i if i is not None else "").encode()) % 7 == 2) for i, t, _ in rows]
    count = Counter(w for _, ws, out in texts if not out for w in ws)
    n, v = sum(count.values()), len(count)
    want = [(i, out, len(ws), sum(count[w] > 0 for w in ws), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws), 6)) for i, ws, out in texts]
    assert sorted(((*r[:5], round(r["base_score"], 6)) for r in map(lambda r: r, got)), key=key) == sorted(want, key=key)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)


def test_language_model_is_normalised_and_learns():
    rng = np.random.default_rng(1)
    start = rng.integers(0, 20, 4000)
    ids = np.stack([start, start + 100, start + 200], axis=1).reshape(-1)
    counts = np.bincount(ids, minlength=language_model.LEAST).astype(float) + 0.5
    model = language_model.LogBilinear(counts)
    ctx = model.contexts(ids, np.array([0]), 0)
    before = model.log10(ids, ctx).mean()
    state = model.state()
    for _ in range(30):
        model.learn(ids, ctx, state, 0.3)
    assert model.log10(ids, ctx).mean() > before + 0.3
    every = np.arange(language_model.LEAST)
    assert math.isclose((10 ** model.log10(every, [np.full(len(every), 5), np.full(len(every), 105)])).sum(), 1, rel_tol=1e-4)


def test_language_model_rows_are_averaged_by_tokens():
    counts = np.arange(69_984, dtype=float)
    model, seen = language_model.LogBilinear(counts), np.zeros(len(counts))
    assert [len(t) for t in model.tables] == [1, 3, 69, 2187]
    seen[[3, 69_000]] = 2, 5
    at, n, values = model.rows(seen)
    other = language_model.LogBilinear(counts)
    for p in other.params():
        p[...] = 9
    other.load(at, values)
    for p, q in zip(model.params(), other.params(), strict=True):
        same = (p == q).reshape(-1)
        assert same.any() and (same.all() or p is not model.c)
    assert (other.q[[3, 69_000]] == model.q[[3, 69_000]]).all() and (other.q[4] == 9).all()
    twice = np.repeat(np.arange(len(at)), 2)
    weights = np.tile([1.0, 3.0], len(at))
    rows = pa.RecordBatch.from_arrays([pa.array(twice), pa.array(weights), language_model.packed(values[twice] * np.tile([4, 0], len(at))[:, None])], names=["row", "seen", "v"])
    got = list(language_model.averaged(iter([rows.slice(0, 7), rows.slice(7)])))
    assert np.concatenate([b.column("row") for b in got]).tolist() == list(range(len(at)))
    assert np.allclose(np.concatenate([language_model.unpacked(b.column("v")) for b in got]), values, atol=0.01)


def test_language_model_hashes_texts_together(monkeypatch):
    calls, sums = [], language_model.sums
    monkeypatch.setattr(language_model, "sums", lambda x: calls.append(len(x)) or sums(x))
    texts = ["", " \t\n", "One two\x0bone", "\u00a0x \x00 \x1c", "\r", "\u00c4B ab" * 9] * 50 + [""]
    raws = [t.encode() for t in texts]
    h, start = language_model.sequences(raws)
    assert len(calls) == 1  # before: a few dozen calls of numpy for each text, however short
    each = [super_kmers.Words(raw.translate(LOWER)).hashes() for raw in raws]
    assert h.tolist() == [x for e in each for x in (*e.tolist(), int(language_model.END))]
    assert start.tolist() == np.cumsum([0, *(len(e) + 1 for e in each[:-1])]).tolist()
    monkeypatch.setattr(language_model, "HASHED", 7)
    again, _ = language_model.sequences(raws)
    assert (again == h).all()


def test_language_model_lookup():
    rng = np.random.default_rng(3)
    spread = rng.integers(0, 2**64, 5000, np.uint64)
    for keys in (spread, np.arange(900, dtype=np.uint64), np.array([5], np.uint64), np.array([0, 2**64 - 1], np.uint64)):
        keys = np.unique(keys)
        asked = np.concatenate([keys, keys + np.uint64(1), spread[:50], np.array([0, 2**64 - 1], np.uint64)])
        want = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
        assert (language_model.Sorted(keys).find(asked) == want).all()


def test_language_model_steps(monkeypatch):
    monkeypatch.setattr(language_model, "LARGE", 40)
    rng = np.random.default_rng(2)
    counts = 1 + 1000.0 / np.arange(1, language_model.LEAST + 1)
    ids = np.minimum(rng.zipf(1.3, 600), len(counts)) - 1
    groups = ids[np.argsort(ids)] // language_model.BRANCH
    kinds = {isinstance(at, slice) or at.shape[1] for _, at in language_model.runs(groups)}
    assert {True, 1, 2} <= kinds  # nodes that come alone, and those of one place and of several
    model, plain = language_model.LogBilinear(counts), language_model.LogBilinear(counts)
    ctx = model.contexts(ids, np.array([0]), 0)
    model.learn(ids, ctx, model.state(), 0.1)
    # one batch, token by token
    width, branch = language_model.WIDTH, language_model.BRANCH
    tables = [t.astype(float) for t in plain.tables]
    slopes = [np.zeros_like(t) for t in tables]
    g_q, g_c = np.zeros(plain.q.shape), np.zeros(plain.c.shape)
    for i, x in enumerate(ids):
        v = sum(plain.q[c[i]].astype(float) @ plain.c[j] for j, c in enumerate(ctx))
        here, back = np.append(v, 1), np.zeros(width)
        for t, g, noise, below in zip(tables, slopes, plain.noise, plain.below, strict=True):
            node, target = divmod(x // below, branch)
            share = noise[node].astype(float)
            chance = 1 / (1 + share * np.exp(-(here @ t[node])))
            slope = share * chance
            slope[target] -= 1 - chance[target]
            back += t[node][:width] @ slope
            g[node] += np.outer(here, slope)
        for j, c in enumerate(ctx):
            g_q[c[i]] += plain.c[j] @ back
            g_c[j] += np.outer(plain.q[c[i]], back)
    for p, g, was, axis in [*zip(model.tables, slopes, tables, [1] * len(tables), strict=True), (model.q, g_q, plain.q, -1), (model.c, g_c, plain.c, -1)]:
        want = was - 0.1 * g / np.sqrt(1 + (g * g).mean(axis=axis, keepdims=True))
        assert np.allclose(p, want, atol=2e-5)
    far = np.array([[[200.0, 90, *[0] * (branch - 2)], [-200.0] * branch]], np.float32)
    assert np.allclose(language_model.picked(far, np.array([[1, 3]])), [[-110, -math.log(branch)]])


def test_language_model_vocabulary_grows_with_the_corpus(spark):
    counts = spark.range(20_000).selectExpr("id * 7919 + 1 AS h", "5 + id % 3 AS c")
    words = language_model.vocabulary(counts)
    assert (words.ids != words.other).sum() == 20_000
    model = language_model.LogBilinear(words.word_counts)
    every = np.arange(len(words.word_counts))
    assert math.isclose((10 ** model.log10(every, [np.full(len(every), 5), np.full(len(every), 9000)])).sum(), 1, rel_tol=1e-4)


def test_empty_tables(spark):
    docs = frame(spark, [])
    bench = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    pages = spark.createDataFrame([], "page_id long, url string")
    rules = spark.createDataFrame(url_filters.RULES, "host string, path string, verdict string")
    made = [suffix_dedup.without_repeats(docs), super_kmers.without_repeats(docs), mixing.mix(docs).documents, sharding.with_byte_shards(docs), jaccard_join.join(docs), topk.search(vectors), url_filters.judge(pages, rules)]
    made += [toxicity.scored(docs, labels), decontamination.leaks(docs, bench), language_model.scored(docs)]
    assert [m.count() for m in made] == [0] * len(made)
