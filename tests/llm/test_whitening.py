"""Whitening against numpy on all rows."""

import math

import numpy as np
import pytest

from maskwell.llm import whitening


def brute(rows, weights="one", shown=4):
    fine = [(i, [math.floor(256.0 * float(c)) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = max(len(x) for _, x in fine)
    fine = [(i, (*x, *[0] * (width - len(x)))) for i, x in fine]
    fit = [x for _, x in fine] if weights == "count" else sorted({x for _, x in fine})
    n, total = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    m = np.array(fit, float) - np.array(total) / n
    v = m.T @ m / n
    values, axes = np.linalg.eigh(v)
    out = {}
    for i, x in fine:
        far = sum((n * c - s) ** 2 for c, s in zip(x, total, strict=True))
        for k in range(min(shown, width)):
            e = values[::-1][k]
            at = (np.array(x) - np.array(total) / n) @ axes[:, ::-1][:, k] / math.sqrt(e) if e > 1e-9 else None
            out.setdefault((i, k + 1), []).append((n, far if far < 2**63 else None, at, e / np.trace(v) if np.trace(v) > 0 else None))
    return out


def same(got, want):
    seen = {}
    for r in got:
        seen.setdefault((r["vec_id"], r["component"]), []).append(r)
    assert set(seen) == set(want) and all(len(seen[x]) == len(want[x]) for x in want)
    sign = {}
    for (_, k), values in want.items():
        rows = seen[_, k]
        key = lambda x: abs(x) if x is not None else 0
        for r, (n, far, at, share) in zip(sorted(rows, key=lambda r: key(r["whitened"])), sorted(values, key=lambda w: key(w[2])), strict=True):
            assert r["n"] == n and r["deviation"] == far
            assert (r["explained"] is None) == (share is None) and (share is None or abs(r["explained"] - share) < 1e-9)
            assert (r["whitened"] is None) == (at is None)
            if at is not None:
                assert math.isclose(abs(r["whitened"]), abs(at), rel_tol=1e-6, abs_tol=1e-6)
                if abs(at) > 1e-3:
                    assert sign.setdefault(k, r["whitened"] * at > 0) == (r["whitened"] * at > 0)


@pytest.mark.parametrize("weights", ["one", "count"])
@pytest.mark.parametrize("plain_rows", [10**6, 1])
def test_whiten(spark, weights, plain_rows):
    rng = np.random.default_rng(4)
    rows = [(i, [float(c) for c in rng.normal(0, [3, 2, 1, 0.7, 0.5], 5)]) for i in range(60)]
    rows += [(100 + i, rows[0][1]) for i in range(40)]  # one vector holds many rows
    rows += [(200, None), (201, [1.0, None, 0.0, 0.0, 0.0]), (202, [float("nan")] * 5), (203, [float("inf")] * 5), (204, []), (205, [1.5]), (None, [0.1] * 5), (7, rows[9][1]), (7, rows[7][1])]
    table = spark.createDataFrame([(i, v, "x", "x", "x") for i, v in rows], "vec_id long, embedding array<float>, x string, uses string, n string")
    got = whitening.whiten(table, weights=weights, plain_rows=plain_rows).collect()
    floats = [(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v]) for i, v in rows]
    same(got, brute(floats, weights))
    assert {r["identity_error"] for r in got} and max(r["identity_error"] for r in got) < 1e-9


def test_flat_and_empty_tables(spark):
    shape = "vec_id long, embedding array<double>"
    one = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], shape)).collect()
    assert [(r["vec_id"], r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in sorted(one)] == [(i, k, 1, 0, None, None, None) for i in (1, 2) for k in (1, 2)]
    line = [(i, [float(i), 0.0, 0.0]) for i in range(4)]
    same(whitening.whiten(spark.createDataFrame(line, shape)).collect(), brute(line))
    for rows in ([], [(1, None)], [(1, [])]):
        assert whitening.whiten(spark.createDataFrame(rows, shape)).collect() == []


def test_numbers_beyond_64_bits(spark):
    rows = [(i, [2.0**40 * i, -(2.0**41) * i * i, 1.0]) for i in range(1, 6)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    same(got, brute(rows))
    assert any(r["deviation"] is None for r in got)


def test_whiten_sf(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    got = whitening.whiten(table).collect()
    same(got, brute([(r["vec_id"], r["embedding"]) for r in table.collect()]))
    assert max(r["identity_error"] for r in got) < 1e-6
