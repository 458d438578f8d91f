"""Whitening against plain numpy, and its odd cases."""

import numpy as np
import pytest

from glimmer.llm import whitening
from glimmer.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
KIND = "vec_id long, embedding array<double>, n string"


def plain(vectors):
    """x, n, S, eigenvalues and unit eigenvectors by falling eigenvalue, from the definition."""
    x = np.floor(64 * np.array(vectors, np.float64)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    z = fit - s / n
    e, u = np.linalg.eigh(z.T @ z / n)
    return x, n, s, e[::-1], u[:, ::-1]


def agrees(rows, ids, vectors, components):
    x, n, s, e, u = plain(vectors)
    by = {}
    for r in rows:
        by.setdefault(r["component"], {}).setdefault(r["vec_id"], r)
    assert sorted(by) == list(range(1, components + 1)) and len(rows) == components * len(ids)
    for k in range(components):
        mine = np.array([by[k + 1][i]["whitened"] for i in ids])
        want = (x - s / n) @ u[:, k] / np.sqrt(e[k])
        assert min(np.abs(mine - want).max(), np.abs(mine + want).max()) < 1e-8
        for i, v in zip(ids, x, strict=True):
            r = by[k + 1][i]
            assert (r["n"], r["deviation"]) == (n, int(((n * v - s) ** 2).sum()))
            assert abs(r["explained"] - e[k] / e.sum()) < 1e-9 and r["identity_error"] < 1e-6


def test_query(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    agrees(QUERIES["op12_whitening"](spark, SF).collect(), [r["vec_id"] for r in rows], [r["embedding"] for r in rows], 16)


@pytest.mark.parametrize("dims", [1, 5, 37])
def test_tiles_of_any_width(spark, monkeypatch, dims):
    """Widths that are no multiple of a tile, several row blocks, copies that count once in the fit list."""
    monkeypatch.setattr(whitening, "TILE", 4)
    monkeypatch.setattr(whitening, "ROWS", 16)
    v = np.random.default_rng(dims).normal(size=(150, dims)) * np.arange(1, dims + 1)
    v = np.concatenate((v, v[:20]))
    df = spark.createDataFrame([(i, r.tolist(), "x") for i, r in enumerate(v)], KIND).repartition(5)
    agrees(whitening.whiten(df).collect(), list(range(len(v))), v, min(16, dims))


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    good = [[1.0, 0.5], [0.0, 2.0], [-3.0, 1.0], [-3.0, 1.0]]
    odd = [None, [], [None, 1.0], [nan, 1.0], [inf, 1.0], [1e300, 1.0], [1.0, 2.0, 3.0]]
    rows = [(i, v, "x") for i, v in enumerate(good)] + [(None, good[0], "x"), (0, good[0], "x")] + [(9, v, None) for v in odd]
    got = whitening.whiten(spark.createDataFrame(rows, KIND)).collect()
    first = [r for r in got if r["component"] == 1]
    assert sorted(str(r["vec_id"]) for r in first) == ["0", "0", "1", "2", "3", "None"] and {r["n"] for r in got} == {3}
    agrees([r for r in got if r["vec_id"] in (1, 2, 3)] + [r for r in got if r["vec_id"] == 0][: 2 if got[0]["component"] == 1 else 0], [1, 2, 3, 0], [good[1], good[2], good[3], good[0]], 2)


def test_nothing_to_whiten(spark):
    for rows in ([], [(1, None, "x")], [(1, [1.0, 2.0], "x"), (2, [1.0, 2.0], "x")]):
        out = whitening.whiten(spark.createDataFrame(rows, KIND))
        assert out.count() == 0 and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    line = [(i, [float(i), 2.0 * i, 7.0], "x") for i in range(10)]  # one direction varies
    assert {r["component"] for r in whitening.whiten(spark.createDataFrame(line, KIND)).collect()} == {1}


def test_large_numbers_stay_exact(spark):
    rows = [(1, [2.0**40, 1.0], "x"), (2, [0.0, -(2.0**40)], "x"), (3, [5.0, 5.0], "x")]
    x, n, s, *_ = plain([r[1] for r in rows])
    want = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(v, s, strict=True)) for v in x]
    got = {r["vec_id"]: r["deviation"] for r in whitening.whiten(spark.createDataFrame(rows, KIND)).collect()}
    assert got == {i + 1: w if w < 1 << 63 else None for i, w in enumerate(want)} and None in got.values()
