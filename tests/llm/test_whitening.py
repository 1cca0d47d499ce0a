"""Whitening against plain integers and double covariances."""

import os
from fractions import Fraction

import numpy as np
import pytest

from paperloom.llm.residue_whitening import covariance, primes, whiten

SCHEMA = "vec_id bigint, embedding array<double>, label int"


def plain(rows, scale=256):
    """(n, S, exact covariance as fractions, kept rows) of (id, vector) rows of one length."""
    kept = [(i, [int(np.floor(c * scale)) for c in v]) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, dim = len(fit), len(fit[0])
    sums = [sum(x[j] for x in fit) for j in range(dim)]
    v = [[Fraction(sum((n * x[i] - sums[i]) * (n * x[j] - sums[j]) for x in fit), n**3) for j in range(dim)] for i in range(dim)]
    return n, sums, v, kept, fit


def vectors(seed, n, dim, size=1.0):
    r = np.random.default_rng(seed)
    return (r.normal(size=(n, dim)) * size * np.linspace(1, 3, dim)).tolist()


@pytest.mark.parametrize("size", [1.0, 1e6, 1e15])
def test_whitening_against_plain_integers(spark, size):
    rows = [(i, v) for i, v in enumerate(vectors(1, 60, 6, size))]
    rows += [(100 + i, rows[3][1]) for i in range(30)] + [(None, rows[4][1]), (5, rows[9][1]), (200, None), (201, [None] * 6), (202, [float("nan")] + [0.0] * 5), (203, [float("inf")] * 6), (204, [1.0, 2.0]), (205, [])]
    df = spark.createDataFrame([(i, v, None) for i, v in rows], SCHEMA).repartition(3)
    n, sums, v, kept, fit = plain([r for r in rows if r[1] is None or len(r[1]) == 6])
    cov = np.array([[float(c) for c in row] for row in v])
    got = whiten(df, carry=["vec_id"]).collect()
    assert len(got) == 4 * len(kept) and {r["n"] for r in got} == {n}
    values, axes = np.linalg.eigh(cov)
    order = np.argsort(-values)[:4]
    assert sorted((r["vec_id"] is None, r["vec_id"] or 0, r["component"]) for r in got) == sorted((i is None, i or 0, k) for i, _ in kept for k in (1, 2, 3, 4))
    by = {}
    for r in got:
        by.setdefault((r["vec_id"], r["component"]), []).append(r)
    for i, x in kept:
        dev = sum((n * a - s) ** 2 for a, s in zip(x, sums))
        centred = np.array([float(Fraction(n * a - s, n)) for a, s in zip(x, sums)])
        for k, at in enumerate(order):
            expected = abs(centred @ axes[:, at]) / np.sqrt(values[at])
            assert any(r["deviation"] == (dev if dev < 10**38 else None) and abs(abs(r["whitened"]) - expected) < 1e-7 for r in by[i, k + 1])
            assert all(abs(r["explained"] / (values[at] / np.trace(cov)) - 1) < 1e-9 for r in by[i, k + 1])
    assert all(r["identity_error"] < 1e-6 for r in got)


def test_scatter_is_exact(spark):
    x = [[2**40 + i * i, -(3**20) * i, 7 * i % 5] for i in range(50)]
    n, sums = 50, [sum(r[j] for r in x) for j in range(3)]
    bound = max(abs(n * r[j] - sums[j]) for r in x for j in range(3))
    got = covariance(spark.createDataFrame([(r,) for r in x], "_x array<bigint>").repartition(7), 3, n, sums, bound)
    for i in range(3):
        for j in range(3):
            assert got[i, j] == sum((n * r[i] - sums[i]) * (n * r[j] - sums[j]) for r in x) / n**3


def test_primes_are_enough():
    found = primes(1 << 200)
    assert len(found) == 11 and all(p < 1 << 20 and all(p % q for q in range(2, 1024)) for p in found)


def test_whitening_of_little(spark):
    empty = whiten(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and empty.columns == ["vec_id", "label", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    one = whiten(spark.createDataFrame([(1, [1.0, 2.0], 3)], SCHEMA)).collect()
    assert [(r["component"], r["n"], int(r["deviation"]), r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(1, 1, 0, None, None, None), (2, 1, 0, None, None, None)]
    flat = whiten(spark.createDataFrame([(i, [float(i), 2.0, -float(i)], 3) for i in range(5)], SCHEMA)).collect()  # one direction only
    assert all((r["whitened"] is None) == (r["component"] > 1) for r in flat) and all(r["identity_error"] < 1e-9 for r in flat)
    assert [r for r in whiten(spark.createDataFrame([(1, [], 3)], SCHEMA)).collect()] == []


def test_whitening_with_clashing_names(spark):
    df = spark.createDataFrame([(i, v, "x", 1, 2) for i, v in enumerate(vectors(2, 20, 3))], "`vec.id` bigint, embedding array<float>, _x string, component int, _1 int")
    got = whiten(df)
    assert got.columns == ["vec.id", "_x", "component", "_1", "component", "n", "deviation", "whitened", "explained", "identity_error"] and len(got.collect()) == 60


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_whitening_of_the_table(spark):
    from paperloom.llm.queries import op11_residue_whitening

    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()
    n, sums, v, kept, fit = plain([(r["vec_id"], r["embedding"]) for r in table])
    got = op11_residue_whitening(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == 4 * len(kept)
    cov = np.array([[float(c) for c in row] for row in v])
    values = np.linalg.eigvalsh(cov)[::-1]
    w = {(r["vec_id"], r["component"]): r for r in got}
    first = {}
    for i, x in kept:
        assert w[i, 1]["deviation"] == sum((n * a - s) ** 2 for a, s in zip(x, sums))
        first.setdefault(tuple(x), i)
    white = np.array([[w[first[x], k]["whitened"] for k in (1, 2, 3, 4)] for x in fit])
    error = np.abs(np.cov(white.T, bias=True) - np.eye(4)).max()
    assert error < 1e-9 and all(r["identity_error"] < 1e-9 for r in got)
    assert all(abs(w[kept[0][0], k]["explained"] / (values[k - 1] / np.trace(cov)) - 1) < 1e-9 for k in (1, 2, 3, 4))
