"""Linked vectors against all pairs."""

import numpy as np
import pytest

from paperloom.llm import cross_polytope
from paperloom.llm.cross_polytope import hadamard, linked_rows, near_duplicates, plan

SCHEMA = "vec_id bigint, embedding array<double>, label int"


def plain(rows, threshold=0.98):
    """{id: (links, component)} of (id, vector, label) rows with ids of their own."""
    ids = [r[0] for r in rows]
    good = [r for r in rows if r[1] and r[2] is not None and all(c is not None and np.isfinite(c) for c in r[1]) and any(r[1])]
    near = {i: set() for i in ids}
    for a in good:
        for b in good:
            if a[0] < b[0] and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1]), np.array(b[1])
                x, y = x / np.abs(x).max(), y / np.abs(y).max()
                if x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= threshold:
                    near[a[0]].add(b[0])
                    near[b[0]].add(a[0])
    out = {}
    for i in ids:
        seen, todo = {i}, [i]
        while todo:
            todo += (new := near[todo.pop()] - seen)
            seen |= new
        out[i] = len(near[i]), min(seen)
    return out


def families(seed, dim, bases, members, spread, labels=3):
    """Vectors in families whose cosines lie about the threshold, some equal, some scaled."""
    r, rows = np.random.default_rng(seed), []
    for _ in range(bases):
        base, label = r.normal(size=dim), int(r.integers(labels))
        for _ in range(int(r.integers(1, members))):
            v = base + r.normal(size=dim) * r.uniform(0, spread) * np.linalg.norm(base) / dim**0.5
            rows.append((v * float(r.choice([1.0, 1e-3, 1e200]))).tolist() + [label])
    rows += [rows[i] for i in r.integers(0, len(rows), 10)]
    order = r.permutation(len(rows))
    return [(int(i), rows[at][:-1], rows[at][-1]) for i, at in enumerate(order)]


@pytest.mark.parametrize("dim,block", [(2, 1024), (24, 1024), (24, 7), (64, 16), (1, 1024)])
def test_links_against_all_pairs(spark, monkeypatch, dim, block):
    monkeypatch.setattr(cross_polytope, "BLOCK", block)
    rows = families(dim, dim, 12, 30, 0.25)
    got = linked_rows(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == plain(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_chains_join(spark):
    turn = [[float(np.cos(a)), float(np.sin(a)), 0.0] for a in np.arange(20) * 0.15]  # neighbours alone are near
    rows = [(int(i), turn[k], 1) for k, i in enumerate(np.random.default_rng(5).permutation(20))]
    got = linked_rows(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == plain(rows) and {r["component_id"] for r in got} == {0}


def test_odd_vectors(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 1), (2, None, 1), (3, [], 1), (4, [0.0, 0.0, 0.0], 1), (5, [1.0, None, 3.0], 1), (6, [float("nan"), 2.0, 3.0], 1), (7, [float("inf"), 2.0, 3.0], 1), (8, v, None), (9, v, 2), (10, v + [0.0], 1), (11, [2.0, 4.0, 6.0], 1), (12, [-1.0, -2.0, -3.0], 1), (13, [0.0, 1.0, 0.0], 5), (14, [-0.0, 1.0, 0.0], 5)]
    got = linked_rows(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == plain(rows)
    assert {r["vec_id"] for r in got if r["n_links"]} == {1, 11, 13, 14}
    more = [(None, v, 1), (1, v, 1), (1, [0.0, 0.0, 1.0], 1), (1, v, 1), (20, v, 1)]  # null and repeated ids
    got = sorted((r["vec_id"] or -1, r["n_links"], r["component_id"], r["kept"]) for r in linked_rows(spark.createDataFrame(more, SCHEMA)).collect())
    assert got == [(-1, 0, None, False), (1, 0, 1, True), (1, 2, 1, True), (1, 2, 1, True), (20, 2, 1, False)]
    assert linked_rows(spark.createDataFrame([], SCHEMA)).count() == 0


def test_near_duplicates_keeps_columns(spark):
    rows = [(1, [1.0, 2.0], "a", 7), (2, [1.0, 2.001], "a", 8), (3, [2.0, -1.0], "a", 9), (None, [1.0, 2.0], "a", 10)]
    df = spark.createDataFrame(rows, "`vec.id` bigint, v array<float>, id string, n_links int")
    got = near_duplicates(df, "vec.id", "v", "id")
    assert got.columns == df.columns and sorted(r[3] for r in got.collect()) == [7, 9, 10]


def test_tables_grow_with_dimension_and_rows():
    x = np.random.default_rng(1).normal(size=(3, 8))
    assert np.allclose((hadamard(x) ** 2).sum(1), (x**2).sum(1)) and np.allclose(hadamard(hadamard(x)), x)
    assert plan(1000, 64)[0] < plan(10**9, 64)[0] and plan(10**6, 64)[1] <= plan(10**7, 64)[1]
