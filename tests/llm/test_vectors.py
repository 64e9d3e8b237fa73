"""Nearest neighbours and whitening against brute force, on small tables with nulls, empty and zero
vectors, ties, copies, repeated ids and clashing columns, and on the given tables."""

import collections
import math
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from terrace.llm import neighbours as nb
from terrace.llm import queries as registered
from terrace.llm import whitening

SMALL, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
given = pytest.mark.skipif(not os.path.isdir(LARGER), reason="the test tables are not here")
SCHEMA = "vec_id bigint, embedding array<float>"
NAN, INF = float("nan"), float("inf")
ODD = [(1000, None), (1001, []), (1002, [0.0, 0.0, 0.0]), (1003, [1.0, None, 2.0]), (1004, [NAN, 1.0, 1.0]), (1005, [1.0, -INF, 1.0])]


def clashing(df):
    names = ("vector", "cell", "part", "salt", "ids", "near", "rank", "score", "n", "component", "block", "vector_key")
    return df.withColumns({c: F.lit("x") for c in names})


def table(folder):
    return duckdb.sql(f"select vec_id, embedding from '{folder}/embeddings.parquet'").fetchall()


# ---- 12 ----------------------------------------------------------------------------------------


def brute_nearest(rows, k, every):
    """{query id: [sorted (rank, id, score) lists, one for each of its rows]}: rows of (id, vector), repeated ones once."""
    kept = sorted({(i, tuple(np.float32(x).item() for x in v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)})
    dims = max((len(v) for _, v in kept), default=0)
    x = np.array([[*v, *[0.0] * (dims - len(v))] for _, v in kept])
    out = collections.defaultdict(list)
    for at, (i, _) in enumerate(kept):
        if i % every == 0:
            scores = [float((x[at] * y).sum()) for y in x]
            others = sorted((-s, kept[j][0]) for j, s in enumerate(scores) if j != at)[:k]
            out[i].append([(r + 1, c, -s) for r, (s, c) in enumerate(others)])
    return {i: sorted(found) for i, found in out.items()}


def gathered(df):
    """What a search gave, like brute_nearest's; the rows of one id are told apart by rank and order."""
    out = collections.defaultdict(list)
    for r in df.collect():
        out[r.query_id].append((r.rank, r.vec_id, r.score))
    return out


def same(got, expected):
    assert {i for i, e in expected.items() if any(e)} == set(got)
    for i, found in expected.items():
        assert sorted(got[i]) == sorted(x for some in found for x in some)


def made_vectors(draw, n=700):
    rows = [(int(i), [float(x) for x in draw.normal(size=3).astype(np.float32) * draw.choice([0.1, 1, 10])]) for i in range(n)]
    rows += [(2000 + i, [1.0, 2.0, 3.0]) for i in range(400)]  # a group of copies
    rows += [(20, [5.0, 5.0, 5.0]), (20, [5.0, 5.0, 5.0]), (20, [-1.0, 0.0, 2.0]), (None, [1.0, 1.0, 1.0]), (40, [2.0]), *ODD]
    return rows


@pytest.mark.parametrize("sizes", [{}, {"tree_rows": 60, "block": 16}, {"tree_rows": 200, "pivots": 2}])
def test_exact_with_factor_one(spark, sizes):
    rows = made_vectors(np.random.default_rng(1))
    got = nb.neighbours(clashing(spark.createDataFrame(rows, SCHEMA)).repartition(5), k=6, every=20, factor=1.0, **sizes)
    same(gathered(got), brute_nearest(rows, 6, 20))


def test_few_candidates_and_empty_table(spark):
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (3, [0.5, 0.5])]
    same(gathered(nb.neighbours(spark.createDataFrame(rows, SCHEMA))), brute_nearest(rows, 20, 20))
    assert nb.neighbours(spark.createDataFrame([(0, [1.0])], SCHEMA)).collect() == []
    assert nb.neighbours(spark.createDataFrame(ODD, SCHEMA)).collect() == []
    assert nb.neighbours(spark.createDataFrame([], SCHEMA)).collect() == []


def test_bounds_are_below_distances():
    draw = np.random.default_rng(2)
    points, queries = draw.normal(size=(1000, 5)), draw.normal(size=(30, 5))
    tree = nb.Tree.over(points, leaf=20)
    assert sorted(tree.order.tolist()) == list(range(1000))
    bounds = tree.least_distances(queries)
    for leaf in range(bounds.shape[1]):
        held = points[tree.order[tree.bounds[leaf] : tree.bounds[leaf + 1]]]
        assert 0 < len(held) <= 20
        apart = np.sqrt(((queries[:, None] - held) ** 2).sum(axis=2)).min(axis=1)
        assert (bounds[:, leaf] <= apart + 1e-7).all()


def test_a_larger_factor_visits_less():
    draw = np.random.default_rng(3)
    points = draw.normal(size=(2000, 3))
    largest = float(np.sqrt((points**2).sum(axis=1)).max())
    tree, ids, seen = nb.Tree.over(nb._lifted(points, largest)), [np.array([i]) for i in range(2000)], {}

    class Counting(nb.Best):
        def offer(self, which, points, ids, slack):
            seen[factor] = seen.get(factor, 0) + len(which)
            super().offer(which, points, ids, slack)

    for factor in (1.0, 2.0, 8.0):
        nb.search(tree, points, ids, Counting(points[:100], 5), largest, factor)
    assert seen[1.0] > seen[2.0] > seen[8.0]


@given
def test_op12(spark):
    rows = table(LARGER)
    expected = brute_nearest(rows, 20, 20)
    df = registered.queries()["op12_neighbours"](spark, LARGER)
    assert df.columns == ["query_id", "rank", "vec_id", "score"]
    got = gathered(df)
    assert set(got) == set(expected)
    hits = 0
    for i, ((true),) in expected.items():
        found = sorted(got[i])
        assert [r for r, _, _ in found] == list(range(1, 21)) and [(-s, v) for _, v, s in found] == sorted((-s, v) for _, v, s in found)
        hits += len({v for _, v, _ in found} & {v for _, v, _ in true})
    print("recall", hits / (20 * len(expected)))
    assert hits >= 0.97 * 20 * len(expected)


# ---- 13 ----------------------------------------------------------------------------------------


def brute_whitening(rows, most=8):
    kept = [(i, v) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dims = max(len(v) for _, v in kept)
    x = np.array([[math.floor(1024 * np.float32(c).item()) + 100_000 for c in [*v, *[0.0] * (dims - len(v))]] for _, v in kept], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    centred = x.astype(float) - np.array([s / n for s in sums])
    covariance = centred.T @ centred / n
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1][:most], axes[:, ::-1][:, :most]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(r, sums, strict=True)) for r in x]
    return [i for i, _ in kept], n, deviation, centred @ axes / np.sqrt(values), values / np.trace(covariance)


def same_whitening(got, rows):
    ids, n, deviation, projected, explained = brute_whitening(rows)
    some = len(explained)
    assert len(got) == len(ids) * some and all(r.n == n and r.identity_error < 1e-4 for r in got)
    by = collections.defaultdict(dict)
    for r in sorted(got, key=lambda r: r.component):
        by[r.vec_id, r.deviation].setdefault(r.component, []).append(r)
        assert abs(r.explained / explained[r.component - 1] - 1) < 1e-9
    sign = {}
    for i, d, w in zip(ids, deviation, projected, strict=True):
        found = by[i, d]
        for c in range(some):
            near = min(found[c + 1], key=lambda r: abs(abs(r.whitened) - abs(w[c])))
            assert abs(abs(near.whitened) - abs(w[c])) < 1e-6
            if abs(w[c]) > 1e-3:
                assert sign.setdefault(c, near.whitened * w[c] > 0) == (near.whitened * w[c] > 0)


def test_whitening_edges(spark):
    draw = np.random.default_rng(4)
    spread = np.array([100, 10, 3, 1, 0.3])
    rows = [(i // 2, [float(np.float32(x)) for x in draw.normal(size=5) * spread]) for i in range(300)]
    rows += [(None, [1.0, 2.0, 3.0, 4.0, 5.0]), (7, [0.5, 0.5]), *rows[:3], *[r for r in ODD if r[0] != 1001], (8, [])]
    got = whitening.whitened(clashing(spark.createDataFrame(rows, SCHEMA)).repartition(3)).collect()
    same_whitening(got, rows)


@pytest.mark.parametrize("rows", [[], ODD[:1], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 4, [(1, [])]])
def test_nothing_varies(spark, rows):
    assert whitening.whitened(spark.createDataFrame(rows, SCHEMA)).collect() == []


def test_deviation_beyond_a_long_is_null(spark):
    rows = [(i, [float(s * (1 << 40)), 1.0]) for i, s in enumerate((1, -1, 1, -1))] + [(9, [float(1 << 43), 1.0])]
    got = whitening.whitened(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    assert {r.vec_id for r in got} == {0, 1, 2, 3} and all(r.deviation is None and abs(abs(r.whitened) - 1) < 1e-9 for r in got)


def test_jacobi_finds_small_eigenvalues():
    draw = np.random.default_rng(5)
    q, _ = np.linalg.qr(draw.normal(size=(20, 20)))
    values = 10.0 ** np.linspace(8, -6, 20)
    scaled = (q * values) @ q.T
    found, axes = whitening.jacobi((scaled + scaled.T) / 2)
    assert np.allclose(found[:12], values[:12], rtol=1e-9) and np.abs(axes.T @ axes - np.eye(20)).max() < 1e-12
    graded = np.diag(values) + 1e-3 * np.sqrt(np.outer(values, values)) * (1 - np.eye(20))
    found, axes = whitening.jacobi(graded)  # the smallest of 14 orders of magnitude is right to nine figures
    true = 1 / np.linalg.eigvalsh(np.linalg.inv(graded / np.sqrt(np.outer(values, values))) / np.sqrt(np.outer(values, values)))[-1]
    assert abs(found[-1] / true - 1) < 1e-9


@given
def test_op13(spark):
    df = registered.queries()["op13_whitening"](spark, SMALL)
    assert df.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    same_whitening(df.collect(), table(SMALL))
