"""Whitening against numpy in double precision, exact numbers, and clustered eigenvalues."""

import math

import numpy as np
import pytest

from tarnish.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, n long"


def plain(vectors, k=4):
    """The same in plain numpy: one entry per usable vector."""
    usable = [v is not None and all(c is not None and math.isfinite(c) for c in v) for v in vectors]
    xs = [tuple(math.floor(256 * float(np.float32(c))) for c in v) if ok else None for v, ok in zip(vectors, usable)]
    fit = sorted({x for x in xs if x is not None})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array(fit, float) - np.array(sums) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    return [None if x is None else (
        n, sum((n * c - s) ** 2 for c, s in zip(x, sums)),
        (np.array(x) - np.array(sums) / n) @ axes[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum()) for x in xs]


def test_against_numpy(spark):
    rng = np.random.default_rng(3)
    vectors = [list(map(float, v)) for v in rng.normal(size=(300, 9)) * np.arange(1, 10)]
    vectors += vectors[:40] + [None, [None] + vectors[0][1:], [math.nan] * 9, [math.inf] + [0.0] * 8, [-0.0] * 9]
    rows = [(i, v, i % 3) for i, v in enumerate(vectors)]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA).repartition(5)).select("vec_id", "n", "whitening.*", "whitening").collect()
    expected = plain(vectors)
    assert len(got) == 4 * sum(e is not None for e in expected)
    by = {(r.vec_id, r.whitening.component): r for r in got}
    signs = [math.copysign(1, by[0, c].whitening.whitened * expected[0][2][c - 1]) for c in range(1, 5)]
    for i, e in enumerate(expected):
        for c in range(1, 5):
            if e is None:
                assert (i, c) not in by
                continue
            r = by[i, c].whitening
            assert (r.component, r.n, r.deviation) == (c, e[0], e[1])
            assert r.whitened * signs[c - 1] == pytest.approx(e[2][c - 1], abs=1e-11)
            assert r.explained == pytest.approx(e[3][c - 1], rel=1e-12)
            assert 0 <= r.identity_error < 1e-12


@pytest.mark.parametrize("values", [
    [5, 4, 3, 2, 1, 0.5], [1, 1, 1, 1, 1, 1], [1, 1 - 1e-9, 1 - 2e-9, 0.5, 0.5, 1e-9],
    [1, 1 - 1e-7, 1 - 1e-12, 0.3, 0.3 - 1e-10, 0], [1e6, 1e6 - 1e-4, 1e-6, 1e-7, 0, 0]])
def test_eigenvectors_of_clusters(values):
    rng = np.random.default_rng(8)
    q = np.linalg.qr(rng.normal(size=(6, 6)).astype(np.longdouble).astype(float))[0]
    a = q @ np.diag(np.array(values, float)) @ q.T
    a = (a + a.T) / 2
    found, x = whitening.eigenvectors(a)
    exact = a.astype(np.longdouble)
    residual = np.abs(exact @ x - x * found).max() / np.abs(a).max()
    assert residual < 1e-15  # single precision leaves 1e-7
    assert np.abs(x.T.astype(np.longdouble) @ x - np.eye(6)).max() < 1e-15
    assert (np.diff(found) <= 0).all() and found == pytest.approx(sorted(values, reverse=True), abs=1e-15 * max(values) * 8)


def test_single_precision_alone_is_not_enough():
    rng = np.random.default_rng(1)
    a = np.cov(rng.normal(size=(64, 500)))
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(float)
    assert np.abs(x.T @ x - np.eye(64)).max() > 1e-8
    assert np.abs(a @ whitening.eigenvectors(a)[1] - whitening.eigenvectors(a)[1] * whitening.eigenvectors(a)[0]).max() < 1e-14


def test_few_dimensions_rank_and_ragged_lengths(spark):
    # two dimensions that are one line, one vector of another length
    rows = [(i, [i / 256, 2 * i / 256], 0) for i in range(10)] + [(99, [1.0, 2.0, 3.0], 0)]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).select("vec_id", "whitening.*").collect()
    assert len(got) == 20 and {r.vec_id for r in got} == set(range(10))
    for r in got:
        assert (r.whitened is None) == (r.component == 2) and r.identity_error is None
        assert r.explained == pytest.approx(2 - r.component, abs=1e-12)


def test_empty_one_vector_and_large_numbers(spark):
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, [], 0), (2, None, 0)], SCHEMA)).collect() == []
    one = whitening.whiten(spark.createDataFrame([(1, [3.0, 1.0], 7)] * 3, SCHEMA)).collect()
    assert len(one) == 6 and {(r.n, r.whitening.n, r.whitening.deviation, r.whitening.whitened, r.whitening.explained) for r in one} == {
        (7, 1, 0, None, None)}
    far = whitening.whiten(spark.createDataFrame([(1, [1e30, 0.0], 7), (2, [-1e30, 0.0], 7), (3, [0.0, 1.0], 7)], SCHEMA)).collect()
    assert {r.whitening.deviation for r in far if r.vec_id < 3} == {None}
    assert [r.whitening.whitened is not None for r in far if r.whitening.component == 1] == [True] * 3


def test_clashing_columns(spark):
    df = spark.createDataFrame([(i, [float(i), float(i * i)], i, "x", 1) for i in range(5)],
                               "vec_id long, v array<double>, _x long, whitening string, _w int")
    got = whitening.whiten(df, "v")
    assert got.columns == ["vec_id", "_x", "_w", "whitening"] and got.count() == 10
    assert {r._x == r.vec_id for r in got.collect()} == {True}


def test_query_on_the_table(spark):
    from tarnish.llm.queries import QUERIES
    folder = "/root/testdata/sf0.001"
    got = QUERIES["op12_embedding_whitening"](spark, folder).collect()
    table = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    expected = {r.vec_id: e for r, e in zip(table, plain([r.embedding for r in table]))}
    signs = {}
    assert len(got) == 4 * len([e for e in expected.values() if e])
    for r in got:
        e = expected[r.vec_id]
        sign = signs.setdefault(r.component, math.copysign(1, r.whitened * e[2][r.component - 1]))
        assert (r.n, r.deviation) == e[:2] and r.identity_error < 1e-10
        assert r.whitened * sign == pytest.approx(e[2][r.component - 1], abs=1e-9)
        assert r.explained == pytest.approx(e[3][r.component - 1], rel=1e-10)
