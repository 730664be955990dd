"""N-grams numbered in portions against n-grams cut up one by one."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnish.functions import grams, text
from tarnish.operators import encoders, profile, reduction

TEXTS = ["abcab", "", "a", "Hé\U0001F600x\U0001F600\x00\x00", "x  y\n\n z", "abcab"]


def cut(t, lo, hi):
    return [t[i:i + n] for n in range(lo, hi + 1) for i in range(len(t) - n + 1)]


@pytest.mark.parametrize("table", [1, grams.TABLE])
def test_char_ngrams(monkeypatch, table):
    monkeypatch.setattr(grams, "TABLE", table)
    found = [Counter() for _ in TEXTS]
    for rows, ranks, names in grams.char_ngrams(TEXTS, 1, 4):
        assert (np.diff(rows) >= 0).all() and len(set(names)) == len(names)
        for r, k in zip(rows, ranks):
            found[r][names[k]] += 1
    assert found == [Counter(cut(t, 1, 4)) for t in TEXTS]


def test_portions():
    assert [(s.start, s.stop) for s in grams.portions(np.array([3, 3, 9, 1, 0, 5]), 6)] == [(0, 2), (2, 3), (3, 6)]


def test_totals_and_minima_equal_sql(spark):
    df = spark.createDataFrame([*enumerate(TEXTS), (9, None)], "i int, t string")
    each = text.with_ngrams(df, "t", "char", (2, 4), "g").select("i", F.explode("g").alias("gram"))
    want = {(r.gram, r["count"]) for r in each.groupBy("gram").count().collect()}
    totals = text.gram_counts(df, [], "t", "char", (2, 4))
    assert {(r.gram, r.cnt) for r in totals.collect()} == want
    # no n-gram of a single text leaves its task by itself
    assert "Generate" not in totals._jdf.queryExecution().toString()
    by_column = profile.column_grams(profile.long_columns(df, ["t"]))
    assert {(r.gram, r.n) for r in by_column.collect()} == want
    least = each.groupBy("i").agg(F.array(*[F.min(h) for h in encoders._hashes(F.col("gram"), 5, "fast")]).alias("v"))
    got = encoders.minhash_distinct(df, "i", "t", 5)
    assert {r.i: r.v for r in got.collect()} == {r.i: r.v for r in least.collect()}


def test_packed_hashes_equal_rows(spark):
    df = spark.createDataFrame([*enumerate(TEXTS), (9, None)], "i int, t string")
    want = {(r.i, r.dim): r.w for r in encoders.hashing_vectorizer(df, "i", "t", "char", (2, 3), 8).collect()}
    got = {(r.i, d): w for r in encoders.packed_hashes(df, "i", "t", "char", (2, 3), 8).collect() for d, w in zip(r.dims, r.ws)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_sparse_rows_add_up_inside_tasks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.random((40, 7)) * (rng.random((40, 7)) < 0.5)
    long = spark.createDataFrame([(i, d, float(x[i, d])) for i in range(40) for d in range(7) if x[i, d]], "i int, dim int, w double")
    rows = reduction.packed_rows(long, "i", F.col("i") < 30).repartition(5)
    factors = {d: 1.0 + d for d in range(6)}
    monkeypatch.setattr(reduction, "ENTRIES", 16)
    y = x * [*factors.values(), 0.0]
    y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-300)
    b = rng.random((7, 3))
    m = reduction.SparseRows(rows, "i", list(range(7)), factors)
    assert np.allclose(m.back(b), y[:30].T @ (y[:30] @ b)) and np.allclose(m.gram(b), (y[:30] @ b).T @ (y[:30] @ b))
    got = {r.i: r.v for r in m.project(b).collect()}
    assert all(np.allclose(got.get(i, np.zeros(3)), y[i] @ b) for i in range(40))
    plan = m.project(b)._jdf.queryExecution().toString()
    assert "Join" not in plan and "Generate" not in plan


def test_regimes_encode_the_texts_once(spark, monkeypatch):
    from tarnish.plans import model_queries
    plans, each = [], []
    monkeypatch.setattr(model_queries.models, "evaluate_encoding", lambda df, row_id, features, splits, *a, **k: each.append((df, splits)) or spark.createDataFrame(
        [([1.0], [1.0])], "accuracies array<double>, roc_auc array<double>"))
    model_queries.feature_regimes(model_queries.Tables(spark, "/root/testdata/sf0.001"))
    for tables in each:
        plans += [t._jdf.queryExecution().optimizedPlan().toString() for t in tables]
    assert len(plans) == 6 and not any("MapInPandas" in p or "Join" in p or "Window" in p for p in plans)
