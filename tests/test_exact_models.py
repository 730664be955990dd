"""Evaluations with a known result: the cheap ones against DuckDB, and features that hold only rounding."""

import duckdb
import pytest

from tarnish.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["logistic_regression_exact", "linear_regression_exact", "evaluate_encoding_exact"])
def test_query_equals_sql(spark, name):
    registry.load_all()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{SF}/customer.parquet'")
    cur = con.execute(registry.ORACLES[name])
    names = [d[0] for d in cur.description]
    want = sorted(cur.fetchall(), key=str)
    got = registry.QUERIES[name](spark, SF)
    assert set(got.columns) == set(names)
    rows = sorted([tuple(r[c] for c in names) for r in got.collect()], key=str)
    assert [r[:1] for r in rows] == [r[:1] for r in want] and len(rows) == len(want)
    for r, w in zip(rows, want):
        assert r == pytest.approx(w)


def test_components_beyond_the_rank_are_ignored(spark):
    """Two different vectors have one component; the second is rounding, and must not stop the fit."""
    from pyspark.ml import Pipeline
    from pyspark.sql import functions as F
    from tarnish.operators.models import Features, UnitLogistic, with_vectors
    rows = [(i, [0.1, 0.7, 30.3] if i % 3 else [0.9, 0.2, 11.7], float(i % 3 == 0)) for i in range(60)]
    df = with_vectors(spark.createDataFrame(rows, "id int, v array<double>, y double"), ["v"])
    model = Pipeline(stages=[*Features(["v"], reductions={"v": 2}).stages(True), UnitLogistic()]).fit(df)
    assert model.transform(df).where(F.col("prediction") != F.col("y")).count() == 0


def test_splits_are_placed_once_and_models_read_each_other(spark):
    from pyspark.ml import Pipeline
    from pyspark.sql import functions as F
    from tarnish.operators.models import Features, Placed, UnitLogistic, stack_inputs
    rows = [(i, float(i % 2), float(i % 5), float(i % 2)) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, a double, b double, y double")
    splits = df.crossJoin(spark.range(2).withColumnRenamed("id", "split_id")).where("id < 30").select(
        "split_id", "id", F.when(F.col("id") % 3 == F.col("split_id"), "test").otherwise("train").alias("role"))
    placed = Placed.of(df, "id", splits)
    assert placed.ids == [0, 1] and placed.sizes == {"n_train": 20, "n_test": 10}
    for s in placed.ids:
        assert sorted(r.id for r in placed.part(s, "test").collect()) == [i for i in range(30) if i % 3 == s]
    train = placed.part(0, "train")
    models = [Pipeline(stages=[*Features(numbers=[c]).stages(True), UnitLogistic()]).fit(train) for c in "ab"]
    stacked = stack_inputs(train, "id", models)
    # neither the part of a split nor the other model's probabilities are joined
    plan = stacked._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    assert stacked.columns == ["id", "y", "features"] and {len(r.features) for r in stacked.collect()} == {2}
