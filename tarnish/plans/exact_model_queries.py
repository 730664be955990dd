"""Model evaluations whose result is known in closed form, so SQL can state it.

Customers get a label from their nation, a text and a number that tell the label (*separating*), and a
text and a number that are the same for all (*independent*). On the former every classifier here
reaches an accuracy and an AUC of exactly one; on the latter all it can do is to name the more frequent
class of its training rows, which is right for that class's share of the test rows, at an AUC of one
half. Linear regression is compared with the normal equations.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tarnish.operators import models
from tarnish.operators.encoders import encode
from tarnish.operators.models import Features, with_vectors
from tarnish.operators.splits import kfold_contiguous
from tarnish.plans.model_queries import folds, halves
from tarnish.plans.registry import Tables, query

LABEL = "CASE WHEN c_nationkey < 9 THEN 1 ELSE 0 END"
TELLS, SAME = f"CASE WHEN {LABEL} = 1 THEN 'granite harbour' ELSE 'velvet meadow' END", "'one text for all'"
SPEC, SPLITS = "skrub__minhash_10", 3


def customers(t: Tables) -> DataFrame:
    return t.customer.selectExpr(
        "c_custkey", f"CAST({LABEL} AS DOUBLE) AS y", f"{TELLS} AS tells", f"{SAME} AS same",
        f"CAST(1000 * {LABEL} + c_custkey % 7 AS DOUBLE) AS telling", "CAST(3 AS DOUBLE) AS level")


def vectors(t: Tables) -> DataFrame:
    df = customers(t)
    for c in ("tells", "same"):
        # minima lie near zero: spread out, so that the penalty of the unscaled model matters little
        df = encode(df, c, SPEC, f"{c}_v").withColumn(f"{c}_v", F.transform(f"{c}_v", lambda x: x * 100))
    return with_vectors(df, ["tells_v", "same_v"])


def by_fold(records: DataFrame, *metrics: str) -> DataFrame:
    """One row per split: its number, the labels and the metrics."""
    labels = [c for c in records.columns if c not in metrics]
    return records.select(*labels, F.posexplode(F.arrays_zip(*metrics)).alias("fold", "m")).select(*labels, "fold", "m.*")


def told(records: dict[str, DataFrame], label: str = "feature") -> DataFrame:
    """One row per case and split; ``feature`` says what the model could see."""
    each = [by_fold(r, "accuracies", "roc_auc").withColumn(label, F.lit(k)) for k, r in records.items()]
    every = reduce(DataFrame.unionByName, [x.select(label, "fold", "accuracies", "roc_auc") for x in each])
    return every.withColumns({c: F.round(c, 6) for c in ("accuracies", "roc_auc")})


def classifier_sql(separating: list[str], independent: list[str], label: str = "feature") -> str:
    """The expected rows for the cases that see a separating feature and for those that don't."""
    cases = [f"SELECT '{x}' AS {label}, fold, 1.0::DOUBLE AS accuracies, 1.0::DOUBLE AS roc_auc FROM found" for x in separating]
    cases += [f"SELECT '{x}', fold, round(CASE WHEN train > 0.5 THEN test ELSE 1 - test END, 6), 0.5::DOUBLE FROM found" for x in independent]
    return f"""
WITH placed AS (
  SELECT split_id, {LABEL} AS y, count(*) OVER (PARTITION BY split_id) // 2 AS half,
    row_number() OVER (PARTITION BY split_id ORDER BY md5(concat('42:', CAST(split_id AS VARCHAR), ':', CAST(c_custkey AS VARCHAR))), c_custkey) AS p
  FROM customer, (SELECT unnest(range({SPLITS})) AS split_id)),
found AS (SELECT split_id::INT AS fold, avg(y) FILTER (p <= half) AS train, avg(y) FILTER (p > half) AS test FROM placed GROUP BY split_id)
{" UNION ALL ".join(cases)}"""


BOTH = classifier_sql(["separating"], ["independent"])


def pair(t: Tables, df: DataFrame, separating: Features, independent: Features, model: str = "LogisticRegression", **params) -> DataFrame:
    placed = models.Placed.of(df, "c_custkey", halves(t.customer, "c_custkey", SPLITS))
    return told({name: models.evaluate_encoding(placed, "c_custkey", features, None, model, {}, **params)
                 for name, features in (("separating", separating), ("independent", independent))})


@query("evaluate_encoding_exact", BOTH)
def evaluate_encoding_exact(t: Tables) -> DataFrame:
    return pair(t, vectors(t), Features(["tells_v", "same_v"]), Features(["same_v"], ["level"]))


@query("evaluate_multi_reduction_exact", BOTH)
def evaluate_multi_reduction_exact(t: Tables) -> DataFrame:
    return pair(t, vectors(t), Features(["tells_v", "same_v"], reductions={"tells_v": 2, "same_v": 1}),
                Features(["same_v"], ["level"], reductions={"same_v": 2}))


@query("evaluate_ngram_matrix_exact", BOTH)
def evaluate_ngram_matrix_exact(t: Tables) -> DataFrame:
    df = customers(t)
    splits = halves(df, "c_custkey", SPLITS)
    return told({name: models.evaluate_ngram_matrix(df, "c_custkey", texts, [], splits, "LogisticRegression", {}, components=2,
                                                    tfidf=True, features="text_only")
                 for name, texts in (("separating", ["tells"]), ("independent", ["same"]))})


@query("feature_regimes_exact", classifier_sql(["all", "text_only"], ["rest_only"]))
def feature_regimes_exact(t: Tables) -> DataFrame:
    placed = models.Placed.of(vectors(t), "c_custkey", halves(t.customer, "c_custkey", SPLITS))
    features = Features(["tells_v"], ["level"])
    return told({r: models.evaluate_encoding(placed, "c_custkey", features.regime(r, ["tells_v"]), None, "LogisticRegression", {})
                 for r in models.FEATURES})


@query("logistic_regression_exact", BOTH)
def logistic_regression_exact(t: Tables) -> DataFrame:
    return pair(t, customers(t), Features(numbers=["telling", "level"]), Features(numbers=["level"]))


@query("gbt_classifier_exact", BOTH)
def gbt_classifier_exact(t: Tables) -> DataFrame:
    return pair(t, customers(t), Features(numbers=["telling", "level"]), Features(numbers=["level"]), "GradientBoostingClassifier", trees=10)


def ensembles(t: Tables, aggregation: str) -> DataFrame:
    placed = models.Placed.of(vectors(t), "c_custkey", halves(t.customer, "c_custkey", SPLITS))
    cases = {"separating": (Features(["tells_v"]), Features(numbers=["level"])),
             "independent": (Features(["same_v"]), Features(numbers=["level"]))}
    return told({name: models.evaluate_ensemble(placed, "c_custkey", text, rest, None, "LogisticRegression", "LogisticRegression",
                                                aggregation, {}) for name, (text, rest) in cases.items()})


@query("ensemble_voting_exact", BOTH)
def ensemble_voting_exact(t: Tables) -> DataFrame:
    return ensembles(t, "voting")


@query("ensemble_stacking_exact", BOTH)
def ensemble_stacking_exact(t: Tables) -> DataFrame:
    return ensembles(t, "stacking")


@query("column_replacement_ablation_exact", classifier_sql(
    ["same/all", "same/text_only", "no_column/all", "no_column/text_only"], ["tells/all", "tells/text_only"], "replaced"))
def column_replacement_ablation_exact(t: Tables) -> DataFrame:
    """Without the column that tells nothing is left to learn from; without the other nothing is lost."""
    df = customers(t)
    total = df.count()
    found = models.column_replacement_ablation(df, "c_custkey", ["tells", "same"], ["level"], SPEC, "drop", halves(df, "c_custkey", SPLITS),
                                               "GradientBoostingClassifier", {}, total // 2, total - total // 2, trees=10)
    each = by_fold(found, "accuracies", "roc_auc")
    return each.select(F.concat_ws("/", "col_to_encode_with_new", "features").alias("replaced"), "fold",
                       F.round("accuracies", 6).alias("accuracies"), F.round("roc_auc", 6).alias("roc_auc"))


_FOLDS = """
ranked AS (SELECT *, row_number() OVER (ORDER BY c_custkey) - 1 AS p, count(*) OVER () AS n FROM given),
placed AS (SELECT *, CASE WHEN p < (n % 5) * (n // 5 + 1) THEN p // (n // 5 + 1) ELSE (n % 5) + (p - (n % 5) * (n // 5 + 1)) // (n // 5) END AS own FROM ranked),
parts AS (SELECT split_id::INT AS fold, own = split_id AS test, x1, x2, y FROM placed, (SELECT unnest(range(5)) AS split_id))"""
_SCORES = """round(-avg((y - guess) ^ 2), 4) + 0.0 AS neg_mean_squared_error,
  round(1 - sum((y - guess) ^ 2) / sum((y - mean) ^ 2), 4) + 0.0 AS r2"""


def regression(df: DataFrame, features: Features, model: str, **params) -> DataFrame:
    placed = folds(kfold_contiguous(df.select("c_custkey"), "c_custkey", 5), "c_custkey")
    found = models.evaluate_encoding(df, "c_custkey", features, placed, model, {}, regression=True, **params)
    each = by_fold(found, "neg_mean_squared_error", "r2")
    return each.select("fold", *[(F.round(c, 4) + 0.0).alias(c) for c in ("neg_mean_squared_error", "r2")])


@query("linear_regression_exact", f"""
WITH given AS (SELECT c_custkey, c_acctbal::DOUBLE AS x1, (c_custkey % 7 + c_nationkey)::DOUBLE AS x2,
  sqrt(c_acctbal + 2000) + 0.3 * (c_custkey % 11) AS y FROM customer), {_FOLDS},
sums AS (SELECT fold, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my, var_pop(x1) AS s11, var_pop(x2) AS s22, covar_pop(x1, x2) AS s12,
  covar_pop(x1, y) AS s1, covar_pop(x2, y) AS s2 FROM parts WHERE NOT test GROUP BY fold),
slopes AS (SELECT *, (s1 * s22 - s2 * s12) / (s11 * s22 - s12 * s12) AS b1, (s2 * s11 - s1 * s12) / (s11 * s22 - s12 * s12) AS b2 FROM sums),
guesses AS (SELECT fold, y, my + b1 * (x1 - m1) + b2 * (x2 - m2) AS guess, avg(y) OVER (PARTITION BY fold) AS mean
  FROM parts JOIN slopes USING (fold) WHERE test)
SELECT fold, {_SCORES} FROM guesses GROUP BY fold""")
def linear_regression_exact(t: Tables) -> DataFrame:
    """Two numbers, against the normal equations of every fold."""
    df = t.customer.selectExpr("c_custkey", "CAST(c_acctbal AS DOUBLE) AS x1", "CAST(c_custkey % 7 + c_nationkey AS DOUBLE) AS x2",
                               "sqrt(c_acctbal + 2000) + 0.3D * (c_custkey % 11) AS y")
    return regression(df, Features(numbers=["x1", "x2"]), "LinearRegression")


@query("gbt_regressor_exact", f"""
WITH given AS (SELECT c_custkey, {LABEL} AS x1, 3 AS x2, (5 + 2 * {LABEL})::DOUBLE AS y FROM customer), {_FOLDS},
means AS (SELECT fold, avg(y) AS my FROM parts WHERE NOT test GROUP BY fold),
guesses AS (SELECT fold, y, my, avg(y) OVER (PARTITION BY fold) AS mean FROM parts JOIN means USING (fold) WHERE test)
SELECT 'separating' AS feature, fold, {_SCORES} FROM (SELECT *, y AS guess FROM guesses) GROUP BY fold
UNION ALL SELECT 'independent', fold, {_SCORES} FROM (SELECT *, my AS guess FROM guesses) GROUP BY fold""")
def gbt_regressor_exact(t: Tables) -> DataFrame:
    """A target of two values, told by a number, and the mean where nothing tells it."""
    df = customers(t).withColumn("y", 5 + 2 * F.col("y"))
    cases = {"separating": ["telling", "level"], "independent": ["level"]}
    return reduce(DataFrame.unionByName, [regression(df, Features(numbers=numbers), "GradientBoostingRegressor", trees=10).withColumn(
        "feature", F.lit(name)) for name, numbers in cases.items()])
