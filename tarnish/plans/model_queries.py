"""Model training and evaluation on labelled documents, parts, and embeddings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tarnish.operators import models
from tarnish.operators.encoders import encode
from tarnish.operators.models import Features, table_vectorizer, with_vectors
from tarnish.operators.splits import fixed_size_split, group_kfold, kfold_contiguous
from tarnish.plans.registry import Tables, query
from tarnish.plans.table_queries import rounded

def documents(t: Tables) -> DataFrame:
    """Labelled documents: text, language, source, length, and quality as target."""
    return t.documents.join(t.labels, "doc_id").select(
        "doc_id", "text", "lang", "source", "n_chars", F.col("quality").cast("double").alias("y"))


def encoded(t: Tables, spec: str = "skrub__minhash_30") -> tuple[DataFrame, Features]:
    df, rest = table_vectorizer(documents(t), ["lang", "source", "n_chars"])
    df = with_vectors(encode(df, "text", spec, "text_v"), ["text_v"])
    return df.drop("text"), Features(["text_v", *rest.vectors], rest.numbers, rest.categories)


def halves(df: DataFrame, row_id: str, n_splits: int = 7) -> DataFrame:
    """Repeated splits, half of the rows for training, all others for testing."""
    rows = df.select(row_id)
    return fixed_size_split(rows, row_id, rows.count() // 2, None, n_splits)


def folds(df: DataFrame, row_id: str) -> DataFrame:
    """Fold numbers as a split table."""
    k = [r["fold"] for r in df.select("fold").distinct().orderBy("fold").collect()]
    each = df.select(row_id, "fold", F.explode(F.array(*[F.lit(i) for i in k])).alias("split_id"))
    return each.select("split_id", row_id, F.when(F.col("fold") == F.col("split_id"), "test")
                       .otherwise("train").alias("role"))


def flat(records: DataFrame, *metrics: str) -> DataFrame:
    return rounded(models.fold_metrics_table(records, list(metrics)), *metrics, digits=4)


@query("evaluate_encoding")
def evaluate_encoding(t: Tables) -> DataFrame:
    df, features = encoded(t)
    return flat(models.evaluate_encoding(
        df, "doc_id", features, halves(documents(t), "doc_id"), "LogisticRegression",
        {"encoding": "skrub__minhash_30", "dim_reduction": "passthrough", "features": "all"}),
        "accuracies", "roc_auc")


@query("evaluate_multi_reduction")
def evaluate_multi_reduction(t: Tables) -> DataFrame:
    df, features = encoded(t)
    df = with_vectors(encode(df, "source", "skrub__minhash_12", "source_v"), ["source_v"])
    mixed = Features(["text_v", "source_v"], features.numbers, ["lang"], {"text_v": 10, "source_v": 4})
    label = models.reduction_names(mixed, ["text_v", "source_v"])
    return flat(models.evaluate_encoding(
        df, "doc_id", mixed, halves(documents(t), "doc_id"), "LogisticRegression", {"dim_reductions": label}),
        "accuracies", "roc_auc")


@query("evaluate_ngram_matrix")
def evaluate_ngram_matrix(t: Tables) -> DataFrame:
    df = documents(t)
    return flat(models.evaluate_ngram_matrix(
        df, "doc_id", ["text"], ["lang", "source", "n_chars"], halves(documents(t), "doc_id"),
        "LogisticRegression", {"dataset": "documents"}, tfidf=True),
        "accuracies", "roc_auc", "roc_auc_hard")


@query("feature_regimes")
def feature_regimes(t: Tables) -> DataFrame:
    df, features = encoded(t)
    # three evaluations read them
    placed = models.Placed.of(df, "doc_id", halves(documents(t), "doc_id"))
    return flat(reduce(DataFrame.unionByName, [models.evaluate_encoding(
        placed, "doc_id", features.regime(r, ["text_v"]), None, "LogisticRegression", {"features": r})
        for r in models.FEATURES]), "accuracies", "roc_auc")


@query("logistic_regression")
def logistic_regression(t: Tables) -> DataFrame:
    # ten classes: one-vs-rest AUC
    df = with_vectors(t.embeddings.withColumn("y", F.col("label").cast("double")), ["embedding"])
    return flat(models.evaluate_encoding(
        df, "vec_id", Features(["embedding"]), halves(t.embeddings.select("vec_id"), "vec_id"), "LogisticRegression",
        {"dataset": "embeddings"}, n_classes=10), "accuracies", "roc_auc")


@query("gbt_classifier")
def gbt_classifier(t: Tables) -> DataFrame:
    df, features = encoded(t)
    return flat(models.evaluate_encoding(
        df, "doc_id", features, halves(documents(t), "doc_id"), "GradientBoostingClassifier",
        {"dataset": "documents"}), "accuracies", "roc_auc")


def _customers(t: Tables) -> tuple[DataFrame, Features]:
    """Spending of a customer from name, segment, balance and nation."""
    spent = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.log10(F.sum("o_totalprice")).alias("y"), F.count(F.lit(1)).cast("double").alias("n_orders"))
    df = t.customer.join(spent, "c_custkey")
    return table_vectorizer(df, ["c_name", "c_mktsegment", "c_acctbal", "n_orders"])


def _regression(t: Tables, model: str, custom: bool, **params) -> DataFrame:
    df, features = _customers(t)
    buyers = t.customer.select("c_custkey", "c_nationkey").join(
        t.orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")
    placed = (group_kfold(buyers, "c_nationkey") if custom else kfold_contiguous(buyers, "c_custkey"))
    return flat(models.evaluate_encoding(
        df, "c_custkey", features, folds(placed, "c_custkey"), model,
        {"cv_name": "custom" if custom else "classic"}, regression=True, **params),
        "neg_mean_squared_error", "r2")


@query("linear_regression")
def linear_regression(t: Tables) -> DataFrame:
    return _regression(t, "LinearRegression", custom=False)


@query("gbt_regressor")
def gbt_regressor(t: Tables) -> DataFrame:
    return _regression(t, "GradientBoostingRegressor", custom=True)


def _ensemble(t: Tables, aggregation: str, **params) -> DataFrame:
    df, features = encoded(t)
    return flat(models.evaluate_ensemble(
        df, "doc_id", features.regime("text_only", ["text_v"]), features.regime("rest_only", ["text_v"]),
        halves(documents(t), "doc_id"), "LogisticRegression", "LogisticRegression", aggregation,
        {"encoding": "skrub__minhash_30"}, **params), "accuracies", "roc_auc")


@query("ensemble_voting")
def ensemble_voting(t: Tables) -> DataFrame:
    return _ensemble(t, "voting")


@query("ensemble_stacking")
def ensemble_stacking(t: Tables) -> DataFrame:
    return _ensemble(t, "stacking")


@query("column_replacement_ablation")
def column_replacement_ablation(t: Tables) -> DataFrame:
    df = documents(t)
    total = df.count()
    n = total // 2
    return flat(models.column_replacement_ablation(
        df, "doc_id", ["text", "source"], ["lang", "n_chars"], "skrub__minhash_10", "skrub__minhash_30",
        fixed_size_split(df, "doc_id", n, None, 7), "LogisticRegression", {"dataset": "documents"},
        n, total - n), "accuracies", "roc_auc")
