"""Scores of predictions, exact and distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tarnish.operators.ordering import cumulative_counts


def accuracy(df: DataFrame, keys: list[str], y: str, pred: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg((F.col(y) == F.col(pred)).cast("double")).alias("accuracy"))


def balanced_accuracy(df: DataFrame, keys: list[str], y: str, pred: str) -> DataFrame:
    """Mean recall over classes; for two classes the AUC of hard labels."""
    per_class = df.groupBy(*keys, y).agg(
        F.avg((F.col(y) == F.col(pred)).cast("double")).alias("recall"))
    return per_class.groupBy(*keys).agg(F.avg("recall").alias("roc_auc_hard"))


def roc_auc(df: DataFrame, keys: list[str], y: str, score: str) -> DataFrame:
    """Exact AUC: share of (positive, negative) pairs in the right order, ties half.

    Scores are grouped, and the number of negatives below each comes from bucketed running
    totals, so no group is sorted in one task and no curve is binned.
    """
    positive = F.sum((F.col(y) == 1).cast("double"))
    cum = cumulative_counts(df, keys, score, extra={"pos": positive})
    neg_here, neg_before = F.col("_n") - F.col("pos"), F.col("_before") - F.col("pos_before")
    wins = F.sum(F.col("pos") * (neg_before + neg_here / 2))
    return cum.groupBy(*keys).agg(
        F.try_divide(wins, F.sum("pos") * F.sum(neg_here)).alias("roc_auc"))


def roc_auc_ovr(df: DataFrame, keys: list[str], y: str, probabilities: str,
                classes: int) -> DataFrame:
    """One-vs-rest macro average over ``classes`` class scores held in an array."""
    long = df.select(*keys, y, F.posexplode(probabilities).alias("_class", "_score")).where(
        F.col("_class") < classes)
    long = long.withColumn("_hit", (F.col(y) == F.col("_class")).cast("int"))
    return roc_auc(long, [*keys, "_class"], "_hit", "_score").groupBy(*keys).agg(
        F.avg("roc_auc").alias("roc_auc"))


def regression_scores(df: DataFrame, keys: list[str], y: str, pred: str) -> DataFrame:
    """``neg_mean_squared_error`` and ``r2`` in one pass."""
    error = (F.col(y) - F.col(pred)) * (F.col(y) - F.col(pred))
    return df.groupBy(*keys).agg(
        (-F.avg(error)).alias("neg_mean_squared_error"),
        (F.lit(1.0) - F.try_divide(F.sum(error), F.var_pop(y) * F.count(y))).alias("r2"))
