"""Target preparation and class handling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tarnish.functions.scalars import seeded_hash
from tarnish.operators.ordering import global_positions, group_quantiles, hashed_positions

MAX_CLASSES = 20


def _few_distinct(df: DataFrame, y: str, limit: int) -> DataFrame:
    """At most ``limit`` distinct values: enough to decide, whatever the cardinality."""
    return df.select(y).where(F.col(y).isNotNull()).distinct().limit(limit)


def infer_task(df: DataFrame, y: str) -> DataFrame:
    """One row: ``task`` is classification for at most 20 distinct values."""
    return _few_distinct(df, y, MAX_CLASSES + 1).agg(
        F.when(F.count(F.lit(1)) <= MAX_CLASSES, "classification").otherwise("regression")
        .alias("task"))


def binarize_median(df: DataFrame, y: str, out: str = "y") -> DataFrame:
    """``y > median(y)``, the median exact and interpolated."""
    median = group_quantiles(df, [], y, {"median": 0.5}).scalar()
    return df.withColumn(out, F.col(y) > median)


def label_encode(df: DataFrame, y: str, out: str = "y") -> DataFrame:
    """Position of the value among the sorted distinct values, however many; null for null."""
    values = df.select(F.col(y).alias("_value")).where(F.col(y).isNotNull()).distinct()
    labels = global_positions(values, [F.asc("_value")], "_label")
    columns = [c for c in df.columns if c != out]
    return df.join(labels, F.col(y) == F.col("_value"), "left").select(
        *columns, F.col("_label").cast("bigint").alias(out))


def class_counts(df: DataFrame, y: str) -> DataFrame:
    return df.groupBy(y).agg(F.count(F.lit(1)).alias("n"))


def validate_target(df: DataFrame, y: str, regression: bool = False) -> DataFrame:
    """One row ``(n_classes, n_rows, valid)``: distinct(y) < min(20, rows) unless regression."""
    one = df.agg(F.count_distinct(y).alias("n_classes"), F.count(F.lit(1)).alias("n_rows"))
    valid = F.col("n_classes") < F.least(F.lit(MAX_CLASSES), F.col("n_rows"))
    return one.withColumn("valid", F.lit(True) if regression else valid)


def balance_classes(df: DataFrame, y: str, row_id: str, seed: int = 42,
                    within: list[str] | None = None) -> DataFrame:
    """Sample every class down to the size of the smallest, without replacement.

    ``within`` names columns (a split, a role) inside which classes are balanced separately.
    Rows without a class belong to none and are left out; they don't set the size.
    """
    within = within or []
    df = df.where(F.col(y).isNotNull())
    sizes = df.groupBy(*within, y).agg(F.count(F.lit(1)).alias("n"))
    smallest = sizes.groupBy(*[F.col(c).alias(f"_in_{c}") for c in within]).agg(F.min("n").alias("_smallest"))
    ordered = hashed_positions(df.withColumn("_h", seeded_hash(seed, row_id)), [*within, y],
                               "_h", [row_id], "_position")
    if within:
        same = [F.col(c).eqNullSafe(F.col(f"_in_{c}")) for c in within]
        ordered = ordered.join(smallest, reduce(lambda a, b: a & b, same))
    else:
        ordered = ordered.withColumn("_smallest", smallest.scalar())
    return ordered.where("_position < _smallest").select(*df.columns)


def prepare_target(df: DataFrame, target: str, regression: bool = False,
                   out: str = "y") -> DataFrame:
    """Target as the models want it: float for regression, class number otherwise.

    A target with more than 20 distinct values is cut at its median for classification.
    """
    df = df.where(F.col(target).isNotNull())
    if regression:
        return df.withColumn(out, F.col(target).cast("float"))
    if infer_task(df, target).first()["task"] == "regression":
        return binarize_median(df, target, out).withColumn(out, F.col(out).cast("bigint"))
    if not validate_target(df, target).first()["valid"]:
        raise ValueError(f"{target!r} has too many classes for a classification target")
    return label_encode(df, target, out)
