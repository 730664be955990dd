"""Missing-value cleaning of a feature table."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Texts that stand for a missing cell (whole cell, case-sensitive).
FALSE_MISSING = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "...", "1.#IND",
    "1.#QNAN", "<NA>", "?", "N/A", "NA", "NULL", "NaN", "n/a", "nan", "null",
]


class Cleaned(NamedTuple):
    kept: DataFrame
    columns: DataFrame
    rows: DataFrame


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def real_text(c: Column) -> Column:
    """Null for a false-missing or blank text."""
    return F.when(~(c.isin(FALSE_MISSING) | c.rlike(r"^\s+$")), c)


def replace_false_missing(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    names = set(columns if columns is not None else text_columns(df))
    return df.select(*[real_text(F.col(c)).alias(c) if c in names else F.col(c)
                       for c in df.columns])


def drop_null_target_rows(df: DataFrame, target: str) -> DataFrame:
    return df.where(F.col(target).isNotNull())


def null_fractions(df: DataFrame, columns: list[str], threshold: float = 0.7) -> DataFrame:
    """``(kind, name, null_frac, dropped)``, all columns measured in one pass."""
    one = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns])
    return one.unpivot([], columns, "name", "null_frac").select(
        F.lit("column").alias("kind"), "name", "null_frac",
        (F.col("null_frac") > F.lit(float(threshold))).alias("dropped"))


def drop_sparse_columns(df: DataFrame, columns: list[str], threshold: float = 0.7) -> DataFrame:
    """Drop columns whose null share is strictly above the threshold (one row reaches the driver)."""
    sparse = [r["name"] for r in null_fractions(df, columns, threshold).where("dropped").collect()]
    return df.drop(*sparse)


def drop_rows_any_null(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return df.na.drop("any", subset=columns)


def remove_missing_values(df: DataFrame, features: list[str], row_id: str,
                          threshold: float = 0.7) -> Cleaned:
    """Clean the features: false missing to null, sparse columns out, incomplete rows out.

    Also returns what was dropped: one row per feature and one row per table row.
    """
    df = replace_false_missing(df, [c for c in features if c in text_columns(df)])
    report = null_fractions(df, features, threshold)
    dropped = {r["name"] for r in report.where("dropped").collect()}
    rest = [c for c in features if c not in dropped]
    incomplete = F.lit(False)
    for c in rest:
        incomplete = incomplete | F.col(c).isNull()
    rows = df.select(row_id, incomplete.alias("dropped"))
    return Cleaned(drop_rows_any_null(df.drop(*dropped), rest or None), report, rows)


def split_text_rest(df: DataFrame, text: str, target: str, row_id: str,
                    include_all_columns: bool = True, threshold: float = 0.7) -> DataFrame:
    """Text column, remaining features and target.

    Missing values are judged on the remaining features only, so a row whose text is missing
    stays. Without ``include_all_columns`` only text and target come back.
    """
    rest = [c for c in df.columns if c not in (text, target, row_id)]
    cleaned = remove_missing_values(drop_null_target_rows(df, target), rest, row_id, threshold).kept
    kept_rest = [c for c in cleaned.columns if c in rest]
    return cleaned.select(row_id, text, *(kept_rest if include_all_columns else []), target)


def map_values(df: DataFrame, column: str, mapping: dict) -> DataFrame:
    return df.replace(mapping, subset=[column])
