"""From a raw table to aligned features and target."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tarnish.operators.clean import drop_null_target_rows, remove_missing_values
from tarnish.operators.splits import shuffle_limit
from tarnish.operators.target import prepare_target


def prepare_dataset(df: DataFrame, target: str, row_id: str, features: list[str] | None = None,
                    regression: bool = False, max_rows: int | None = None, clean: bool = True,
                    out: str = "y", seed: int = 42) -> DataFrame:
    """Features and target ``out`` row by row, ready for splits.

    Rows without a target go first, then sparse columns and incomplete rows; task and classes
    come from what is left, and the sample of ``max_rows`` is drawn last, so it changes neither.
    """
    df = drop_null_target_rows(df, target)
    if clean:
        names = features if features is not None else [c for c in df.columns if c not in (target, row_id)]
        df = remove_missing_values(df, names, row_id).kept
    df = prepare_target(df, target, regression, out).drop(target)
    return df if max_rows is None else shuffle_limit(df, max_rows, row_id, seed)
