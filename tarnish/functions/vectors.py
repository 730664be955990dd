"""Expressions over dense vectors held as ``array<double>``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tarnish.functions.text import col


def to_double(v: str | Column) -> Column:
    return col(v).cast("array<double>")


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def squared_distance(a: str | Column, b: str | Column) -> Column:
    return _sum(F.zip_with(to_double(a), to_double(b), lambda x, y: (x - y) * (x - y)))


def norm(v: str | Column) -> Column:
    return F.sqrt(_sum(F.transform(to_double(v), lambda x: x * x)))


def with_l2_normalised(df: DataFrame, v: str, out: str) -> DataFrame:
    """Unit vectors; a zero vector stays as it is. The norm is a column, computed once per row."""
    return (df.withColumn("_norm", F.greatest(norm(v), F.lit(1e-12)))
            .withColumn(out, F.transform(to_double(v), lambda x: x / F.col("_norm")))
            .drop("_norm"))


def zero_pad(v: str | Column, width: int = 100) -> Column:
    return F.concat(to_double(v), F.array_repeat(F.lit(0.0), F.lit(width) - F.size(col(v))))


def concat(*vs: str | Column) -> Column:
    return F.concat(*[to_double(v) for v in vs])


def first_token(tokens: str | Column) -> Column:
    """Vector of the first token, null for an empty sequence."""
    return F.get(col(tokens), F.lit(0))


def masked_mean(df: DataFrame, keys: list[str], dim: str, value: str, mask: str) -> DataFrame:
    """Mean over the unmasked tokens of long rows ``(*keys, token, dim, value, mask)``.

    One partial aggregation per (key, dim): a long sequence never sits in one row.
    """
    weight = F.col(mask).cast("double")
    return df.groupBy(*keys, dim).agg(
        (F.sum(F.col(value) * weight) / F.greatest(F.sum(weight), F.lit(1e-9))).alias("mean"))


def wide_to_vectors(df: DataFrame, keys: list[str]) -> DataFrame:
    """Regroup columns named ``<source>__<i>`` into one array column per source.

    Names are split at the last ``__``; every index from 0 up must occur exactly once.
    """
    groups: dict[str, dict[int, str]] = {}
    for name in df.columns:
        if name in keys:
            continue
        source, found, index = name.rpartition("__")
        if not found or not index.isdigit():
            raise ValueError(f"column {name!r} is not named <source>__<index>")
        slots = groups.setdefault(source, {})
        if int(index) in slots:
            raise ValueError(f"index {index} of {source!r} occurs twice")
        slots[int(index)] = name
    for source, slots in groups.items():
        if sorted(slots) != list(range(len(slots))):
            raise ValueError(f"indices of {source!r} have gaps")
    return df.select(*keys, *[
        F.array(*[F.col(f"`{slots[i]}`").cast("double") for i in range(len(slots))]).alias(source)
        for source, slots in sorted(groups.items())])


def vector_to_wide(df: DataFrame, v: str, width: int) -> DataFrame:
    """Replace an array column by ``width`` columns named ``<v>__<i>``."""
    rest = [F.col(c) for c in df.columns if c != v]
    return df.select(*rest, *[F.get(F.col(v), F.lit(i)).alias(f"{v}__{i}") for i in range(width)])
