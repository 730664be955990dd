"""Joins on equal keys, reshaping and group summaries used by evaluations and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tarnish.operators.ordering import sorted_positions


def inner_join_on(left: DataFrame, right: DataFrame, on: list[str],
                  suffixes: tuple[str, str] = ("_x", "_y")) -> DataFrame:
    """Inner join; columns both sides have outside the key get a suffix."""
    shared = [c for c in left.columns if c in right.columns and c not in on]
    left = left.withColumnsRenamed({c: c + suffixes[0] for c in shared})
    right = right.withColumnsRenamed({c: c + suffixes[1] for c in shared})
    return left.join(right, on)


def natural_join(left: DataFrame, right: DataFrame) -> DataFrame:
    shared = [c for c in left.columns if c in right.columns]
    if not shared:
        raise ValueError("the tables have no column in common")
    return left.join(right, shared)


def join_different_names(left: DataFrame, right: DataFrame, left_on: list[str],
                         right_on: list[str], how: str = "inner") -> DataFrame:
    same = [left[a] == right[b] for a, b in zip(left_on, right_on, strict=True)]
    return left.join(right, reduce(lambda a, b: a & b, same), how)


def with_baseline(df: DataFrame, keys: list[str], value: str, is_baseline: Column,
                  suffix: str) -> DataFrame:
    """Every row with the value of its group's baseline row; groups without one drop out."""
    base = df.where(is_baseline).select(*keys, F.col(value).alias(value + suffix))
    return df.join(base, keys)


def lookup_join_back(df: DataFrame, text: str, encode) -> DataFrame:
    """Encode each distinct text once, then give every row its vector.

    ``encode`` maps a table of distinct texts to the same texts with further columns.
    """
    return df.join(encode(df.select(text).where(F.col(text).isNotNull()).distinct()), text, "left")


def grid(first: DataFrame, **lists: Column | DataFrame) -> DataFrame:
    """Every combination of the rows of ``first`` with the values of each list.

    A list is an array column, or a table of one column whose distinct values count. The product
    is what is asked for here: its size is that of the result.
    """
    for name, values in lists.items():
        if isinstance(values, DataFrame):
            first = first.crossJoin(values.toDF(name).distinct())
        else:
            first = first.withColumn(name, F.explode(values))
    return first


def numeric_columns(df: DataFrame, besides: list[str]) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in besides]


def group_mean_all_numeric(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in numeric_columns(df, keys)])


def completeness_ratio(df: DataFrame, keys: list[str], value: str, expected: int = 7) -> DataFrame:
    """Share of groups that have exactly the expected number of non-null values."""
    counts = df.groupBy(*keys).agg(F.count(value).alias("n"))
    return counts.agg(F.avg((F.col("n") == expected).cast("double")).alias("ratio"))


def having_group_size(df: DataFrame, keys: list[str], allowed: list[int]) -> DataFrame:
    """Rows of groups whose size is none of the allowed ones."""
    odd = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(~F.col("_n").isin(allowed))
    return df.join(odd.select(*keys), keys, "left_semi")


def pivot_unique(df: DataFrame, index: list[str], columns: str, values: str,
                 names: list[str]) -> DataFrame:
    """Long to wide; more than one value for a cell is an error."""
    def one(name):
        hit = F.col(columns) == name
        return F.when(F.count(F.when(hit, 1)) > 1, F.raise_error(F.lit("duplicate pivot cell"))
                      ).otherwise(F.max(F.when(hit, F.col(values)))).alias(name)
    return df.groupBy(*index).agg(*[one(n) for n in names])


def melt(df: DataFrame, ids: list[str], values: list[str], name: str = "variable",
         value: str = "value") -> DataFrame:
    return df.unpivot(ids, values, name, value)


def mean_stderr(df: DataFrame, keys: list[str], value: str, factor: float = 0.5) -> DataFrame:
    """Mean with an error bar of ``factor`` standard errors on either side."""
    error = F.lit(factor) * F.stddev_samp(value) / F.sqrt(F.count(value))
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), (F.avg(value) - error).alias("low"),
                                 (F.avg(value) + error).alias("high"))


def ols_trend(df: DataFrame, x: str, y: str, keys: list[str] | None = None) -> DataFrame:
    fit = [F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
           F.regr_r2(y, x).alias("r2"), F.regr_count(y, x).alias("n")]
    return df.groupBy(*keys).agg(*fit) if keys else df.agg(*fit)


def last_row_per_group(df: DataFrame, keys: list[str], by: str) -> DataFrame:
    """Row with the largest ``by`` per group, without sorting the groups."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(by)).alias("_r")).select(
        *keys, "_r.*")


def argmax_rows(df: DataFrame, value: str) -> DataFrame:
    return df.where(F.col(value) == df.agg(F.max(value)).scalar())


def global_max_normalise(df: DataFrame, value: str, out: str) -> DataFrame:
    return df.withColumn(out, F.try_divide(F.col(value), df.agg(F.max(value)).scalar()))


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row ``(only_left, only_right, equal)`` comparing two tables as bags of rows."""
    left = a.exceptAll(b).agg(F.count(F.lit(1)).alias("only_left"))
    right = b.exceptAll(a).agg(F.count(F.lit(1))).scalar()
    return left.withColumn("only_right", right).withColumn(
        "equal", (F.col("only_left") == 0) & (F.col("only_right") == 0))


def explode_parallel(df: DataFrame, arrays: list[str]) -> DataFrame:
    """Several arrays exploded in lock step; different lengths are an error."""
    sizes = [F.size(a) for a in arrays]
    equal = reduce(lambda x, y: x & y, [s == sizes[0] for s in sizes], F.lit(True))
    zipped = F.when(equal, F.arrays_zip(*arrays)).otherwise(
        F.raise_error(F.lit("arrays have different lengths")))
    rest = [c for c in df.columns if c not in arrays]
    return df.select(*rest, F.inline(zipped))


def row_position(df: DataFrame, keys: list[str], by: str, out: str = "position") -> DataFrame:
    """1-based position inside a group in the order of a unique number; large groups are split."""
    return sorted_positions(df, keys, by, out).withColumn(out, F.col(out) + 1)
