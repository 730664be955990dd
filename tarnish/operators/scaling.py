"""Scalers and feature transforms.

Column scalers work on plain numeric columns. The matrix transforms work on long tables
``(row_id, dim, value, train)`` so that any number of features is one grouped aggregation;
statistics always come from the training rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tarnish.functions.scalars import normal_quantile, seeded_hash
from tarnish.operators.ordering import cumulative_counts, group_quantiles
from tarnish.session import materialise


def standard_scale(df: DataFrame, columns: list[str], train: Column | None = None) -> DataFrame:
    """z-scores with the population deviation; a constant column is only centred."""
    fit = df if train is None else df.where(train)
    stats = fit.agg(F.struct(*[F.struct(
        F.avg(c).alias("m"),
        F.when(F.stddev_pop(c) > 0, F.stddev_pop(c)).otherwise(1.0).alias("s")).alias(c)
        for c in columns])).scalar()
    out = df.withColumn("_stats", stats)
    return out.select(*[
        ((F.col(c) - F.col(f"_stats.`{c}`.m")) / F.col(f"_stats.`{c}`.s")).alias(c)
        if c in columns else F.col(c) for c in df.columns])


def matrix(df: DataFrame, row_id: str, v: str, train: Column | None = None) -> DataFrame:
    """Array column to long rows ``(row_id, dim, value, train)``."""
    flag = F.lit(True) if train is None else train
    return df.select(row_id, flag.alias("train"), F.posexplode(
        F.col(v).cast("array<double>")).alias("dim", "value")).select(
        row_id, "dim", "value", "train")


def _per_dim(long: DataFrame, stats: DataFrame) -> DataFrame:
    """Statistics have one row per feature. They are written first, so Spark knows their size and
    broadcasts them where it is small: the rows of a feature never gather in one task then."""
    return long.join(materialise(stats, "per-feature"), "dim")


def select_dimensions(df: DataFrame, v: str, n: int, method: str = "first",
                      row_id: str | None = None, seed: int = 42) -> DataFrame:
    """Keep ``n`` dimensions of an array column: first, last, middle, random or by variance.

    ``middle`` starts at ``n // 2``. The variance orders keep ascending variance, ties by index.
    """
    size = F.size(v)
    enough = F.when(size >= n, F.col(v)).otherwise(F.raise_error(F.lit("too few dimensions")))
    if method == "first":
        return df.withColumn(v, F.slice(enough, 1, n))
    if method == "last":
        return df.withColumn(v, F.slice(enough, -n, n))
    if method == "middle":
        part = F.slice(enough, n // 2 + 1, n)
        return df.withColumn(v, F.when(F.size(part) == n, part).otherwise(
            F.raise_error(F.lit("too few dimensions"))))
    if method == "random":
        width = df.agg(F.min(F.size(v)).alias("lo"), F.max(F.size(v)).alias("hi"))
        width = width.select(F.when(F.col("lo") == F.col("hi"), F.col("hi")).otherwise(
            F.raise_error(F.lit("vectors differ in length"))).alias("s"))
        dims = width.select(F.explode(F.sequence(F.lit(0), F.col("s") - 1)).alias("dim"))
        order = dims.withColumn("o", seeded_hash(seed, "dim"))
    elif method in ("biggest_variance", "smallest_variance"):
        sign = 1 if method == "smallest_variance" else -1
        order = dimension_variances(df, v).select("dim", F.struct(
            (F.lit(sign) * F.round("variance", 12)).alias("a"), (F.lit(sign) * F.col("dim")).alias("b"))
            .alias("o"))
    else:
        raise ValueError(f"unknown method {method!r}")
    # one row per dimension of the vector
    chosen = F.slice(F.sort_array(F.collect_list(F.struct("o", "dim"))), 1, n)
    index = F.transform(chosen, lambda s: s["dim"])
    if method == "biggest_variance":
        index = F.reverse(index)
    picked = order.agg(index.alias("i")).scalar()
    return (df.withColumn("_i", picked).withColumn("_v", F.col(v))
            .withColumn(v, F.transform("_i", lambda i: F.get("_v", i))).drop("_i", "_v"))


def dimension_variances(df: DataFrame, v: str) -> DataFrame:
    """``(dim, variance)``: population variance of every dimension, one partial aggregation."""
    return df.select(F.posexplode(F.col(v).cast("array<double>")).alias("dim", "x")).groupBy(
        "dim").agg(F.var_pop("x").alias("variance"))


def drop_constant_features(long: DataFrame) -> DataFrame:
    """Drop dimensions with a single value over the training rows."""
    varied = long.where("train").groupBy("dim").agg(
        F.min("value").alias("lo"), F.max("value").alias("hi")).where("lo < hi").select("dim")
    return _per_dim(long, varied).select(*long.columns)


def normalise_on_train(long: DataFrame, with_test: bool = False) -> DataFrame:
    """z-scores with the sample deviation of the training rows, limited to +-100."""
    fit = long if with_test else long.where("train")
    stats = fit.groupBy("dim").agg(
        F.avg("value").alias("m"), (F.coalesce(F.stddev_samp("value"), F.lit(0.0)) + 1e-6).alias("s"))
    z = (F.col("value") - F.col("m")) / F.col("s")
    return _per_dim(long, stats).withColumn("value", F.greatest(
        F.lit(-100.0), F.least(F.lit(100.0), z))).select(*long.columns)


def robust_scale(long: DataFrame) -> DataFrame:
    """Median and interquartile range, scaled to unit variance for normal data."""
    # Fixed value: interquartile range of the standard normal distribution.
    iqr = 1.3489795003921634
    stats = group_quantiles(long.where("train"), ["dim"], "value",
                            {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    width = (F.col("q3") - F.col("q1")) / iqr
    return _per_dim(long, stats).withColumn("value", (F.col("value") - F.col("q2")) / F.when(
        width > 0, width).otherwise(1.0)).select(*long.columns)


def rank_transform(long: DataFrame, row_id: str) -> DataFrame:
    """Value replaced by the number of rows of its dimension that are not larger."""
    cum = cumulative_counts(long, ["dim"], "value")
    ranks = cum.select("dim", "value", (F.col("_before") + F.col("_n")).cast("double").alias("r"))
    return long.join(ranks, ["dim", "value"]).select(
        row_id, "dim", F.col("r").alias("value"), "train")


def quantile_to_normal(long: DataFrame, row_id: str) -> DataFrame:
    """Empirical distribution function of the training rows, then the normal quantile.

    The mid-rank among training values is interpolated into (0, 1) and limited to +-5.2.
    """
    fit = F.sum(F.col("train").cast("double"))
    cum = cumulative_counts(long, ["dim"], "value", extra={"t": fit})
    totals = long.where("train").groupBy("dim").agg(F.count(F.lit(1)).alias("n"))
    rank = (F.col("t_before") + F.col("t") / 2) / F.col("n")
    p = F.greatest(F.lit(1e-7), F.least(F.lit(1.0 - 1e-7), rank))
    scores = _per_dim(cum, totals).select("dim", "value", normal_quantile(p).alias("z"))
    return long.join(scores, ["dim", "value"]).select(
        row_id, "dim", F.col("z").alias("value"), "train")


def _yeo_johnson(x: Column, lam: Column) -> Column:
    up = F.when(F.abs(lam) < 1e-9, F.log1p(x)).otherwise((F.pow(x + 1, lam) - 1) / lam)
    down = F.when(F.abs(lam - 2) < 1e-9, -F.log1p(-x)).otherwise(-(F.pow(1 - x, 2 - lam) - 1) / (2 - lam))
    return F.when(x >= 0, up).otherwise(down)


def power_transform(long: DataFrame, reach: float = 8.0, tolerance: float = 1e-4) -> DataFrame:
    """Yeo-Johnson transform, standardised; the exponent maximises the likelihood.

    The likelihood has one maximum. Each pass measures 17 exponents around the best so far, all
    as columns of one aggregation, then takes an eighth of the step: from ``-reach .. reach``
    down to steps below ``tolerance``. A dimension whose likelihood is undefined stays unchanged.
    """
    fit = long.where("train")
    best = fit.select("dim").distinct().withColumn("lam", F.lit(0.0))
    x, n = F.col("value"), F.count(F.lit(1))
    jac = F.sum(F.signum(x) * F.log1p(F.abs(x)))
    step = reach / 8
    while True:
        options = []
        for i in range(-8, 9):
            lam = F.col("lam") + F.lit(i * step)
            y = _yeo_johnson(x, lam)
            spread = F.var_pop(y)
            options.append(F.when((spread > 0) & (spread < float("inf")), F.struct(
                F.round(-n / 2 * F.log(spread) + (F.max(lam) - 1) * jac, 9).alias("ll"), F.max(lam).alias("lam"),
                F.avg(y).alias("m"), F.sqrt(spread).alias("s"))))
        found = materialise(fit.join(best, "dim").groupBy("dim").agg(F.greatest(*options).alias("b")), "exponents")
        if step <= tolerance:
            break
        best, step = found.select("dim", F.coalesce("b.lam", F.lit(1.0)).alias("lam")), step / 8
    scaled = F.coalesce((_yeo_johnson(x, F.col("b.lam")) - F.col("b.m")) / F.col("b.s"), x)
    return _per_dim(long, found).withColumn("value", scaled).select(*long.columns)


def soft_clip_outliers(long: DataFrame, n_sigma: float = 4.0, with_test: bool = False) -> DataFrame:
    """Limit values beyond mean +- k deviations; the excess grows only logarithmically.

    Mean and deviation are measured twice, the second time without the values beyond the first
    limits.
    """
    fit = long if with_test else long.where("train")

    def limits(rows: DataFrame, lo: str, hi: str) -> DataFrame:
        cut = F.coalesce(F.stddev_samp("value"), F.lit(0.0)) * n_sigma
        return rows.groupBy("dim").agg((F.avg("value") - cut).alias(lo), (F.avg("value") + cut).alias(hi))

    inner = _per_dim(fit, limits(fit, "l0", "h0")).where("value between l0 and h0")
    x = F.col("value")
    low = F.greatest(-F.log(1 + F.abs(x)) + F.col("lo"), x)
    clipped = F.least(F.log(1 + F.abs(low)) + F.col("hi"), low)
    return _per_dim(long, limits(inner, "lo", "hi")).withColumn("value", clipped).select(
        *long.columns)


def rescale_by_used_features(long: DataFrame, max_features: int = 100,
                             with_sqrt: bool = False) -> DataFrame:
    """Multiply by ``max_features / used`` (or its square root)."""
    used = long.select("dim").distinct().agg(F.count(F.lit(1))).scalar()
    factor = F.lit(float(max_features)) / used
    return long.withColumn("value", F.col("value") * (F.sqrt(factor) if with_sqrt else factor))


def preprocess_features(long: DataFrame, row_id: str, transform: str = "none",
                        max_features: int = 100, with_test: bool = False,
                        to_ranking: bool = False, with_sqrt: bool = False) -> DataFrame:
    """Normalise, drop constants, transform, limit outliers (or rank), rescale."""
    long = drop_constant_features(normalise_on_train(long, with_test))
    steps = {"none": lambda d: d, "power": power_transform, "robust": robust_scale,
             "quantile": lambda d: quantile_to_normal(d, row_id)}
    long = steps[transform](long)
    long = normalise_on_train(rank_transform(long, row_id), True) if to_ranking else \
        soft_clip_outliers(long, with_test=with_test)
    return rescale_by_used_features(long, max_features, with_sqrt)
