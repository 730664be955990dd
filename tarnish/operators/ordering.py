"""Ordered computations that never put one group, let alone the whole table, into one task.

A plain window over a hot key, or over no key at all, sorts an unbounded group in a single
task. Here rows first fall into value buckets; bucket totals give each bucket its offset, and
only the rows of one (group, bucket) are sorted together. Rows with equal values are counted,
not repeated, so copies never pile up in one bucket.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tarnish.session import materialise, parallelism


def range_splits(df: DataFrame, value: str, buckets: int | None = None) -> Column:
    """Scalar subquery: approximate equi-depth split points of a numeric column.

    The sketch has a fixed size whatever the data volume.
    """
    # as many as there are partitions, which the user sets by the volume
    n = buckets or max(4, min(1 << 14, parallelism(df.sparkSession)))
    probs = ", ".join(f"{i / n!r}D" for i in range(1, n))
    return df.agg(F.expr(
        f"percentile_approx(cast(`{value}` as double), array({probs}), {10 * n})").alias("s")).scalar()


# Split points that are compared one by one; longer lists are searched in two levels.
BLOCK = 128


def bucket_of(value: Column, splits: Column) -> Column:
    """Number of split points below the value: a monotone bucket number."""
    v = value.cast("double")

    def below(points: Column) -> Column:
        return F.size(F.filter(points, lambda s: s < v))

    # the last point of every block first, then the points of the one block that is left
    blocks = F.sequence(F.lit(0), F.floor(F.size(splits) / BLOCK).cast("int") - 1)
    full = F.size(F.filter(blocks, lambda i: F.get(splits, (i + 1) * BLOCK - 1) < v)) * BLOCK
    two_levels = full + below(F.slice(splits, full + 1, F.lit(BLOCK)))
    return F.coalesce(F.when(F.size(splits) <= 2 * BLOCK, below(splits)).otherwise(two_levels), F.lit(0))


def with_bucket(df: DataFrame, value: str, source: DataFrame, out: str = "_b") -> DataFrame:
    """Add the bucket of ``value`` among equi-depth split points of ``source``.

    A binary search, one step per projection: the points stay a constant of the generated code,
    and a row costs the logarithm of their number.
    """
    n = max(4, min(1 << 14, parallelism(df.sparkSession)))
    found = df.withColumn("_splits", range_splits(source, value, n)).withColumn(out, F.lit(0))
    step, v = 1 << (n - 1).bit_length() - 1, F.col(value).cast("double")
    while step:
        # beyond the last point there is none to compare
        found = found.withColumn(out, F.col(out) + F.when(F.get("_splits", F.col(out) + F.lit(step - 1)) < v, step).otherwise(0))
        step >>= 1
    return found.drop("_splits")


def hash_bucket(digest: str) -> Column:
    """Bucket of an md5 text: its first three digits spread rows evenly over 4096 buckets."""
    return F.conv(F.substring(digest, 1, 3), 16, 10).cast("int")


def running_totals(df: DataFrame, keys: list[str], bucket: str, order: list[Column],
                   weights: dict[str, str]) -> DataFrame:
    """Add, per group, the total weight of all rows strictly before each row.

    ``bucket`` must be monotone in ``order``; ``weights`` maps weight column to output column.
    """
    totals = df.groupBy(*keys, bucket).agg(
        *[F.sum(w).alias(f"_t_{out}") for w, out in weights.items()])
    # one row per (group, bucket): bounded per group by the number of buckets
    by_bucket = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(bucket)
    before = by_bucket.rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, bucket, *[
        F.coalesce(F.sum(f"_t_{out}").over(before), F.lit(0)).alias(f"_o_{out}")
        for out in weights.values()])
    # null keys are a group like any other
    renamed = offsets.withColumnsRenamed({c: f"_k_{c}" for c in [*keys, bucket]})
    same = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in [*keys, bucket]]
    joined = df.join(renamed, reduce(lambda a, b: a & b, same))
    inside = (Window.partitionBy(*keys, bucket).orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, -1))
    return joined.select(*df.columns, *[
        (F.col(f"_o_{out}") + F.coalesce(F.sum(w).over(inside), F.lit(0))).alias(out)
        for w, out in weights.items()])


def running_max(df: DataFrame, bucket: str, order: list[Column], value: str, out: str) -> DataFrame:
    """Add the largest ``value`` of all rows up to each row, in the order ``order``.

    ``bucket`` must be monotone in ``order``. A bucket starts from the largest value of the buckets
    before it, which a table with one row per bucket tells.
    """
    before = Window.partitionBy(F.lit(0)).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    tops = df.groupBy(bucket).agg(F.max(value).alias("_top"))
    starts = tops.select(F.col(bucket).alias("_k"), F.max("_top").over(before).alias("_top_before"))
    here = Window.partitionBy(bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.join(starts, F.col(bucket) == F.col("_k")).select(
        *df.columns, F.greatest(F.max(value).over(here), "_top_before").alias(out))


def value_counts(df: DataFrame, keys: list[str], value: str,
                 extra: dict[str, Column] | None = None) -> DataFrame:
    """Distinct values with their counts (and other sums), pre-aggregated before the shuffle."""
    aggs = {"_n": F.count(F.lit(1)), **(extra or {})}
    return (df.where(F.col(value).isNotNull()).groupBy(*keys, value)
            .agg(*[c.alias(name) for name, c in aggs.items()]))


def cumulative_counts(df: DataFrame, keys: list[str], value: str, descending: bool = False,
                      extra: dict[str, Column] | None = None) -> DataFrame:
    """Per distinct value: its count ``_n`` and ``_before``, the rows ordered before it.

    With ``extra`` sums (name -> aggregate) there is also ``<name>_before`` for each.
    """
    counts = value_counts(df, keys, value, extra)
    # the grouping is a shared subtree: Spark reuses its exchange for the sketch
    bucketed = with_bucket(counts, value, counts)
    sign = -1 if descending else 1
    bucketed = bucketed.withColumn("_b", F.col("_b") * sign)
    order = [F.col(value).desc() if descending else F.col(value).asc()]
    weights = {"_n": "_before", **{name: f"{name}_before" for name in (extra or {})}}
    return running_totals(bucketed, keys, "_b", order, weights).drop("_b")


def group_quantiles(df: DataFrame, keys: list[str], value: str,
                    probs: dict[str, float]) -> DataFrame:
    """Exact quantiles with linear interpolation, ``probs`` mapping output name to probability.

    Equal to ``percentile`` but without holding the distinct values of a group in one task. The
    buckets' totals tell which bucket holds a wanted rank; only those buckets are sorted.
    """
    counts = value_counts(df, keys, value)
    counts = with_bucket(counts, value, counts)
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    # one row per (group, bucket)
    totals = counts.groupBy(*keys, "_b").agg(F.sum("_n").alias("_t"))
    totals = totals.withColumn("_total", F.sum("_t").over(group)).withColumn("_start", F.coalesce(F.sum("_t").over(
        group.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))

    def covers(first: Column, n: Column, rank: Column) -> Column:
        return (first <= rank) & (rank < first + n)

    def any_rank(first: Column, n: Column) -> Column:
        found = F.lit(False)
        for p in probs.values():
            rank = F.lit(float(p)) * (F.col("_total") - 1)
            found = found | covers(first, n, F.floor(rank)) | covers(first, n, F.ceil(rank))
        return found

    needed = totals.where(any_rank(F.col("_start"), F.col("_t"))).drop("_t")
    needed = needed.withColumnsRenamed({c: f"_k_{c}" for c in [*keys, "_b"]})
    same = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in [*keys, "_b"]]
    inside = Window.partitionBy(*keys, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranked = counts.join(needed, reduce(lambda a, b: a & b, same)).withColumn(
        "_before", F.col("_start") + F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    aggs = []
    for name, p in probs.items():
        rank, v = F.lit(float(p)) * (F.col("_total") - 1), F.col(value).cast("double")
        low, high = (F.max(F.when(covers(F.col("_before"), F.col("_n"), r), v)) for r in (F.floor(rank), F.ceil(rank)))
        aggs.append((low + (high - low) * F.max(rank - F.floor(rank))).alias(name))
    return ranked.where(any_rank(F.col("_before"), F.col("_n"))).groupBy(*keys).agg(*aggs)


def average_ranks(df: DataFrame, keys: list[str], value: str, out: str = "rank",
                  descending: bool = True) -> DataFrame:
    """Rank within the group, ties sharing their average rank; null values get no rank."""
    cum = cumulative_counts(df, keys, value, descending)
    ranks = cum.select(*keys, value, (
        F.col("_before") + (F.col("_n") + 1) / F.lit(2.0)).cast("double").alias(out))
    return df.join(ranks, [*keys, value], "left").select(*df.columns, out)


def hashed_positions(df: DataFrame, keys: list[str], digest: str, tie: list[str],
                     out: str = "position") -> DataFrame:
    """0-based position of each row in the order of an md5 column, per group."""
    prepared = df.withColumn("_b", hash_bucket(digest)).withColumn("_one", F.lit(1))
    order = [F.col(digest).asc(), *[F.col(t).asc() for t in tie]]
    return running_totals(prepared, keys, "_b", order, {"_one": out}).drop("_b", "_one").withColumn(
        out, F.col(out).cast("bigint"))


def global_positions(df: DataFrame, by: list[Column], out: str = "position") -> DataFrame:
    """0-based position of each row in the order ``by``, of any sortable type.

    One range shuffle, sorted inside its partitions; a table with one row per partition links
    them. The sorted rows are written, so that every later read numbers them alike.
    """
    ranged = df.repartitionByRange(*by).sortWithinPartitions(*by)
    ranged = materialise(ranged.withColumn("_at", F.monotonically_increasing_id()), "positions")
    part = F.shiftright("_at", 33)
    sizes = ranged.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return ranged.withColumn("_part", part).join(starts, "_part").select(
        *df.columns, (F.col("_start") + F.col("_at").bitwiseAND((1 << 33) - 1)).alias(out))


def sorted_positions(df: DataFrame, keys: list[str], by: str, out: str = "position") -> DataFrame:
    """0-based position of each row in the order of a unique numeric column, per group."""
    if keys:
        # without ties a rank is a position
        ranked = average_ranks(df, keys, by, out, descending=False)
        return ranked.withColumn(out, F.col(out).cast("bigint") - 1)
    prepared = with_bucket(df, by, df).withColumn("_one", F.lit(1))
    return running_totals(prepared, keys, "_b", [F.col(by).asc()], {"_one": out}).drop(
        "_b", "_one").withColumn(out, F.col(out).cast("bigint"))
