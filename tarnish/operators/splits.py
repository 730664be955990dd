"""Sampling and train/test splits, reproducible through seeded md5 order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tarnish.functions.scalars import seeded_hash
from tarnish.operators.ordering import (global_positions, hash_bucket, hashed_positions,
                                        sorted_positions)
from tarnish.session import materialise

def shuffle_limit(df: DataFrame, max_rows: int, row_id: str, seed: int = 42) -> DataFrame:
    """Sample of ``max_rows`` rows: the first in seeded order, kept as a top-k per task."""
    return (df.withColumn("_h", seeded_hash(seed, row_id)).orderBy("_h", row_id)
            .limit(max_rows).drop("_h"))


def check_split_sizes(n_rows: int, n_train: int, n_test: int | None) -> None:
    wanted = n_train + (n_test or 0)
    if wanted > n_rows:
        raise ValueError(f"a split of {wanted} rows was asked for, the table has {n_rows}")


def fixed_size_split(df: DataFrame, row_id: str, n_train: int, n_test: int | None = None,
                     n_splits: int = 5, seed: int = 42) -> DataFrame:
    """Independent shuffles: ``(split_id, row_id, role)``.

    Per split the first ``n_train`` rows train, the next ``n_test`` (or all others) test. With a
    fixed test size only the low hash buckets that hold the wanted rows are sorted.
    """
    check_split_sizes(df.count(), n_train, n_test)
    rows = df.select(row_id).withColumn(
        "split_id", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1)))).withColumn(
        "_h", seeded_hash(seed, "split_id", row_id))
    if n_test is not None:
        need = n_train + n_test
        # at most 4096 buckets per split
        sizes = rows.groupBy("split_id", hash_bucket("_h").alias("_c")).agg(
            F.count(F.lit(1)).alias("n"))
        before = (Window.partitionBy("split_id").orderBy("_c")
                  .rowsBetween(Window.unboundedPreceding, -1))
        cut = sizes.withColumn("_start", F.coalesce(F.sum("n").over(before), F.lit(0))).where(
            F.col("_start") < need).groupBy("split_id").agg(F.max("_c").alias("_cut"))
        rows = rows.join(F.broadcast(cut), "split_id").where(
            hash_bucket("_h") <= F.col("_cut")).drop("_cut")
    placed = hashed_positions(rows, ["split_id"], "_h", [row_id])
    role = F.when(F.col("position") < n_train, "train")
    role = role.otherwise("test") if n_test is None else role.when(
        F.col("position") < n_train + n_test, "test")
    return placed.withColumn("role", role).where("role is not null").select(
        "split_id", row_id, "role")


def kfold_contiguous(df: DataFrame, row_id: str, k: int = 5) -> DataFrame:
    """Unshuffled folds in the order of ``row_id``; the first ``n mod k`` get one row more."""
    placed = sorted_positions(df, [], row_id).withColumn("_n", df.agg(F.count(F.lit(1))).scalar())
    size, extra = F.floor(F.col("_n") / k), F.col("_n") % k
    head = extra * (size + 1)
    fold = F.when(F.col("position") < head, F.floor(F.col("position") / (size + 1))).otherwise(
        extra + F.floor((F.col("position") - head) / F.greatest(size, F.lit(1))))
    return placed.withColumn("fold", fold.cast("bigint")).drop("position", "_n")


def stratified_kfold(df: DataFrame, y: str, row_id: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Rows of each class dealt out evenly over the folds in seeded order."""
    placed = hashed_positions(df.withColumn("_h", seeded_hash(seed, row_id)), [y], "_h", [row_id])
    return placed.withColumn("fold", F.col("position") % k).drop("_h", "position")


def group_folds(df: DataFrame, group: str, k: int = 5) -> DataFrame:
    """``(group, n, fold)``: groups never cross folds.

    Largest group first (equal ones in the order of ``group``), each into the fold that is
    lightest then. Groups of equal size go round the folds in an order that only their starting
    loads decide, so the choice is made once per size and not per group; ``r`` rows have at most
    ``sqrt(2 r)`` different group sizes.
    """
    sizes = materialise(df.groupBy(group).agg(F.count(F.lit(1)).alias("n")), "sizes")
    classes = sizes.groupBy("n").agg(F.count(F.lit(1)).alias("m")).orderBy(F.desc("n")).collect()
    laps = df.sparkSession.createDataFrame(
        deal_out([(c.n, c.m) for c in classes], k), "_n bigint, _first bigint, _last bigint, _folds array<bigint>")
    placed = global_positions(sizes, [F.desc("n"), F.asc(group)], "_position")
    at = F.col("_position")
    found = placed.join(laps, (F.col("n") == F.col("_n")) & at.between(F.col("_first"), F.col("_last")))
    turn = (at - F.col("_first")) % F.size("_folds")
    return found.select(group, "n", F.get("_folds", turn.cast("int")).alias("fold"))


def deal_out(classes: list[tuple[int, int]], k: int) -> list[tuple[int, int, int, list[int]]]:
    """``(size, first, last, folds)``: the groups from position ``first`` to ``last`` take the
    folds in turn. ``classes`` has size and number of groups, largest size first.

    A fold with load ``q * size + r`` is next in line at ``q``, then ``q + 1`` and so on: on each
    such level the folds that have reached it take one group each, in order of ``r``.
    """
    loads, laps, position = [0] * k, [], 0
    for size, groups in classes:
        levels = sorted({load // size for load in loads})
        for level, above in zip(levels, [*levels[1:], None]):
            turns = sorted((load % size, f) for f, load in enumerate(loads) if load // size <= level)
            folds = [f for _, f in turns]
            count = groups if above is None else min(groups, (above - level) * len(folds))
            if count:
                laps.append((size, position, position + count - 1, folds))
            for i, f in enumerate(folds):
                loads[f] += size * (count // len(folds) + (i < count % len(folds)))
            groups, position = groups - count, position + count
            if not groups:
                break
    return laps


def group_kfold(df: DataFrame, group: str, k: int = 5) -> DataFrame:
    """Rows with the fold of their group; a group of any size is one row of the lookup."""
    folds = group_folds(df, group, k).select(F.col(group).alias("_group"), "fold")
    return df.join(folds, F.col(group).eqNullSafe(F.col("_group"))).select(*df.columns, "fold")


def split_size_guard(grid: DataFrame, rows: str = "n_rows", n_train: str = "n_train",
                     n_test: str = "n_test") -> DataFrame:
    """Configurations whose table is large enough for their split."""
    return grid.where(F.col(rows) >= F.col(n_train) + F.col(n_test))
