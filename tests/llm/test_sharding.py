"""Sharding: near equal sizes, gapless slots, copies together, hot groups divided."""

import random

import pytest

from tarnish.llm import sharding

SCHEMA = "doc_id long, size long, group long, slot string"


def checked(got, shards, most):
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    total, largest = sum(r.size or 0 for r in got), max(r.size or 0 for r in got)
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
        assert abs(sum(r.size or 0 for r in own) - total / shards) <= most * total / shards + largest
    assert set(by) <= set(range(shards))
    return by


@pytest.mark.parametrize("seed", range(2))
def test_sizes(spark, seed, monkeypatch):
    monkeypatch.setattr(sharding, "RECORDS", 30)
    rng = random.Random(seed)
    rows = [(i, int(rng.lognormvariate(5, 1)), i if rng.random() < .8 else rng.randrange(300), "x") for i in range(6000)]
    got = sharding.shard(spark.createDataFrame(rows, SCHEMA).repartition(5), 8)
    assert got.columns == ["doc_id", "size", "group", "shard", "slot"]
    got = got.collect()
    assert sorted(r.doc_id for r in got) == list(range(6000))
    by = checked(got, 8, 0.02)
    assert len(by) == 8
    homes = {}
    for r in got:
        homes.setdefault(r.group, set()).add(r.shard)
    assert sum(len(h) > 1 for h in homes.values()) <= 7


def test_hot_group_and_equal_rows_are_divided(spark):
    rows = [(i, 100, 7, "x") for i in range(2000)] + [(5, 100, 5, "x")] * 2000 + [(i, 100, i, "x") for i in range(2000)]
    got = sharding.shard(spark.createDataFrame(rows, SCHEMA), 8).collect()
    assert len(got) == 6000
    assert len(checked(got, 8, 0.02)) == 8


def test_defined_cases(spark):
    assert sharding.shard(spark.createDataFrame([], SCHEMA), 8).count() == 0
    rows = [(None, None, None, "x"), (1, None, 3, "x"), (None, 5, 3, None), (2, 90_000_000, 4, "x")]
    got = sharding.shard(spark.createDataFrame(rows, SCHEMA), 3).collect()
    assert len(got) == 4
    zeros = sharding.shard(spark.createDataFrame(rows[:2], SCHEMA), 3).collect()
    assert sorted((r.shard, r.slot) for r in zeros) == [(zeros[0].shard, 0), (zeros[0].shard, 1)]
    assert len(sharding.shard(spark.createDataFrame(rows, SCHEMA), 1).collect()) == 4


def test_overfull_ranges_are_cut(spark, monkeypatch):
    # a sample too thin to place the first cuts well
    monkeypatch.setattr(sharding, "POINTS", 2)
    rows = [(i, 1 + i % 50, i, "x") for i in range(4000)]
    keyed = spark.createDataFrame(rows, SCHEMA).selectExpr("xxhash64(`group`) g", "xxhash64(doc_id) t", "doc_id u", "size")
    total = sum(r[1] for r in rows)
    cuts = sharding.splitters_of(keyed, 64, total)
    from pyspark.sql import functions as F
    sums = sharding.with_range(keyed, cuts).groupBy("r").agg(F.sum("size").alias("s")).collect()
    assert max(r.s for r in sums) <= 2 * total / 64 + 50
    keys = sorted(tuple(r)[:3] for r in keyed.collect())
    ranged = {(r.g, r.t, r.u): r.r for r in sharding.with_range(keyed, cuts).collect()}
    assert [ranged[k] for k in keys] == [sum(c <= k for c in cuts) for k in keys]


def test_written_shards(spark, tmp_path):
    rows = [(i, 10, i, "x") for i in range(100)]
    sharding.write_shards(sharding.shard(spark.createDataFrame(rows, SCHEMA), 4), f"file://{tmp_path}/out")
    back = spark.read.parquet(f"file://{tmp_path}/out")
    assert back.count() == 100 and back.select("shard").distinct().count() == 4


@pytest.mark.parametrize("kind", ["spread", "one group", "one id", "few"])
def test_ranges_against_bisection(spark, kind):
    from bisect import bisect_right
    rng = random.Random(3)

    def word():
        return rng.randrange(-(1 << 63), 1 << 63)
    hot, twin = word(), word()
    keys = [{"spread": (word(), word(), word()), "one group": (hot if i % 3 else word(), word(), word()),
             "one id": (hot, twin if i % 5 else word(), word()), "few": (i % 3, i % 2, word())}[kind] for i in range(3000)]
    splitters = sorted(rng.sample(keys, 700) + [(hot, twin, word()), (-(1 << 63), 0, 0), ((1 << 63) - 1, 0, 5)])
    rows = [(*k, 1) for k in keys] + [(-(1 << 63), 0, 0, 1), ((1 << 63) - 1, 0, 5, 1), ((1 << 63) - 1, 0, 4, 1)]
    for cut in (splitters, splitters[:1], splitters[:2]):
        got = sharding.with_range(spark.createDataFrame(rows, "g long, t long, u long, size long"), cut).collect()
        assert len(got) == len(rows)
        assert all(r.r == bisect_right(cut, (r.g, r.t, r.u)) for r in got)
