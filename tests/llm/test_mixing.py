"""Mixing: targets against a plain resharing, tilts against their optimality conditions."""

import math

import numpy as np
import pytest

from tarnish.llm import mixing

SCHEMA = "doc_id long, source string, size long, target string"


def plain_targets(sizes, weights, cap):
    """Deal by weight, take off what is over, deal that again."""
    total, target, full = sum(sizes), [0.0] * len(sizes), set()
    rest = float(total)
    while True:
        open_ = [i for i in range(len(sizes)) if i not in full]
        if not open_:
            return target
        share = rest / sum(weights[i] for i in open_)
        over = [i for i in open_ if share * weights[i] > cap * sizes[i]]
        if not over:
            for i in open_:
                target[i] = share * weights[i]
            return target
        for i in over:
            target[i] = float(cap * sizes[i])
            rest -= target[i]
            full.add(i)


def rows_of(seed, n=3000, sources=(None, "b", "a", "é", "~", "Z", "tiny", "\U0001f642", "ﬁ")):
    rng = np.random.default_rng(seed)
    p = np.array([1, 30, 8, 8, 8, 8, .2, 3, 3])
    picked = rng.choice(len(sources), n, p=p / p.sum())
    return [(int(i), sources[s], int(rng.lognormal(5, 1.3)), "x") for i, s in enumerate(picked)]


@pytest.mark.parametrize("seed", range(2))
def test_mix(spark, seed, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", 200)
    rows = rows_of(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = mixing.mix(df)
    assert got.columns == ["doc_id", "source", "size", "target", "mix"]
    got = got.collect()
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows)
    names = sorted({r[1] for r in rows}, key=lambda s: (s is None, s and [ord(c) for c in s]))
    sizes = [sum(r[2] for r in rows if r[1] == s) for s in names]
    want = dict(zip(names, plain_targets(sizes, [1 + i % 3 for i in range(len(names))], 3)))
    for name, size in zip(names, sizes):
        own = [r for r in got if r.source == name]
        assert {r.mix.source_size for r in own} == {size}
        assert all(math.isclose(r.mix.target, want[name], rel_tol=1e-12) for r in own)
        shortest = min(r.size for r in own)
        buckets = -(-len(own) // 200)
        assert abs(sum(r.mix.taken for r in own) - want[name]) <= max(2 * buckets * shortest, 0.02 * want[name] + 5)
        assert math.isclose(sum(r.mix.rate * r.size for r in own), want[name], rel_tol=1e-6)
        # the tilt: log(rate) is a source's number plus a band's
    free = {(r.source, r.size.bit_length()): math.log(r.mix.rate) for r in got if r.mix.rate < 2.999 and r.size}
    pairs = [(a, b) for a in names for b in names if a != b]
    for a, b in pairs:
        gaps = [free[a, k] - free[b, k] for k in range(64) if (a, k) in free and (b, k) in free]
        assert not gaps or max(gaps) - min(gaps) < 1e-6
    assert all(r.mix.taken == r.mix.copies * r.size and 0 <= r.mix.copies <= 3 for r in got)
    again = {r.doc_id: r.mix.copies for r in mixing.mix(df).collect()}
    assert again == {r.doc_id: r.mix.copies for r in got}


def test_dual_derivatives():
    rng = np.random.default_rng(5)
    tokens = rng.integers(0, 900, (7, mixing.BANDS)).astype(float) * (rng.random((7, mixing.BANDS)) < .2)
    target = tokens.sum(1) * rng.uniform(.05, 3, 7)
    mu = rng.normal(0, .3, mixing.BANDS)
    out = mixing.dual(tokens, target, mu, 3.0)
    for b in range(0, mixing.BANDS, 9):
        up, down = (mixing.dual(tokens, target, mu + d * np.eye(mixing.BANDS)[b], 3.0) for d in (1e-5, -1e-5))
        assert abs((up[0] - down[0]) / 2e-5 - out[1 + b]) < 1e-3 * max(1, abs(out[1 + b]))
        slope = (up[1:65] - down[1:65]) / 2e-5
        assert np.abs(slope - out[65:].reshape(64, 64)[b]).max() < 2e-2 * max(1, np.abs(slope).max())


def test_lone_source_and_empties(spark):
    df = spark.createDataFrame([(1, None, 0, "x"), (2, None, 7, "x"), (None, None, 9, "y"), (2, None, 7, "x")], SCHEMA)
    got = mixing.mix(df).collect()
    assert sum(r.mix.taken for r in got) == 23 and {r.mix.target for r in got} == {23.0}
    assert mixing.mix(df.limit(0)).count() == 0
    assert mixing.mix(df.where("size = 0")).first().mix.taken == 0


def test_crowded_ids_are_split(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", 20)
    monkeypatch.setattr(mixing, "CROWDED", 50)
    rows = [(7, "a", 10, "x")] * 400 + [(i, "b", 10, "x") for i in range(400)]
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 800
    for s in "ab":
        own = [r for r in got if r.source == s]
        assert abs(sum(r.mix.taken for r in own) - own[0].mix.target) <= 250


def test_mixed_repeats_documents(spark):
    df = spark.createDataFrame([(i, "s%d" % (i % 3), "w " * (i + 1), "k") for i in range(40)], "doc_id long, source string, text string, size string")
    got = mixing.mixed(df)
    assert got.columns == df.columns
    counts = got.groupBy("doc_id").count().collect()
    assert max(r["count"] for r in counts) <= 3
    assert abs(sum(len(r.text.split()) for r in got.collect()) - sum(range(1, 41))) < 10
