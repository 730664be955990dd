"""The neighbour searches against brute force, with tiny chunks so that every path is taken."""

import math
import random
import re
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tarnish.operators import nearest
from tarnish.operators.fuzzy import fuzzy_join, fuzzy_matches, sweep_thresholds


def grams_wb(text, lo, hi):
    out = []
    for word in text.lower().split():
        w = f" {word} "
        if len(w) < lo:
            out.append(w)
        for n in range(lo, hi + 1):
            out += [w[i:i + n] for i in range(len(w) - n + 1)]
    return out


def grams_char(text, lo, hi):
    t = re.sub(r"\s\s+", " ", text.lower())
    return [t[i:i + n] for n in range(lo, hi + 1) for i in range(len(t) - n + 1)]


def brute(main, aux, grams=grams_wb, sizes=(2, 4), gap=None):
    """Best aux index and squared distance of every main text; lowest index wins ties."""
    rows = main + aux
    counts = [Counter(grams(t, *sizes)) for t in rows]
    df = Counter(g for c in counts for g in c)
    n = len(rows)
    vectors = []
    for c in counts:
        v = {g: k * (math.log((1 + n) / (1 + df[g])) + 1) for g, k in c.items()}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
        vectors.append({g: x / norm for g, x in v.items()})
    out = []
    for i in range(len(main)):
        best = None
        for j in range(len(aux)):
            a, b = vectors[i], vectors[len(main) + j]
            if a and b:
                cos = round(min(1.0, sum(x * b[g] for g, x in a.items() if g in b)), 9)
                d2 = 2 - 2 * cos
            else:
                d2 = float(bool(a) or bool(b))
            d2 = round(max(d2, 0) + (gap(i, j) if gap else 0), 9)
            if best is None or d2 < best[0]:
                best = (d2, j)
        out.append(best)
    return out


@pytest.fixture
def tiny_chunks(monkeypatch):
    monkeypatch.setattr(nearest, "CHUNK", 3)
    monkeypatch.setattr(nearest, "GROUP", 5)


def texts(seed, n):
    rng = random.Random(seed)
    words = ["ana", "anna", "lala", "north", "nort", "river", "rivers", "hill", "hills", "x", "42"]
    out = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    # copies of one text make up a third; some texts have no n-gram, some share none
    return out + ["common common"] * (n // 2) + ["", "  ", "zzzqqq%", "Common  common"]


def test_documented_examples(spark):
    left = spark.createDataFrame([("ana", 1), ("lala", 2), ("nana", 3)], "a string, b long")
    right = spark.createDataFrame([("anna", 5), ("lala", 6), ("ana", 7), ("nnana", 8)], "a string, c long")
    rows = fuzzy_join(left, right, on="a").orderBy("b").collect()
    assert [tuple(r) for r in rows] == [("ana", 1, "ana", 7), ("lala", 2, "lala", 6), ("nana", 3, "nnana", 8)]
    rows = fuzzy_join(left, right, on="a", match_score=1, return_score=True).orderBy("b").collect()
    assert [tuple(r) for r in rows] == [("ana", 1, "ana", 7, 1.0), ("lala", 2, "lala", 6, 1.0),
                                        ("nana", 3, None, None, 0.5)]
    kept = fuzzy_join(left, right, on="a", match_score=1, drop_unmatched=True)
    assert kept.columns == ["a_x", "b", "a_y", "c"] and kept.count() == 2


@pytest.mark.parametrize("analyzer, grams", [("char_wb", grams_wb), ("char", grams_char)])
def test_text_search_equals_brute_force(spark, tiny_chunks, analyzer, grams):
    main, aux = texts(1, 40), texts(2, 50)
    left = spark.createDataFrame(list(enumerate(main)), "i int, t string")
    right = spark.createDataFrame(list(enumerate(aux)), "j int, t string")
    got = fuzzy_join(left, right, on="t", analyzer=analyzer, order_by="j", return_score=True).collect()
    want = brute(main, aux, grams)
    worst = math.sqrt(max(d for d, _ in want))
    assert len(got) == len(main)
    for r in got:
        d2, j = want[r.i]
        assert r.j == j, (r, want[r.i])
        assert r.matching_score == pytest.approx(1 - math.sqrt(d2) / (2 * worst), abs=1e-7)
        assert 0.5 - 1e-9 <= r.matching_score <= 1


@pytest.fixture
def tiny_blocks(monkeypatch):
    """Several blocks on either side, few postings at a time."""
    from tarnish.operators import blocks
    monkeypatch.setattr(nearest, "ENTRIES", 400)
    monkeypatch.setattr(blocks, "BATCH", 64)
    monkeypatch.setattr(blocks, "SEEDS", 3)


def test_search_over_several_blocks_equals_brute_force(spark, tiny_blocks, monkeypatch):
    handed = []
    each = nearest._Blocks.each

    def spied(self, xs, ys, work, schema, own=False):
        found = each(self, xs, ys, work, schema, own).localCheckpoint()
        handed.append((found.count(), xs.count(), 1 if own else self.nx * self.ny))
        return found
    monkeypatch.setattr(nearest._Blocks, "each", spied)
    main, aux = texts(1, 40), texts(2, 50)
    left = spark.createDataFrame(list(enumerate(main)), "i int, t string")
    right = spark.createDataFrame(list(enumerate(aux)), "j int, t string")
    got = fuzzy_join(left, right, on="t", order_by="j").collect()
    assert {r.i: r.j for r in got} == {i: j for i, (_, j) in enumerate(brute(main, aux))}
    # a row per main text and aux block at most, never a row per pair
    assert len(handed) == 2 and handed[1][2] > 3
    assert all(rows <= texts * cells for rows, texts, cells in handed)


@pytest.mark.parametrize("exclude_self", [False, True])
def test_blocks_are_searched_in_parts(spark, monkeypatch, exclude_self):
    """A task lays out a part of a block at a time, and finds the same neighbours and counts."""
    words = sorted(set(texts(9, 60)))
    keys = spark.createDataFrame([(w, w, i, 1) for i, w in enumerate(words)], "k string, t string, o int, m int")
    radii = keys.select("k", F.explode(F.array(F.lit(0.4), F.lit(0.9), F.lit(1.3))).alias("r"))

    def results():
        weights = nearest.text_weights(keys, keys, "char_wb", (2, 4))
        near = nearest.nearest_text(keys, keys, exclude_self=exclude_self, weights=weights)
        return ({r.k: (r.ak, r.d) for r in near.collect()},
                {(r.k, r.r): r.n for r in nearest.count_within(radii, keys, weights).collect()})
    whole = results()
    monkeypatch.setattr(nearest, "PART", 100)
    assert results() == whole
    ids = [np.arange(n) for n in (30, 80, 60, 20, 150, 10)]
    rows = pd.DataFrame({"ids": ids, "cnts": [v * 0 + 1 for v in ids], "norm": 1.0})
    steps = SimpleNamespace(value=(np.array([0]), np.array([1.0])))
    assert [list(map(len, part["ws"])) for part in nearest._parts(rows, steps, 100)] == [[30], [80, 60, 20], [150, 10]]


def test_weights_take_little_disk(spark, monkeypatch, tmp_path):
    """What a search leaves on disk: a few bytes per n-gram of a text, not a row of digests and fractions."""
    from tarnish import session
    monkeypatch.setattr(session, "scratch_dir", lambda _: f"file://{tmp_path}")
    rng = random.Random(15)
    main = ["".join(rng.choice("abcdefgh ") for _ in range(60)) for _ in range(300)]
    left = spark.createDataFrame(list(enumerate(main)), "i int, t string")
    right = spark.createDataFrame([(i, t[1:]) for i, t in enumerate(main)], "j int, t string")
    got = fuzzy_join(left, right, on="t", analyzer="char", order_by="j")
    assert {r.i: r.j for r in got.collect()} == {i: i for i in range(300)}
    entries = sum(len(set(grams_char(t, 2, 4))) for text in main for t in (text, text[1:]))
    assert sum(f.stat().st_size for f in tmp_path.rglob("*.parquet")) < 8 * entries


def test_block_pairs_and_distances():
    """What a block finds, against all pairs; numbers added, an own row left out."""
    import pandas as pd
    from tarnish.operators.blocks import Block
    rng = np.random.default_rng(8)

    def side(n):
        dense = rng.random((n, 30)) * (rng.random((n, 30)) < 0.25)
        dense[:, 0] += 0.1
        dense /= np.sqrt((dense ** 2).sum(1))[:, None]
        # in one order everywhere, as rarest first is
        rows = [np.flatnonzero(v)[::-1] for v in dense]
        return dense, pd.DataFrame({"ids": rows, "ws": [v[r] for v, r in zip(dense, rows)], "z": list(rng.random((n, 2)))})
    (a, x), (b, y) = side(60), side(80)
    same = np.where(np.arange(60) % 3 == 0, np.arange(60), -1)
    gap = ((np.stack(x["z"])[:, None] - np.stack(y["z"])[None]) ** 2).sum(-1)
    want = np.round(np.maximum(2 - 2 * np.round(np.minimum(a @ b.T, 1), 9), 0) + gap, 9)
    want[same >= 0, same[same >= 0]] = 9
    best = np.full(60, 9.0)
    for xi, yi, d2 in Block(x, y, same).near(np.full(60, np.inf)):
        assert np.allclose(d2, want[xi, yi], atol=2e-9)
        np.minimum.at(best, xi, d2)
    assert np.allclose(best, want.min(1), atol=2e-9)
    plain = np.round(np.sqrt(np.round(2 - 2 * np.round(np.minimum(a @ b.T, 1), 9), 9)), 9)
    found = {(i, j) for xi, yi, d in Block(x.drop(columns="z"), y.drop(columns="z")).within(np.full(60, 1.0))
             for i, j, r in zip(xi, yi, d) if r <= 1.0}
    assert found == {(i, j) for i, j in zip(*np.nonzero(plain <= 1.0))}


def test_nothing_shared_and_all_equal(spark):
    left = spark.createDataFrame([(1, "abc")], "i int, t string")
    far = spark.createDataFrame([(5, "xyz"), (3, "uvw")], "j int, t string")
    assert fuzzy_join(left, far, on="t", order_by="j").first().j == 3
    same = fuzzy_join(left, spark.createDataFrame([(9, "abc")], "j int, t string"), on="t", return_score=True)
    assert same.first().matching_score == 1.0


def test_mixed_search_equals_brute_force(spark, tiny_chunks):
    rng = random.Random(3)
    main, aux = texts(4, 25), texts(5, 30)
    zm, za = ([round(rng.uniform(0, 9), 2) for _ in t] for t in (main, aux))
    std = np.std(zm + za)
    left = spark.createDataFrame([(i, t, z) for i, (t, z) in enumerate(zip(main, zm))], "i int, t string, z double")
    right = spark.createDataFrame([(i, t, z) for i, (t, z) in enumerate(zip(aux, za))], "j int, t string, z double")
    got = fuzzy_join(left, right, on=["t", "z"], order_by="j").collect()
    want = brute(main, aux, gap=lambda i, j: ((zm[i] - za[j]) / std) ** 2)
    assert {r.i: r.j for r in got} == {i: j for i, (_, j) in enumerate(want)}


def test_numeric_and_times(spark):
    rng = random.Random(6)
    main, aux = [rng.randint(0, 60) for _ in range(80)], [rng.randint(0, 60) for _ in range(30)] + [7] * 20
    left = spark.createDataFrame(list(enumerate(main)), "i int, z int")
    right = spark.createDataFrame(list(enumerate(aux)), "j int, z int")
    want = {i: min(range(len(aux)), key=lambda j: (abs(aux[j] - m), j)) for i, m in enumerate(main)}
    assert {r.i: r.j for r in fuzzy_join(left, right, on="z", order_by="j").collect()} == want
    as_time = [df.withColumn("z", F.timestamp_seconds(F.col("z") * 3600)) for df in (left, right)]
    assert {r.i: r.j for r in fuzzy_join(*as_time, on="z", order_by="j").collect()} == want


@pytest.mark.parametrize("dim", [2, 12])
def test_vectors(spark, tiny_chunks, dim):
    rng = np.random.default_rng(dim)
    centres = rng.normal(size=(5, dim)) * 4
    a = centres[rng.integers(0, 5, 60)] + rng.normal(size=(60, dim))
    b = centres[rng.integers(0, 5, 70)] + rng.normal(size=(70, dim))
    b[40:] = b[3]  # many copies of one vector
    left = spark.createDataFrame([(i, str(i), v.tolist()) for i, v in enumerate(a)], "i int, t string, v array<double>")
    right = spark.createDataFrame([(i, str(i), v.tolist()) for i, v in enumerate(b)], "j int, t string, v array<double>")
    got = fuzzy_join(left, right, on="t", main_vectors="v", aux_vectors="v", order_by="j").collect()
    want = np.round(np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1)), 9).argmin(1)
    assert {r.i: r.j for r in got} == dict(enumerate(want.tolist()))


def test_vector_blocks_without_main_or_aux_rows(spark):
    """Blocks of one or two vectors: some have no row of one side."""
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(12, 2)), rng.normal(size=(16, 2))
    left = spark.createDataFrame([(str(i), v.tolist()) for i, v in enumerate(a)], "k string, v array<double>")
    right = spark.createDataFrame([(str(i), i, v.tolist()) for i, v in enumerate(b)], "k string, o int, v array<double>")
    got = {int(r.k): int(r.ak) for r in nearest.nearest_vectors(left, right, chunk=1).collect()}
    assert got == dict(enumerate(((a[:, None] - b[None]) ** 2).sum(-1).argmin(1).tolist()))


def test_vector_visits_are_not_written(spark, tiny_chunks, monkeypatch):
    """Single precision stays as it is, and what is written has a row per vector, not one per visit."""
    written = []
    write = nearest.materialise

    def spied(df, label):
        table = write(df, label)
        written.append((dict(table.dtypes)["v"], table.count()))
        return table
    monkeypatch.setattr(nearest, "materialise", spied)
    rng = np.random.default_rng(4)
    a, b = (rng.normal(size=(n, 3)).astype("float32") for n in (30, 40))
    left = spark.createDataFrame([(i, str(i), v.tolist()) for i, v in enumerate(a)], "i int, t string, v array<float>")
    right = spark.createDataFrame([(i, str(i), v.tolist()) for i, v in enumerate(b)], "j int, t string, v array<float>")
    got = fuzzy_join(left, right, on="t", main_vectors="v", aux_vectors="v", order_by="j").collect()
    a, b = a.astype(float), b.astype(float)
    want = np.round(np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1)), 9).argmin(1)
    assert {r.i: r.j for r in got} == dict(enumerate(want.tolist()))
    assert written and all(kind == "array<float>" and n <= 40 for kind, n in written)


def test_options_and_errors(spark):
    left = spark.createDataFrame([(1, "ana", None), (2, None, 3.0)], "i int, t string, z double")
    right = spark.createDataFrame([(5, "anna", 1.0), (6, "nan", 2.0)], "j int, t string, z double")
    assert {r.i: r.j for r in fuzzy_join(left, right, on="t", order_by="j").collect()} == {1: 5, 2: 6}
    strict = fuzzy_join(left, right, on="t", order_by="j", null_as_text=False)
    assert {r.i: r.j for r in strict.collect()} == {1: 5, 2: None}
    assert {r.i: r.j for r in fuzzy_join(left, right, on="z", order_by="j").collect()} == {1: None, 2: 6}
    right_kept = fuzzy_join(left, right, how="right", on="t", order_by="i")
    assert right_kept.columns == ["i", "t_x", "z_x", "j", "t_y", "z_y"] and right_kept.count() == 2
    with pytest.raises(ValueError):
        fuzzy_join(left, right, on="t", how="outer")
    with pytest.raises(ValueError):
        fuzzy_join(left, right, on="t", analyzer="syllable")
    with pytest.raises(KeyError):
        fuzzy_join(left, right)
    with pytest.raises(TypeError):
        fuzzy_join(left, right, on="t", match_score="high")
    with pytest.raises(TypeError):
        fuzzy_join(left, right, left_on="t", right_on="z")


def test_encoder_and_sweep(spark):
    left = spark.createDataFrame([(1, "aa"), (2, "abb")], "i int, t string")
    right = spark.createDataFrame([(1, "a"), (2, "bbb")], "j int, t string")

    def letters(df):
        return df.select("k", F.array(*[F.length(F.regexp_replace("t", f"[^{c}]", "")).cast("double")
                                        for c in "ab"]).alias("v"))

    found = fuzzy_matches(left, right, on="t", encoder=letters, order_by="j")
    assert {r.i: r.j for r in found.apply().collect()} == {1: 1, 2: 2}
    sweep = sweep_thresholds(found, [0.5, 1.0]).collect()
    assert len(sweep) == 4 and sum(r.j is not None for r in sweep if r.match_score == 0.5) == 2


def test_search_within_one_table(spark, tiny_chunks):
    words = sorted(set(texts(7, 30)))
    keys = spark.createDataFrame([(w, w, i, 1) for i, w in enumerate(words)], "k string, t string, o int, m int")
    got = {r.k: r.d for r in nearest.nearest_text(keys, keys, exclude_self=True).collect()}
    assert set(got) == set(words)
    # the table stands on both sides, so frequencies are doubled alike
    twice = words + words
    counts = [Counter(grams_wb(t, 2, 4)) for t in twice]
    df, n = Counter(g for c in counts for g in c), len(twice)
    vec = []
    for c in counts[:len(words)]:
        v = {g: k * (math.log((1 + n) / (1 + df[g])) + 1) for g, k in c.items()}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
        vec.append({g: x / norm for g, x in v.items()})
    for i, w in enumerate(words):
        cos = max(sum(x * vec[j].get(g, 0.0) for g, x in vec[i].items()) for j in range(len(words)) if j != i)
        assert got[w] == pytest.approx(math.sqrt(2 - 2 * min(cos, 1.0)), abs=1e-4)


def test_ball_counts_against_all_pairs(spark):
    """Radii of every size, several per text, copies among the reference texts, texts that share nothing."""
    import random
    from tarnish.operators.nearest import count_within, text_weights
    rng = random.Random(12)
    texts = sorted({"".join(rng.choice("abcd") for _ in range(rng.randint(3, 9))) for _ in range(120)} | {"zzzz", "yyyy"})
    aux = [(f"k{i}", t, rng.choice([1, 1, 3])) for i, t in enumerate(texts)]
    main = spark.createDataFrame([(k, t, 1) for k, t, _ in aux[::2]] + [("q", "abcdq", 2)], "k string, t string, m int")
    right = spark.createDataFrame(aux, "k string, t string, m int")
    weights = text_weights(main, right, "char", (2, 3))
    vectors = {}
    for r in weights.collect():
        vectors.setdefault(r.k, {})[r.gram] = r.w

    def distance(a, b):
        cos = round(min(1.0, sum(w * vectors[b].get(g, 0.0) for g, w in vectors[a].items())), 9)
        return round(round(max(2 - 2 * cos, 0.0), 9) ** 0.5, 9)
    keys = [k for k, _, _ in aux[::2]] + ["q"]
    radii = [(k, r) for k in keys for r in {0.0, round(rng.random() * 1.5, 3), 1.2, 1.5, distance(k, rng.choice(aux)[0])}]
    got = {(r.k, r.r): r.n for r in count_within(spark.createDataFrame(radii, "k string, r double"), right, weights).collect()}
    assert got == {(k, r): sum(m for x, _, m in aux if distance(k, x) <= r) for k, r in radii}


def test_expected_precision_follows_the_balls(spark):
    from tarnish.operators.auto_fuzzy import auto_fuzzy_join, ball_counts
    left = spark.createDataFrame([(1, "golden gate bridge"), (2, "brooklyn bridge"), (3, "tower bridge east"), (4, "tower bridge west"), (5, "Tower Bridge West")],
                                 "id int, title string")
    right = spark.createDataFrame([(10, "golden gate brigde"), (11, "brooklyn bridge"), (12, "tower bridge est"), (13, "qqq")], "id int, title string")
    balls = {r.id_r: (r.id_l, r.ball) for r in ball_counts(left, right, "id", "title").collect()}
    assert balls[11] == (2, 1) and balls[10][0] == 1 and balls[12][0] in (3, 4) and 13 not in balls
    assert balls[10][1] == 1 and balls[12][1] >= 1
    got = {r.id_r: (r.id_l, r.expected) for r in auto_fuzzy_join(left, right, "id", "title", 0.9).collect()}
    assert got[11] == (2, 1.0) and got[10] == (1, 1.0) and 13 not in got
    assert sum(e for _, e in got.values()) / len(got) >= 0.9


@pytest.mark.parametrize("analyzer", ["char", "char_wb"])
def test_ngrams_are_looked_up_in_tasks(spark, monkeypatch, analyzer):
    """Character n-grams get their numbers without being moved; the same weights as by a join."""
    words = sorted(set(texts(11, 40)) | {"a", "b c", "Straße ÄÖ", "𝒳y z"})
    main, aux = (spark.createDataFrame([(w, w, m) for w in part], "k string, t string, m int") for part, m in ((words[::2], 2), (words[1:], 1)))

    def rows():
        weights = nearest.text_weights(main, aux, analyzer, (2, 4))
        return {r.k: (r.held, r.ids[:r.held], r.cnts[:r.held], round(r.norm, 9)) for r in weights.texts.collect()}
    with monkeypatch.context() as m:
        m.setattr(nearest, "gram_counts", None)
        got = rows()
    monkeypatch.setattr(nearest, "LOOKUP", 0)
    assert got == rows() and len(got) > 30


def test_ngrams_of_one_side_move_as_sums(spark, monkeypatch, tmp_path):
    """Of words that only the aux texts hold nothing is written but the norm."""
    main = spark.createDataFrame([("a", "shared words here", 1)], "k string, t string, m int")
    long = [(f"k{i}", "shared words " + " ".join(f"w{i}x{j}" for j in range(100)), 1) for i in range(20)]
    aux = spark.createDataFrame(long, "k string, t string, m int")
    weights = nearest.text_weights(main, aux, "word", (1, 2))
    rows = {r.k: r for r in weights.texts.collect()}
    assert all(len(r.ids) == len(r.cnts) == r.held == 3 for r in rows.values())
    # 100 words and 100 pairs of words, each in one of 21 rows, and the three of all
    alone, every = math.log(22 / 2) + 1, math.log(22 / 22) + 1
    assert rows["k7"].norm == pytest.approx(math.sqrt(200 * alone ** 2 + 3 * every ** 2))


def test_pairs_sifted_by_masks():
    """Texts of many n-grams, most of them rare: no near pair is lost, and few of the others are measured."""
    from tarnish.operators.blocks import Aux, Block
    rng = np.random.default_rng(21)
    sets = [np.sort(rng.choice(400, 12, replace=False)) for _ in range(300)]
    sets += [np.sort(np.concatenate([s[2:], [400, 401]])) for s in sets[:100]]
    frame = pd.DataFrame({"ids": sets, "ws": [np.full(len(s), len(s) ** -0.5) for s in sets]})
    dense = np.zeros((400, 402))
    for i, s in enumerate(sets):
        dense[i, s] = len(s) ** -0.5
    cos = np.round(np.minimum(dense @ dense.T, 1.0), 9)
    block = Block(frame, Aux(frame))
    got = [pairs for pairs in block.within(np.full(400, np.sqrt(2 - 2 * 0.6)))]
    found = {(i, j) for xi, yi, _ in got for i, j in zip(xi, yi)}
    assert found >= set(zip(*np.nonzero(cos >= 0.6))) and len(found) < 2000


def test_main_texts_stay_where_they_are(spark, tiny_blocks, monkeypatch):
    """A further aux block moves no main text: what is shuffled does not grow with the number of blocks."""
    plans = []
    write = nearest.materialise
    monkeypatch.setattr(nearest, "materialise", lambda df, label: plans.append((label, df._jdf.queryExecution().optimizedPlan().toString())) or write(df, label))
    main, aux = (spark.createDataFrame([(t, t, i, 1) for i, t in enumerate(sorted(set(texts(s, 40))))], "k string, t string, o int, m int") for s in (13, 14))
    assert nearest.nearest_text(main, aux).count() == len(set(texts(13, 40)))
    rounds = [p for label, p in plans if label == "block"]
    assert len(rounds) > 1 and not any("Join" in p or "CoGroup" in p for p in rounds)


def test_negative_rules_keep_apart_what_left_rows_differ_in(spark):
    from tarnish.operators.auto_fuzzy import auto_fuzzy_join, barred_pairs
    left = spark.createDataFrame([(1, "2007 LSU Tigers football team"), (2, "2008 LSU Tigers football team"), (3, "Alabama Tide baseball squad (2007)"),
                                  (4, "golden gate bridge"), (5, None)], "id int, title string")
    right = spark.createDataFrame([(10, "Alabama Tide baseball squad, 2008"), (11, "golden gate brigde"), (12, "Alabama Tide baseball squad 2009"),
                                   (13, "2007 LSU Tigers football team")], "id int, title string")
    pairs = spark.createDataFrame([(3, 10), (4, 11), (3, 12), (1, 13), (2, 13), (3, 13)], "id_l int, id_r int")
    # 2007 and 2008 differ between two left rows, 2009 is in none
    assert sorted(map(tuple, barred_pairs(pairs, left, right, "id", "title").collect())) == [(2, 13), (3, 10)]
    got = {r.id_r: r.id_l for r in auto_fuzzy_join(left, right, "id", "title", 0.9).collect()}
    assert got[12] == 3 and got[13] == 1 and 10 not in got


def test_a_common_last_ngram_is_not_visited(monkeypatch):
    """Texts that share their most common n-gram alone: the nearest, the lowest of equally near ones, without all pairs."""
    from tarnish.operators import blocks
    monkeypatch.setattr(blocks, "FEW", 4)
    rng = np.random.default_rng(5)
    ids = [np.array(sorted({int(rng.integers(0, 150)), *([int(rng.integers(0, 40))] if i % 3 == 0 else []), 200})) for i in range(300)]
    # weights of a few sorts, so that many are equally near
    ws = [np.array([0.9] * (len(v) - 1) + [0.2 + 0.1 * (i % 3)]) for i, v in enumerate(ids)]
    order = rng.permutation(300)
    y = pd.DataFrame({"ids": ids, "ws": [w / np.sqrt((w * w).sum()) for w in ws], "o": order})
    dense = np.zeros((300, 201))
    for i, (v, w) in enumerate(zip(y["ids"], y["ws"])):
        dense[i, v] = w
    d2 = np.round(2 - 2 * np.round(np.minimum(dense @ dense.T, 1), 9), 9)
    np.fill_diagonal(d2, 9)
    want = [min((d2[i, j], order[j]) for j in range(300)) for i in range(300)]
    got, pairs = {}, 0
    for xi, yi, d in blocks.Block(y, blocks.Aux(y), np.arange(300)).near(np.full(300, np.inf)):
        pairs += len(xi)
        for i, j, v in zip(xi, yi, d):
            got[i] = min(got.get(i, (9, 999)), (v, order[j]))
    assert [got[i][1] for i in range(300)] == [o for _, o in want] and pairs < 300 * 40
