import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnish.functions import vectors
from tarnish.operators import clean, encoders, metrics, ordering, quality, reduction, scaling, splits, tables, target
from tarnish.operators.models import pairing_rules
from tarnish.sources.cache import VectorCache
from tarnish.sources.files import decimal_comma


def frame(spark, values, schema):
    return spark.createDataFrame(values, schema)


# --------------------------------------------------------------------------- feature selection

@pytest.mark.parametrize("method, want", [("first", [0, 1]), ("last", [2, 3]), ("middle", [1, 2]),
                                          ("biggest_variance", [2, 3]), ("smallest_variance", [0, 1])])
def test_select_dimensions(spark, method, want):
    x = [[1, 2, 3, 4], [5, 6, 7, 8], [9, 10, 11, 12]]
    df = frame(spark, [(i, [float(v) for v in r]) for i, r in enumerate(x)], "i int, v array<double>")
    got = scaling.select_dimensions(df, "v", 2, method).orderBy("i").collect()
    assert [r.v for r in got] == [[r[j] for j in want] for r in x]
    assert all(len(r.v) == 2 for r in scaling.select_dimensions(df, "v", 2, "random").collect())


# --------------------------------------------------------------------------- splits

def test_fixed_size_split(spark):
    df = spark.range(5)
    sizes = {(r.split_id, r.role): r["count"] for r in splits.fixed_size_split(
        df, "id", 3, None, 2).groupBy("split_id", "role").count().collect()}
    assert sizes == {(0, "train"): 3, (0, "test"): 2, (1, "train"): 3, (1, "test"): 2}
    two = splits.fixed_size_split(df, "id", 2, 1, 2)
    assert two.count() == 6 and two.select("split_id", "id").distinct().count() == 6
    with pytest.raises(ValueError):
        splits.fixed_size_split(df, "id", 6)
    with pytest.raises(ValueError):
        splits.fixed_size_split(df, "id", 4, 2)


def test_splits_differ(spark):
    s = splits.fixed_size_split(spark.range(100), "id", 80, None, 5)
    trains = {tuple(r.ids) for r in s.where("role = 'train'").groupBy("split_id").agg(
        F.sort_array(F.collect_list("id")).alias("ids")).collect()}
    assert len(trains) == 5


def test_kfold_sizes_are_contiguous(spark):
    rows = splits.kfold_contiguous(spark.range(11), "id", 4).orderBy("id").collect()
    assert [r.fold for r in rows] == [0, 0, 0, 1, 1, 1, 2, 2, 2, 3, 3]


def greedy(sizes, k):
    """Largest group first into the lightest fold."""
    loads, folds = [0] * k, {}
    for g in sorted(sizes, key=lambda g: (-sizes[g], g)):
        f = loads.index(min(loads))
        folds[g], loads[f] = f, loads[f] + sizes[g]
    return folds


def test_groups_stay_together(spark):
    sizes = {"a": 9, "b": 7, "c": 4, "d": 3, "e": 3}
    df = frame(spark, [(g,) for g, n in sizes.items() for _ in range(n)] + [(None,)], "g string")
    folds = splits.group_folds(df, "g", 2).collect()
    assert {r.g: r.n for r in folds} == {**sizes, None: 1}
    assert {r.g: r.fold for r in folds if r.g} == greedy(sizes, 2)
    assert splits.group_kfold(df, "g", 2).count() == 27


@pytest.mark.parametrize("seed", range(30))
def test_dealing_by_size_is_the_greedy_choice(seed):
    rng = random.Random(seed)
    sizes = {i: rng.choice([1, 1, 1, 2, 3, 5, rng.randrange(1, 40)]) for i in range(rng.randrange(1, 200))}
    k = rng.randrange(1, 8)
    order = sorted(sizes, key=lambda g: (-sizes[g], g))
    classes = [(n, sum(s == n for s in sizes.values())) for n in sorted(set(sizes.values()), reverse=True)]
    got = {}
    for size, first, last, folds in splits.deal_out(classes, k):
        for p in range(first, last + 1):
            assert sizes[order[p]] == size
            got[order[p]] = folds[(p - first) % len(folds)]
    assert got == greedy(sizes, k)


def test_many_groups_follow_the_same_rule(spark):
    df = spark.range(30_003).select((F.col("id") % 10_001).alias("g"))
    folds = {r.g: r.fold for r in splits.group_folds(df, "g", 2).where("g < 12").collect()}
    assert folds == {g: g % 2 for g in range(12)}


def test_rows_without_a_class_keep_their_fold(spark):
    df = frame(spark, [(i, None if i % 3 == 0 else "ab"[i % 2]) for i in range(30)], "id int, y string")
    got = splits.stratified_kfold(df, "y", "id", 5).collect()
    assert len(got) == 30 and sorted(r.fold for r in got if r.y is None) == sorted(list(range(5)) * 2)


# --------------------------------------------------------------------------- ordered computations

def skewed(spark, seed=0):
    rng = random.Random(seed)
    rows = [(rng.choice("ab"), float(rng.randint(0, 40))) for _ in range(300)] + [("a", 7.0)] * 200
    return rows, frame(spark, rows, "g string, v double")


def test_quantiles(spark):
    rows, df = skewed(spark)
    got = {r.g: r for r in ordering.group_quantiles(df, ["g"], "v", {"q1": 0.25, "q2": 0.5, "q9": 0.9}).collect()}
    for g in "ab":
        v = [x for k, x in rows if k == g]
        assert (got[g].q1, got[g].q2, got[g].q9) == pytest.approx(tuple(np.quantile(v, [0.25, 0.5, 0.9])))
    one = ordering.group_quantiles(df, [], "v", {"m": 0.5}).first().m
    assert one == np.median([x for _, x in rows])


def test_average_ranks(spark):
    df = frame(spark, [("x", 3.0), ("x", 5.0), ("x", 5.0), ("x", 1.0), ("x", None)], "g string, v double")
    got = sorted((r.v, r["rank"]) for r in ordering.average_ranks(df, ["g"], "v").collect() if r.v is not None)
    assert got == [(1.0, 4.0), (3.0, 3.0), (5.0, 1.5), (5.0, 1.5)]


def test_auc_against_all_pairs(spark):
    rng = random.Random(1)
    rows = [(rng.randint(0, 1), float(rng.randint(0, 9))) for _ in range(200)]
    pos, neg = ([s for y, s in rows if y == k] for k in (1, 0))
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    got = metrics.roc_auc(frame(spark, rows, "y int, s double"), [], "y", "s").first().roc_auc
    assert got == pytest.approx(want)


# --------------------------------------------------------------------------- cleaning and targets

def test_false_missing(spark):
    df = frame(spark, [(v,) for v in ["", " ", "\t\n", "nan", "NaN", "?", "...", "N/A", "NAN", "missing", "n a"]], "t string")
    assert [r.t for r in clean.replace_false_missing(df).collect() if r.t is not None] == ["NAN", "missing", "n a"]


def test_sparse_column_at_threshold_is_kept(spark):
    df = frame(spark, [(None if i < 7 else "x", None if i < 8 else "x") for i in range(10)], "a string, b string")
    assert clean.drop_sparse_columns(df, ["a", "b"]).columns == ["a"]


def test_target_preparation(spark):
    df = frame(spark, [("b",), ("a",), ("c",), ("a",), (None,)], "t string")
    assert sorted((r.t, r.y) for r in target.prepare_target(df, "t").collect()) == [("a", 0), ("a", 0), ("b", 1), ("c", 2)]
    many = spark.range(30).select(F.col("id").cast("double").alias("t"))
    assert target.prepare_target(many, "t").where("y = 1").count() == 15
    assert dict(target.prepare_target(many, "t", regression=True).dtypes)["y"] == "float"
    twenty = spark.range(60).select((F.col("id") % 20).alias("t"))
    with pytest.raises(ValueError, match="too many classes"):
        target.prepare_target(twenty, "t")


def test_no_limit_on_classes_and_categories(spark):
    many = spark.range(100_050).select(F.concat(F.lit("c"), F.col("id") % 100_001).alias("t"))
    codes = target.label_encode(many, "t")
    assert codes.agg(F.max("y"), F.countDistinct("y")).first() == (100_000, 100_001)
    assert codes.where("t = 'c0'").first().y == 0 and codes.where("t = 'c99999'").first().y == 100_000
    known = encoders.ordinal_encode(many, "t", F.col("t") != "c0", "o")
    assert known.where("t = 'c0'").first().o == -1 and known.where("t = 'c99999'").first().o == 99_999
    few = frame(spark, [(str(i % 25),) for i in range(50)] + [(None,)], "t string")
    assert sorted({r.y for r in target.label_encode(few, "t").collect()}, key=str) == sorted([None, *range(25)], key=str)
    assert target.validate_target(few, "t").first()[:2] == (25, 51)


def test_grid_has_every_value(spark):
    got = tables.grid(spark.range(2), v=spark.range(3000).selectExpr("id % 2500"), w=F.array(F.lit(1), F.lit(2)))
    assert got.count() == 2 * 2500 * 2


def test_classes_of_nulls_dont_set_the_size(spark):
    df = frame(spark, [(i, None if i < 2 else i % 2) for i in range(20)], "id int, y int")
    got = target.balance_classes(df, "y", "id").collect()
    assert sorted(r.y for r in got) == [0] * 9 + [1] * 9


def test_normal_quantile(spark):
    from statistics import NormalDist

    from tarnish.functions.scalars import normal_quantile
    ps = [1e-9, 1e-4, 0.07, 0.075, 0.3, 0.5, 0.6, 0.925, 0.93, 0.999, 1 - 1e-7]
    got = frame(spark, [(p,) for p in ps], "p double").select("p", normal_quantile(F.col("p")).alias("z")).collect()
    assert all(abs(r.z - NormalDist().inv_cdf(r.p)) < 1e-9 for r in got)


def test_power_transform_finds_the_maximum(spark):
    rng = np.random.default_rng(3)
    values = {0: np.exp(rng.normal(0, 1, 300)), 1: -np.exp(rng.normal(0, 1, 300)), 2: rng.normal(5, 2, 300), 3: np.ones(300)}
    long = frame(spark, [(i, d, float(x), True) for d, v in values.items() for i, x in enumerate(v)], "id int, dim int, value double, train boolean")
    got = scaling.power_transform(long).collect()

    def likelihood(v, lam):
        up = np.log1p(v.clip(0)) if abs(lam) < 1e-9 else ((v.clip(0) + 1) ** lam - 1) / lam
        down = -np.log1p((-v).clip(0)) if abs(lam - 2) < 1e-9 else -(((-v).clip(0) + 1) ** (2 - lam) - 1) / (2 - lam)
        y = np.where(v >= 0, up, down)
        return -len(v) / 2 * np.log(y.var()) + (lam - 1) * np.sum(np.sign(v) * np.log1p(abs(v))), y
    for d in range(3):
        lam = max(np.arange(-8, 8, 1e-3), key=lambda x: likelihood(values[d], x)[0])
        y = likelihood(values[d], lam)[1]
        mine = np.array([r.value for r in sorted(got, key=lambda r: r.id) if r.dim == d])
        assert np.abs(mine - (y - y.mean()) / y.std()).max() < 0.02
    assert {r.value for r in got if r.dim == 3} == {1.0}


def test_balance(spark):
    df = frame(spark, [(i, int(i % 5 == 0)) for i in range(50)], "id int, y int")
    got = target.balance_classes(df, "y", "id")
    assert {r.y: r["count"] for r in got.groupBy("y").count().collect()} == {0: 10, 1: 10}


# --------------------------------------------------------------------------- tables and quality

def test_pivot_rejects_duplicates(spark):
    df = frame(spark, [("d", "m", 1.0), ("d", "m", 2.0)], "d string, m string, v double")
    with pytest.raises(Exception, match="duplicate"):
        tables.pivot_unique(df, ["d"], "m", "v", ["m"]).collect()


def test_explode_rejects_unequal_arrays(spark):
    df = frame(spark, [([1, 2], [1])], "a array<int>, b array<int>")
    with pytest.raises(Exception, match="different lengths"):
        tables.explode_parallel(df, ["a", "b"]).collect()


def test_pair_quality(spark):
    pred = frame(spark, [(1, 1), (2, 2), (2, 2), (3, 4)], "id_l int, id_r int")
    truth = frame(spark, [(1, 1), (2, 2), (3, 3), (4, 4)], "id_l int, id_r int")
    r = quality.pair_set_quality(pred, truth).first()
    assert (r.precision, r.recall) == pytest.approx((2 / 3, 1 / 2)) and r.f1 == pytest.approx(4 / 7)
    with pytest.raises(Exception, match="non-empty"):
        quality.pair_set_quality(pred.where("false"), truth).collect()


def test_join_quality_ignores_unmatched(spark):
    joined = frame(spark, [(1, 1), (2, None), (3, 4), (9, 9)], "id_l int, id_r int")
    truth = frame(spark, [(1, 1), (2, 2), (3, 3)], "id_l int, id_r int")
    r = quality.join_quality(joined, truth).first()
    assert (r.recall, r.precision) == pytest.approx((1 / 3, 1 / 2)) and r.f1 == pytest.approx(0.4)


def test_published_f1_follows_from_precision_and_recall(spark):
    # Published recall, precision and F1 of two label-free joins.
    rows = [(0.5185185185185185, 0.9376947040498442, 0.6677759290072101),
            (0.20833333333333334, 0.9375, 0.34090909090909094)]
    df = frame(spark, rows, "r double, p double, f1 double").withColumn("got", quality._f1(F.col("p"), F.col("r")))
    assert all(r.got == pytest.approx(r.f1) for r in df.collect())


def test_critical_difference(spark):
    rng = random.Random(2)
    rows = [(f"d{i}", m, base + rng.random() * 0.01) for i in range(20)
            for m, base in (("good", 0.9), ("fine", 0.9), ("poor", 0.5))]
    out = {r.m: r for r in quality.critical_difference_groups(
        frame(spark, rows, "d string, m string, v double"), "d", "m", "v").collect()}
    assert out["poor"].mean_rank == 3.0 and out["poor"].tied == []
    assert out["good"].tied == out["fine"].tied == [0]


# --------------------------------------------------------------------------- vectors, encoders

def test_wide_and_back(spark):
    df = frame(spark, [(1, 0.0, 1.0, 5.0)], "id int, `a__b__0` double, `a__b__1` double, `c__0` double")
    v = vectors.wide_to_vectors(df, ["id"])
    assert v.first().asDict() == {"id": 1, "a__b": [0.0, 1.0], "c": [5.0]}
    assert vectors.vector_to_wide(v, "a__b", 2).columns == ["id", "c", "a__b__0", "a__b__1"]
    with pytest.raises(ValueError):
        vectors.wide_to_vectors(df.drop("a__b__0"), ["id"])


def test_minhash_is_jaccard_like(spark):
    df = frame(spark, [(1, "abcdefgh"), (2, "abcdefgh"), (3, "abcdefgx"), (4, None), (5, "")], "i int, t string")
    for hashing in ("fast", "md5"):
        got = {r.i: r.v for r in encoders.encode(df, "t", "skrub__minhash_64", hashing=hashing).collect()}
        assert got[1] == got[2] and got[4] == got[5] == [0.0] * 64
        same = np.mean(np.array(got[1]) == np.array(got[3]))
        assert 0.4 < same < 0.95  # 15 of 21 grams... shared in most components
        assert 0 <= min(got[1]) and max(got[1]) < 1


def test_pairing(spark):
    rows = [("passthrough", "LogisticRegression", "lm__x", True), ("passthrough", "GradientBoostingClassifier", "lm__x", False),
            ("passthrough", "GradientBoostingClassifier", "skrub__minhash_30", True),
            ("passthrough", "GradientBoostingClassifier", "fasttext__30", True),
            ("PCA_30", "GradientBoostingClassifier", "lm__x", True), ("PCA_30", "LogisticRegression", "skrub__minhash_30", False)]
    df = frame(spark, rows, "dim_reduction string, model string, encoding string, ok boolean")
    kept = pairing_rules(df).collect()
    assert len(kept) == sum(r[3] for r in rows) and all(r.ok for r in kept)


def test_vector_cache(spark, tmp_path):
    cache = VectorCache(spark, str(tmp_path / "cache"))
    calls = []

    def model(texts):
        calls.append(sorted(r.text for r in texts.collect()))
        return texts.withColumn("v", F.array(F.length("text").cast("double")))

    a = frame(spark, [("x",), ("yy",)], "t string")
    b = frame(spark, [("yy",), ("zzz",), (None,)], "t string")
    cache.encode(a, "t", "d", "e", model).collect()
    got = {r.t: r.v for r in cache.encode(b, "t", "d", "e", model).collect()}
    assert got == {"yy": [2.0], "zzz": [3.0], None: None} and calls == [["x", "yy"], ["zzz"]]
    with pytest.raises(FileNotFoundError):
        cache.encode(frame(spark, [("new",)], "t string"), "t", "d", "e", model, fail_if_not_cached=True)
    cache.encode(a, "t", "d", "e", model, override_cache=True).collect()
    assert cache.read("d", "t", "e").count() == 2


def test_pca_and_svd(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 6)) @ np.diag([5, 3, 2, 1, 0.5, 0.1]) + 4
    df = frame(spark, [(i, v.tolist()) for i, v in enumerate(x)], "i int, v array<double>")
    c = x - x.mean(0)
    vt = np.linalg.svd(c, full_matrices=False)[2][:2]
    want = c @ (vt * np.sign(vt[np.arange(2), np.abs(vt).argmax(1)])[:, None]).T
    got = np.array([r.v for r in reduction.pca_reduce(df, "v", 2).orderBy("i").collect()])
    assert np.allclose(got, want, atol=1e-6)
    x = np.abs(x)
    df = frame(spark, [(i, v.tolist()) for i, v in enumerate(x)], "i int, v array<double>")
    long = df.select("i", F.posexplode("v").alias("dim", "w"))
    got = np.array([r.v for r in reduction.truncated_svd(long, "i", 2, n_iter=6).orderBy("i").collect()])
    s = np.linalg.svd(x, full_matrices=False)[1][:2]
    assert np.allclose(np.linalg.norm(got, axis=0), s, rtol=1e-4)


def test_scaling_against_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=200)
    df = frame(spark, [(i, 0, float(v), i < 150) for i, v in enumerate(x)], "id int, dim int, value double, train boolean")

    def run(out):
        return np.array([r.value for r in out.orderBy("id").collect()])

    train = x[:150]
    q1, q2, q3 = np.quantile(train, [0.25, 0.5, 0.75])
    assert np.allclose(run(scaling.robust_scale(df)), (x - q2) / ((q3 - q1) / 1.3489795003921634))
    power = run(scaling.power_transform(df))
    assert abs(power[:150].mean()) < 1e-9 and power[:150].std() == pytest.approx(1)
    normal = run(scaling.quantile_to_normal(df, "id"))
    assert np.corrcoef(normal, x)[0, 1] > 0.98 and abs(normal[:150].mean()) < 0.05
    assert math.isclose(run(scaling.rank_transform(df, "id")).max(), 200)


def test_decimal_comma(spark):
    df = frame(spark, [("1,4E+09",), ("Unknown",), ("7",), ("bad",)], "n string")
    assert [r.v for r in df.select(decimal_comma("n").alias("v")).collect()] == [1.4e9, None, 7.0, None]


def test_positions(spark):
    rows = [("a", 5), ("a", 2), ("a", 9), ("b", 1)]
    df = frame(spark, rows, "g string, v int")
    got = {(r.g, r.v): r.position for r in tables.row_position(df, ["g"], "v").collect()}
    assert got == {("a", 2): 1, ("a", 5): 2, ("a", 9): 3, ("b", 1): 1}
    assert {r.v: r.position for r in ordering.sorted_positions(df, [], "v").collect()} == {1: 0, 2: 1, 5: 2, 9: 3}


@pytest.mark.parametrize("n", [0, 1, 127, 128, 256, 257, 300, 1023])
def test_bucket_number_in_two_levels(spark, n):
    points = [float(i) for i in range(n)]
    values = [-1.0, 0.0, 0.5, 127.0, 127.5, 128.0, 255.5, 256.5, 299.5, 5000.0]
    df = frame(spark, [(v, points) for v in values], "v double, s array<double>")
    got = {r.v: r.b for r in df.select("v", ordering.bucket_of(F.col("v"), F.col("s")).alias("b")).collect()}
    assert got == {v: sum(p < v for p in points) for v in values}


@pytest.mark.parametrize("n", [1, 3, 1000])
def test_bucket_by_binary_search(spark, n):
    import random
    rng = random.Random(n)
    df = frame(spark, [(float(rng.choice([rng.randrange(20), rng.random() * 9])),) for _ in range(n)] + [(None,)], "v double")
    points = df.select(ordering.range_splits(df, "v").alias("s")).first().s
    assert all(r.b == sum(p < r.v for p in points or []) if r.v is not None else r.b == 0
               for r in ordering.with_bucket(df, "v", df, "b").collect())


def test_holm_over_many_tests(spark):
    import random
    from tarnish.operators.quality import holm
    rng = random.Random(4)
    rows = [(f"m{i}", f"m{i + 1}", rng.choice([rng.random() ** 9, round(rng.random(), 2)])) for i in range(3000)]
    got = {r.a: r.p_holm for r in holm(frame(spark, rows, "a string, b string, p double"), "p").collect()}
    top, want = 0.0, {}
    for i, (a, b, p) in enumerate(sorted(rows, key=lambda r: (r[2], r[0], r[1]))):
        top = max(top, min(1.0, p * (len(rows) - i)))
        want[a] = top
    assert got == pytest.approx(want, abs=1e-12)


def test_runs_of_tied_methods(spark, monkeypatch):
    """Runs from the farthest method before a difference, against all runs."""
    import random
    from itertools import combinations
    from pyspark.sql import functions as F
    from tarnish.operators import quality
    rng = random.Random(1)
    names = [f"m{i:02}" for i in range(25)]
    scores = [(d, m, float(i) + rng.random()) for d in range(6) for i, m in enumerate(names)]
    apart = {p for p in combinations(range(25), 2) if p[1] - p[0] > 2 and rng.random() < 0.2}
    pairs = frame(spark, [(names[a], names[b], 0.01 if (a, b) in apart else 0.5) for a, b in combinations(range(25), 2)],
                  "a string, b string, p_holm double")
    monkeypatch.setattr(quality, "wilcoxon_pairs", lambda *a: pairs)
    found = quality.critical_difference_groups(frame(spark, scores, "d int, m string, v double"), "d", "m", "v").orderBy("mean_rank").collect()
    order = [names.index(r.m) for r in found]

    def tied(i, j):
        return not any(tuple(sorted(p)) in apart for p in combinations(order[i:j + 1], 2))
    runs = [(i, j) for i, j in combinations(range(25), 2) if tied(i, j)]
    longest = [r for r in runs if not any(o != r and o[0] <= r[0] and r[1] <= o[1] for o in runs)]
    assert [r.tied for r in found] == [[g for g, (a, b) in enumerate(longest) if a <= i <= b] for i in range(25)]


def test_word_vectors_are_looked_up_before_any_shuffle(spark):
    docs = frame(spark, [(1, "Red  blue red\nnone"), (2, "none"), (3, None), (4, "blue"), (5, " ")], "id int, text string")
    words = frame(spark, [("red", [1.0, 2.0]), ("blue", [4.0, -4.0]), ("lost", None)], "word string, v array<double>")
    found = encoders.embedding_lookup_mean(docs, "id", "text", words)
    assert {r.id: r.v for r in found.collect()} == {1: [2.0, 0.0], 4: [4.0, -4.0]}
    # texts are moved once at most, as one row of sums each
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan and "ObjectHashAggregate" not in plan
    uneven = frame(spark, [("red", [1.0]), ("blue", [1.0, 2.0])], "word string, v array<double>")
    with pytest.raises(ValueError):
        encoders.embedding_lookup_mean(docs, "id", "text", uneven)


def test_statistics_go_to_the_rows(spark):
    # by its estimate too large to broadcast an aggregate of it
    long = spark.range(1_000_000).selectExpr("id DIV 2 AS i", "CAST(id % 2 AS INT) AS dim", "CAST(id % 7 AS DOUBLE) AS value", "id % 3 > 0 AS train")
    plan = scaling.preprocess_features(long, "i")._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
