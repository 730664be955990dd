"""Near-duplicates with sequential verification, against all pairs."""

import random
import re

import numpy as np
import pytest

from tarnish.llm import bayes_minhash
from tarnish.llm.minhash import WordHashes

SCHEMA = "doc_id long, text string"


def plain_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i:i + 3]) for i in range(max(1, len(words) - 2))} if words else set()


def plain_groups(ids, texts, least=85):
    sets, root = [plain_set(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= least * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    out = {}
    for i, d in enumerate(ids):
        known = [x for x in (out.get(find(i)), d) if x is not None]
        out[find(i)] = min(known, default=None)
    return [(d, len(s), out[find(i)], out[find(i)] is None or d == out[find(i)]) for i, (d, s) in enumerate(zip(ids, sets))]


def edits(rng, words, n, vocabulary):
    words = list(words)
    for at in rng.sample(range(len(words)), n):
        words[at] = rng.choice(vocabulary)
    return " ".join(words)


def corpus(seed=5):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(40):  # families: copies and edits around the threshold
        own = [rng.choice(vocabulary) for _ in range(rng.randint(3, 300))]
        texts += [" ".join(own), " ".join(own).upper()]
        texts += [edits(rng, own, min(len(own), k), vocabulary) for k in (1, 2, 3, 5, 8)]
    star = [rng.choice(vocabulary) for _ in range(200)]
    texts.append(" ".join(star))
    texts += [edits(rng, star, rng.randint(3, 5), vocabulary) for _ in range(250)]  # near the original, not near each other
    page = [rng.choice(vocabulary) for _ in range(150)]
    for _ in range(150):  # one passage in all, their own words besides
        texts.append(" ".join(page + [rng.choice(vocabulary) for _ in range(60)]))
    rng.shuffle(texts)
    return texts


def run(spark, rows, **options):
    got = bayes_minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3), **options).collect()
    return sorted([tuple(r) for r in got], key=repr)


def test_all_pairs(spark):
    texts = corpus()
    ids = list(range(10, 10 + len(texts)))
    assert run(spark, list(zip(ids, texts))) == sorted(plain_groups(ids, texts), key=repr)


def test_blocks_alone(spark, monkeypatch):
    """Without the rounds of the busiest, and with small blocks."""
    monkeypatch.setattr(bayes_minhash, "STARS", 1)
    monkeypatch.setattr(bayes_minhash, "BLOCK", 8)
    texts = corpus(6)
    ids = list(range(len(texts)))
    assert run(spark, list(zip(ids, texts))) == sorted(plain_groups(ids, texts), key=repr)


def test_odd_rows(spark):
    long = "many words " * 20_000
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (None, "one"), (6, "Two words"), (7, "two\twords"), (None, "alone here"),
            (None, "alone here"), (8, "a b c"), (8, "a b c"), (9, long), (10, long + "end"), (11, "é ü à"), (12, "É ü à"), (13, "a\x1cb c\x0cd")]
    ids, texts = zip(*rows)
    assert run(spark, rows) == sorted(plain_groups(ids, texts), key=repr)
    assert run(spark, []) == []


def test_other_columns(spark):
    df = spark.createDataFrame([(1, "a b c", 5, True, 2), (2, "A b c", 6, False, 3)], "id long, body string, _of int, kept boolean, _set int")
    got = bayes_minhash.near_duplicates(df, "id", "body")
    assert got.columns == ["id", "_of", "_set", "n_shingles", "component_id", "kept"]
    assert sorted(map(tuple, got.collect())) == [(1, 5, 2, 1, 1, True), (2, 6, 3, 1, 1, False)]


def test_bounds_keep_pairs_at_the_threshold():
    """Of signatures that agree with the probability of the threshold nearly none is dropped, of unlike ones nearly all are, early."""
    rng = np.random.default_rng(4)
    a = rng.integers(0, 256, (20_000, bayes_minhash.PERMUTATIONS), np.uint8)

    def kept(likeness):
        b = np.where(rng.random(a.shape) < likeness, a, a ^ rng.integers(1, 256, a.shape, np.uint8))
        return (bayes_minhash.surviving(a, b, bayes_minhash.LEAST, bayes_minhash.MISS) >= 0).mean()
    assert kept(0.85) == 1 and kept(0.3) == 0 and kept(0.6) < 0.3
    steps = bayes_minhash.needed()
    assert [n for n, _ in steps] == [25, 50, 75, 100, 125] and all(0 < m < n for n, m in steps)
    # against the posterior by numerical integration
    t = np.linspace(0, 1, 200_001)
    for n, m in steps:
        density = [t ** k * (1 - t) ** (n - k) for k in (m - 1, m)]
        tails = [d[t >= 0.85].sum() / d.sum() for d in density]
        assert tails[0] < bayes_minhash.MISS / 5 <= tails[1] * 1.01


def test_sets_and_signatures():
    known, rng = WordHashes(), random.Random(2)
    for text in corpus()[:60] + ["", "one", "a b", "x " * 5000]:
        assert len(bayes_minhash.shingle_set(text.encode(), known)) == len(plain_set(text))
    words = [rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randint(1, 9) for _ in range(3000)]
    one, two = (bayes_minhash.shingle_set(" ".join(w).encode(), known) for w in (words[:2000], words[400:2400]))
    true = len(np.intersect1d(one, two)) / len(np.union1d(one, two))
    same = np.mean(np.frombuffer(bayes_minhash.signature(one), np.uint8) == np.frombuffer(bayes_minhash.signature(two), np.uint8))
    assert same == pytest.approx(true, abs=0.15)
