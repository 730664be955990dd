"""MinHash: the edit by its definition, the likeness against true Jaccard, groups against all pairs."""

import hashlib
import random
import re

import numpy as np

from tarnish.llm import minhash

SCHEMA = "doc_id long, text string, group_id string"


def sets(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    a, b = sets(a), sets(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def made(n, seed=1):
    rng = random.Random(seed)
    texts = ["", None, "one", "Two words", "two WORDS", " \n", "é" * 999]
    while len(texts) < n:
        words = [f"w{rng.randrange(4000)}" for _ in range(rng.randrange(3, 400))]
        texts.append(" ".join(words))
        near = words.copy()
        for _ in range(rng.randrange(0, 6)):
            near[rng.randrange(len(near))] = "x"
        texts.append("\n".join(near))
    return texts[:n]


def test_likeness_follows_jaccard():
    known, errors = minhash.WordHashes(), []
    texts = made(120)
    fps = [minhash.short(minhash.signature(minhash.shingles((t or "").encode(), known))) for t in texts]
    for i in range(len(texts) - 1):
        errors.append(minhash.likeness(fps[i], fps[i + 1]) - jaccard(texts[i], texts[i + 1]))
    assert np.abs(errors).max() < 0.2 and abs(np.mean(errors)) < 0.02
    assert (fps[3] == fps[4]).all() and (fps[0] == 0).all()


def test_against_next(spark):
    texts = made(90)
    ids = [7 * i % 90 for i in range(90)]
    df = spark.createDataFrame(list(zip(ids, texts, texts)), SCHEMA).repartition(5)
    got = {r.doc_id: r for r in minhash.against_next(df).collect()}
    assert sorted(got) == sorted(ids)
    order = sorted(zip(ids, texts), reverse=True, key=lambda x: x[0])
    prints = {}
    for i, (d, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        new = text[:len(text) - half] + after[:half]
        assert got[d].n_chars == len(text)
        assert got[d].edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        assert abs(got[d].near_edited - jaccard(text, new)) < 0.25
        assert abs(got[d].near_next - jaccard(text, after)) < 0.25
        assert prints.setdefault(text, got[d].fingerprint) == got[d].fingerprint
        assert re.fullmatch("[0-9a-f]{256}", got[d].edited_fingerprint)


def test_small_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert minhash.against_next(empty).count() == 0 and minhash.near_duplicates(empty).count() == 0
    one = minhash.against_next(spark.createDataFrame([(4, "a b c d", "x")], SCHEMA)).collect()
    assert one[0].edited_sha256 == hashlib.sha256(b"a b a b").hexdigest() and one[0].near_next == 1.0
    rows = [(1, "p q", "x"), (1, "p q", "x"), (None, "p q", "y"), (None, None, "z")]
    got = minhash.against_next(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "1", "None", "None"]


def test_groups(spark):
    texts = made(80, 2)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts + texts[:20])], SCHEMA)
    got = minhash.near_duplicates(df)
    assert got.columns == ["doc_id", "text", "group_id"]
    root = list(range(100))
    for i in range(100):
        for j in range(i):
            if jaccard((texts * 2)[i], (texts * 2)[j]) >= 0.8:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    assert [r.group_id for r in sorted(got.collect(), key=lambda r: r.doc_id)] == root


def test_a_common_passage_draws_nobody_together(spark):
    rng = random.Random(4)
    passage = [f"p{i}" for i in range(60)]
    texts = [" ".join(passage + [f"q{rng.randrange(10 ** 6)}" for _ in range(60)]) for _ in range(40)]
    texts += [t + " end" for t in texts[:10]]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r.group_id for r in minhash.near_duplicates(df).collect()}
    assert got == {i: i if i < 40 else i - 40 for i in range(50)}


def test_every_link_of_a_large_group(spark):
    """One original and hundreds of edits that reach 0.8 with it, but not with each other."""
    rng = random.Random(6)
    original = [f"o{i}" for i in range(500)]
    texts = []
    for _ in range(300):
        edit = original.copy()
        for at in rng.sample(range(500), 10):
            edit[at] = f"e{rng.randrange(10 ** 9)}"
        texts.append(" ".join(edit))
    # the original itself, and a text that shares only a passage with it
    texts += [" ".join(original), " ".join(original[:250] + [f"z{i}" for i in range(250)])]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r.group_id for r in minhash.near_duplicates(df).collect()}
    every = [sets(t) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(every[i] & every[j])
            if root[i] != root[j] and both >= 0.8 * (len(every[i]) + len(every[j]) - both):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    assert [got[i] for i in range(len(texts))] == root
    assert root.count(0) > 250


def test_texts_left_apart_all_meet(spark, monkeypatch):
    monkeypatch.setattr(minhash, "HOLDERS", 4)
    rng = random.Random(8)
    rows, base = [], [rng.sample(range(10 ** 6), 60) for _ in range(6)]
    for i in range(150):
        own = set(rng.choice(base))
        for _ in range(rng.randrange(0, 10)):
            own.discard(rng.choice(sorted(own)))
            own.add(rng.randrange(10 ** 6))
        rows.append((i, i % 40, sorted(own)))
    want = {(a, b) for a, ra, x in rows for b, rb, y in rows if a < b and ra != rb
            and len(set(x) & set(y)) >= 0.8 * len(set(x) | set(y))}
    df = spark.createDataFrame(rows, "node long, root long, set array<long>")
    got = {tuple(r) for r in minhash.apart(df, 0.8).collect()}
    assert len(want) > 200 and want <= got
    assert {tuple(r) for r in minhash.verified(minhash.apart(df, 0.8), df.select("node", "set"), 0.8).collect()} == want
