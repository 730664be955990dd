"""SimHash: the fingerprint by its definition, the links against all pairs."""

import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import types as T

from tarnish.llm import simhash
from tarnish.llm.components import components

SCHEMA = "doc_id long, text string, fp long"


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, fps, k=2):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= k:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        r = find(i)
        known = [x for x in (least.get(r), d) if x is not None]
        least[r] = min(known, default=None)
    return [least[find(i)] for i in range(len(fps))]


TEXTS = ["", None, "  \n", "one", "Two words", "a b c", "A B C", "x" * 5000, "é à ü ÀÉ", "t u v w",
         "the same words again and again the same words again and again", "tab\tand\x0bfeeds\x0c here \x1c too", "w " * 3000]


def test_fingerprint_by_definition():
    for text in TEXTS:
        got = simhash.fingerprint((text or "").encode())
        assert got & (1 << 64) - 1 == plain_fingerprint(text)


def test_hash_is_the_engines_own(spark):
    row = spark.sql("select xxhash64('a b c') h").first()
    assert simhash.shingle_hashes(b"a b c").view(np.int64)[0] == row.h


def test_documents(spark):
    ids = [5, 4, None, 9, 3, 8, 2, 7, 7, 1, 11, 12, 13]
    df = spark.createDataFrame(list(zip(ids, TEXTS, range(13))), SCHEMA)
    got = sorted(simhash.near_duplicates(df).collect(), key=lambda r: r.fp)
    fps = [plain_fingerprint(t) for t in TEXTS]
    assert [r.fingerprint for r in got] == [f"{f:016x}" for f in fps]
    assert [r.component_id for r in got] == plain_components(ids, fps)
    kept = simhash.one_of_each(df)
    assert kept.columns == df.columns
    # an id with two unlike texts keeps both
    assert sorted({r.doc_id for r in kept.collect() if r.doc_id is not None}) == sorted(set(plain_components(ids, fps)))


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(df).count() == 0 and simhash.one_of_each(df).count() == 0


def clouds(rng, n):
    """Chains and tight clouds around a few centres, far more alike than chance."""
    centres = rng.integers(0, 1 << 64, 5, np.uint64)
    out = [rng.choice(centres, n)]
    for _ in range(3):
        out.append(np.uint64(1) << rng.integers(0, 64, n, np.uint64) * (rng.random(n) < .6).astype(np.uint64))
    return np.unique(np.bitwise_xor.reduce(out))


@pytest.mark.parametrize("seed", range(3))
def test_tree_finds_every_pair(spark, seed, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 16)
    monkeypatch.setattr(simhash, "SHARD", 64)
    rng = np.random.default_rng(seed)
    fps = np.unique(np.concatenate([clouds(rng, 400), rng.integers(0, 1 << 64, 500, np.uint64)]))
    signed = [int(x) for x in fps.view(np.int64)]
    edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"))
    root = {r.node: r.root for r in components(edges).collect()}
    want = plain_components(signed, [int(x) for x in fps])
    assert [root.get(x, x) for x in signed] == want
    nodes, shards = simhash.fit_tree(fps[::3], 3, 2)
    assert shards > 1 and len(nodes) == shards - 1


def test_shard_groups():
    rng = np.random.default_rng(3)
    fps = clouds(rng, 3000)
    want = plain_components(list(range(len(fps))), [int(x) for x in fps])
    assert simhash.near_groups(fps, 2).tolist() == want


def test_components_of_a_path_and_a_star(spark):
    rows = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(1, 41), 0), **dict.fromkeys(range(101, 150), 100)}
    none = spark.createDataFrame([], T.StructType([T.StructField(c, T.LongType()) for c in "ab"]))
    assert components(none).count() == 0


def test_near_copies_go_whatever_their_bits(spark):
    rng = np.random.default_rng(5)
    texts = []
    for _ in range(12):
        words = [f"w{x}" for x in rng.integers(0, 10 ** 6, 120)]
        edit = words.copy()
        edit[20], edit[90] = "x", "y"  # 10 of 116 shingles: Jaccard 0.84
        texts += [" ".join(words), " ".join(edit)]
    bits = [(plain_fingerprint(a) ^ plain_fingerprint(b)).bit_count() for a, b in zip(texts[::2], texts[1::2])]
    assert max(bits) > 2
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], SCHEMA)
    assert sorted(r.doc_id for r in simhash.one_of_each(df).collect()) == list(range(0, 24, 2))


def test_pipeline_stage_keeps_rows_and_not_ids(spark):
    import corpus_pipeline
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(5, a, 1), (5, b, 2), (3, b, 3), (None, a, 4), (None, c, 5), (None, c, 5), (7, a, 6), (3, b, 3)]
    got = corpus_pipeline.dedup_documents(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert sorted((r.doc_id or 0, r.text, r.fp) for r in got) == [(0, c, 5), (3, b, 3), (5, a, 1)]
