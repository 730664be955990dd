"""Phrases against plain counting, the double array against a dictionary."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tarnish.llm import phrases

SCHEMA = "doc_id long, text string, lang string"


def plain(rows, least, top=2000):
    """Rows ``(lang, rank, phrase, a, l, r, n, score)`` by counting every window."""
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                f[lang].update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        gone = set()
        for p, a in found.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    if 100 * a >= 80 * counts[p[i:i + k]]:
                        gone.add(p[i:i + k])
        rows_ = []
        for p, a in found.items():
            if p not in gone:
                score, k = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
                rows_.append((-score, -a, " ".join(p).encode(), a, counts[p[:k]], counts[p[k:]]))
        for rank, (score, _, p, a, l, r) in enumerate(sorted(rows_)[:top], 1):
            out.append((lang, rank, p.decode(), a, l, r, n[lang], -score))
    return sorted(out)


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    return sorted(map(tuple, phrases.collocations(df, **options).collect()))


def corpus(seed=1, texts=150):
    rng = random.Random(seed)
    words = ["the", "of", "New", "york", "city", "los", "san", "é", "ü", "Straße", "a-b", "(x)", "🙂"] + [f"w{i}" for i in range(30)]
    fixed = ["new york city hall", "los angeles", "San José de", "the end of the", "a a a a a", "one\x01two x"]
    out = []
    for i in range(texts):
        parts = []
        for _ in range(rng.randint(0, 30)):
            parts.append(rng.choice(fixed) if rng.random() < 0.4 else " ".join(rng.choices(words, k=rng.randint(1, 6))))
            parts.append(rng.choice([" ", " ", "\t ", ". ", ",", "\n", "; ", "\x0b", "?!", " \r\n"]))
        out.append((i, "".join(parts), rng.choice(["en", "de", None, "", "und"])))
    return out


@pytest.mark.parametrize("least", [2, 5, 30])
def test_against_counting(spark, least):
    rows = corpus()
    assert run(spark, rows, least=least) == plain(rows, least)


def test_many_tries_small_chunks_and_a_short_list(spark, monkeypatch):
    rows = corpus(2)
    for name, value in (("HELD", 100), ("COUNTED", 40), ("SEEN", 30)):
        monkeypatch.setattr(phrases, name, value)
    assert run(spark, rows, least=3, trie_size=100, top=15) == plain(rows, 3, 15)


def test_full_bitmap_loses_nothing(spark, monkeypatch):
    rows = corpus(3, 60)
    monkeypatch.setattr(phrases, "BITS", 64)
    assert run(spark, rows, least=4) == plain(rows, 4)


def test_phrases_that_share_a_code_are_all_found(spark, monkeypatch):
    rows, real = corpus(4, 80), phrases.codes
    asked, searched = [], phrases.candidates

    def few_codes(lang, ids, k):
        return real(lang, ids, k) & np.uint64(0x1F0000001F)

    def search(texts, below, wanted, marked):
        asked.append(marked)
        return searched(texts, below, wanted, marked)

    def few_windows(lang, ids, k, below):
        short = phrases.full(ids, k - 1)
        short[short] = phrases.on(below, few_codes(lang, ids, k - 1)[short])
        return short & np.append(short[1:], False) & phrases.full(ids, k)

    # tasks import the module anew: what they call by name is given to them as local functions
    for name, value in (("codes", few_codes), ("windows", few_windows), ("candidates", search)):
        monkeypatch.setattr(phrases, name, value)
    assert run(spark, rows, least=4) == plain(rows, 4)
    assert asked == [True, False]


def test_each_phrase_is_given_by_few_texts(spark):
    """Two thousand texts that share a phrase: the texts of one mark give it."""
    rows = [(i, f"some shared words u{i}", "en") for i in range(2000)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(8).select("lang", "text")
    texts = phrases.materialise(phrases.encoded(docs, 0).where("ids is not null").select("lang", "ids"), "encoded")
    all_on = spark.sparkContext.broadcast(np.full(phrases.BITS // 8, 255, np.uint8))
    own = phrases.frequent_codes(texts, 2, all_on, 30)
    assert sorted(r.n for r in own.collect()) == [2000, 2000]
    key = F.col("code").bitwiseXOR(F.col("mark") * F.lit(phrases.MARKED)).alias("code")
    wanted = {2: spark.sparkContext.broadcast(phrases.bitmap(own.select(key)))}
    found = phrases.candidates(texts, {1: all_on}, wanted, True).collect()
    assert len(found) == 2 and {r.code for r in found} == {r.code for r in own.collect()}


def test_odd_rows(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None, None), (2, "", "en"), (3, " .,\n", "en"), (4, "alone", "en")]) == []
    rows = [(1, "x y " * 40, "en"), (1, "x y " * 40, "en"), (2, "x y z", None), (3, "long words here " * 30_000, "en"), (4, "ÀB c D " * 40, "en")]
    assert run(spark, rows) == plain(rows, 30)
    clash = spark.createDataFrame([(1, "a b. " * 40, "en", 5, "q", 1)], "doc_id long, text string, lang string, n int, word string, hash int")
    assert [r.phrase for r in phrases.collocations(clash).collect()] == ["a b"]


def test_scores_beyond_64_bits(spark):
    big = 9 * 10 ** 18
    found = spark.createDataFrame([("en", [1, 2], big)], "lang string, w array<bigint>, f bigint")
    words = spark.createDataFrame([("en", 1, big), ("en", 2, big + 7)], "lang string, hash bigint, f bigint")
    assert phrases.scored(found, words).first().cut.score == 2000000 * big // (2 * big + 7)


def test_a_hash_shared_by_two_words(spark, monkeypatch):
    rows, real, seeds = [(1, "a b c. " * 40, "en")], phrases.encoded, []

    def clashing(docs, seed):
        seeds.append(seed)
        found = real(docs, seed)
        return found.withColumn("hash", F.when(F.length("word") == 1, F.lit(7)).otherwise(F.col("hash"))) if seed == 0 else found
    monkeypatch.setattr(phrases, "encoded", clashing)
    assert run(spark, rows) == plain(rows, 30) and seeds == [0, 1]


def test_counts_leave_a_task_per_core(spark):
    trie, states = phrases.build(pa.array(["en"]), np.array([[5, 6, 0, 0]], np.uint64))
    tries_ = spark.sparkContext.broadcast(phrases.Tries.of([trie]))
    texts = spark.createDataFrame([("en", bytearray(np.array([5, 6, 9, 5, 6], np.uint64).tobytes()))] * 60, "lang string, ids binary").repartition(30)
    assert phrases.task_counts(texts, tries_).count() <= spark.sparkContext.defaultParallelism
    assert [tuple(r) for r in phrases.counted(texts, tries_).collect()] == [(0, int(states[0]), 120)]


def test_streams_keep_texts_apart(monkeypatch):
    monkeypatch.setattr(phrases, "POSITIONS", 12)
    texts = [("a", [1, 2, 0, 3]), ("b", [4]), ("a", []), ("a", [5, 6, 7, 8, 9, 10]), ("b", [11] * 30), ("a", [12])]
    batch = pa.RecordBatch.from_arrays([pa.array([x for x, _ in texts]), pa.array([np.array(v, np.uint64).tobytes() for _, v in texts], pa.binary())], ["lang", "ids"])
    got = [(lang, ids.tolist()) for lang, ids in phrases.streams([batch])]
    assert got == [("a", [1, 2, 0, 3, 0, 0, 0, 0, 0, 0, 5, 6, 7, 8, 9, 10, 0, 0, 0]), ("b", [4, 0, 0, 0] + [11] * 30 + [0] * 3), ("a", [12, 0, 0, 0])]


def test_double_array():
    rng = np.random.default_rng(6)
    seen = {}
    for _ in range(4000):
        k = int(rng.integers(2, 5))
        words = tuple(int(x) for x in (1 << 40) + rng.zipf(1.3, k) % 3000)
        seen[rng.choice(["a", "b"]), words] = 0
    langs = [lang for lang, _ in seen]
    rows = np.array([w + (0,) * (4 - len(w)) for _, w in seen], np.uint64)
    trie, states = phrases.build(pa.array(langs), rows)
    assert len(set(states)) == len(seen) and states.min() > 0
    text = ((1 << 40) + rng.zipf(1.3, 50_000) % 3000).astype(np.uint64)
    text[rng.integers(0, 50_000, 5000)] = 0
    text = np.concatenate([text, np.zeros(3, np.uint64)])
    counts = np.bincount(np.concatenate(trie.reached("a", text)), minlength=len(trie.base))
    assert trie.reached("none", text) == []
    plain_counts = Counter(tuple(map(int, text[i:i + k])) for k in (2, 3, 4) for i in range(50_000))
    for (lang, words), state in zip(seen, states):
        assert counts[state] == (plain_counts[words] if lang == "a" else 0)
