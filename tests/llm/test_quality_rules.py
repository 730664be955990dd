"""Quality rules: measures and shrunk rates against plain versions, the query against SQL."""

import random
import re

import duckdb
import numpy as np
import pytest

from tarnish.llm import quality_rules as Q
from tarnish.llm.texts import WordIds

SCHEMA = "doc_id long, text string, source string, quality string, n_words string, _host string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    count = {}
    for w in windows:
        count[w] = count.get(w, 0) + 1
    inside = {i + s for i, w in enumerate(windows) if count[w] > 1 for s in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(inside))


TEXTS = ["", None, " \n\t ", "one", "a a a a", "a b c x a b c", "é ü\n é ü\nq\né ü\nq", "#*$ %&|<> \x1c \x85 x", "a\n\n\na\n a", "w " * 5000,
         "x" * 20000, "to be or not to be or not to be", "\U0001f642 \U0001f642 \U0001f642 \U0001f642"]


def test_measures():
    known = WordIds()
    for text in TEXTS:
        assert Q.measure_text((text or "").encode(), known) == plain(text)
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice("ab \n") for _ in range(rng.randrange(60)))
        assert Q.measure_text(text.encode(), known) == plain(text)


def test_millions_of_different_words():
    ids = np.array([5, 1 << 22, 7, 9, 5, 1 << 22, 7])
    assert Q.repeated_words(ids) == 6


def prior(k, n):
    """Beta-binomial moments, with the unbiased share of the spread between hosts."""
    mean, total = sum(k) / sum(n), sum(n)
    spread = sum(b * (a / b - mean) ** 2 for a, b in zip(k, n))
    room = total - sum(b * b for b in n) / total - (len(n) - 1)
    share = (spread - mean * (1 - mean) * (len(n) - 1)) / (mean * (1 - mean) * room) if 0 < mean < 1 and room > 0 else 0
    return mean, min(Q.STRONGEST, max(Q.WEAKEST, 1 / share - 1)) if share > 0 else Q.STRONGEST


def test_hosts(spark):
    rng = random.Random(5)
    good = " ".join(f"w{i}" for i in range(60))
    rows = []
    for h in range(40):
        bad = h / 40 if h < 30 else 0.97
        for _ in range(rng.choice([1, 3, 40])):
            rows.append((len(rows), "short" if rng.random() < bad else good, None if h == 39 else f"h{h}", "q", "n", "_"))
    rows += [(None, None, "h0", None, None, None)] * 3
    df = spark.createDataFrame(rows, SCHEMA)
    got = Q.judge(df)
    assert got.columns == [*(c for c in df.columns if c != "quality"), "quality"]  # the column so called is replaced
    got = got.collect()
    assert len(got) == len(rows)
    k, n = {}, {}
    for r in rows:
        n[r[2]] = n.get(r[2], 0) + 1
        k[r[2]] = k.get(r[2], 0) + (r[1] != good)
    mean, strength = prior([k[h] for h in n], list(n.values()))
    assert Q.WEAKEST < strength < Q.STRONGEST
    for r in got:
        rate = (k[r.source] + mean * strength) / (n[r.source] + strength)
        assert r.quality.host_docs == n[r.source] and abs(r.quality.few_words_rate - rate) < 1e-9
        ok = rate - 3 * (rate * (1 - rate) / (n[r.source] + strength + 1)) ** 0.5 <= min(0.5, max(0.3, 3 * mean))
        assert r.quality.host_ok == ok
        assert r.quality.base_failed == (r.text != good) and r.quality.kept == (ok and r.text == good)
    assert {r.quality.host_ok for r in got} == {True, False}
    # one bad document on a small host is drawn to the others, a host of bad documents is not
    kept = Q.keep(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in got if r.quality.kept)


def planted():
    """Twenty ordinary hosts; a large and a small bad one, and one too small to tell. Symbols fail no base rule."""
    rng, good = random.Random(9), " ".join(f"w{i}" for i in range(60))
    noisy = good + " ## $$ %% && ** ||"
    hosts = [(f"h{i}", 100, 0.05) for i in range(20)] + [("large", 900, 0.65), ("small", 12, 1.0), ("tiny", 2, 1.0), (None, 50, 0.9)]
    rows = [(noisy if rng.random() < share else good, host) for host, n, share in hosts for _ in range(n)]
    return [(i, text, host, "q", "n", "_") for i, (text, host) in enumerate(rows)]


def test_planted_hosts(spark):
    df = spark.createDataFrame(planted(), SCHEMA).repartition(4)
    verdicts = {r.source: r.ok for r in Q.judge(df).select("source", "quality.host_ok").distinct().withColumnRenamed("host_ok", "ok").collect()}
    assert {h for h, ok in verdicts.items() if not ok} == {"large", "small", None} and len(verdicts) == 24
    # whole hosts go, with their good documents; nothing else does
    kept = Q.keep(df).collect()
    assert sorted(r.doc_id for r in kept) == [r[0] for r in planted() if r[2] not in ("large", "small", None)]


def test_planted_hosts_in_sql_and_pipeline(spark, tmp_path):
    import corpus_pipeline
    from tarnish.llm.queries import ORACLES, QUERIES
    docs = spark.createDataFrame(planted(), SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    cur = con.execute(ORACLES["op1_host_quality_rules"])
    names = [d[0] for d in cur.description]
    got = QUERIES["op1_host_quality_rules"](spark, str(tmp_path)).collect()
    assert sorted(tuple(r[c] for c in names) for r in got) == sorted(cur.fetchall())
    assert sum(not r.kept and not r.base_failed for r in got) == 962
    assert corpus_pipeline.quality(spark, docs, str(tmp_path)).count() == len(got) - 962


def test_no_rows_and_one_host(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert Q.judge(df).count() == 0 and Q.keep(df).count() == 0
    one = spark.createDataFrame([(1, "few words", "a", "q", "n", "_")], SCHEMA)
    assert [r.quality.kept for r in Q.judge(one).collect()] == [False]


@pytest.mark.parametrize("k, n", [([0, 0], [5, 6]), ([5, 6], [5, 6]), ([1], [3]), ([], [])])
def test_prior_without_spread(k, n):
    kk = sum(a * a / b for a, b in zip(k, n))
    mean, strength = Q.beta_prior(len(n), sum(n), sum(b * b for b in n), sum(k), kk)
    assert strength == Q.STRONGEST and 0 <= mean <= 1


def test_query_equals_sql(spark):
    from tarnish.llm.queries import ORACLES, QUERIES
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    cur = con.execute(ORACLES["op1_host_quality_rules"])
    names = [d[0] for d in cur.description]
    want = sorted(tuple(dict(zip(names, r)).values()) for r in cur.fetchall())
    df = QUERIES["op1_host_quality_rules"](spark, folder)
    assert sorted(tuple(r[c] for c in names) for r in df.collect()) == want and set(df.columns) == set(names)
