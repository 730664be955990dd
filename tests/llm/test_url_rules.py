"""URL rules: parsing and precedence by hand, mining against all combinations of tokens."""

import random
import time
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tarnish.llm import url_rules
from tarnish.llm.queries import URL_RULES

SCHEMA = "page_id long, url string, decision string"


def test_parts(spark):
    urls = {"http://A.Example.ORG:80/Es/x?y#z": ("a.example.org:80", "/Es/x"), "x://É.com?q": ("É.com", ""), "nothing": ("", ""),
            None: ("", ""), "a://b://c/d": ("b:", "//c/d"), "://": ("", ""), "q\nr://h/p\ns#t": ("h", "/p\ns"), "http://h": ("h", "")}
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    got = {r.url: (r.h, r.p) for r in df.select("url", url_rules.host_of(F.col("url")).alias("h"), url_rules.path_of(F.col("url")).alias("p")).collect()}
    assert got == urls


def test_longest_rule_wins(spark):
    urls = {"http://x.org/": ("org/", "allow"), "http://a.example.org/es/1": ("example.org/es/", "block"),
            "http://example.org/en/17": ("example.org/en/1", "block"), "http://example.org/en/2": ("org/", "allow"),
            "http://notexample.org/es/": ("org/", "allow"), "http://e.com/fr/": ("com/fr/", "allow"),
            "http://com/de/x": ("com/de/", "block"), "http://org": (None, None), "http://e.com/FR/": (None, None)}
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    host, path = url_rules.host_of(F.col("url")), url_rules.path_of(F.col("url"))
    got = {r.url: (r.r and r.r.rule, r.r and r.r.verdict) for r in df.select("url", url_rules.listed(URL_RULES, host, path).alias("r")).collect()}
    assert got == urls


def plain_rules(examples, support, confidence):
    n, found = len(examples), {}
    for verdict in ("allow", "block"):
        for items, own in examples:
            if own == verdict:
                for size in range(1, len(items) + 1):
                    for c in combinations(sorted(items), size):
                        found[c, verdict] = found.get((c, verdict), 0) + 1
    least = max(support, url_rules.EXAMPLES / n)
    rules = {}
    for (c, verdict), count in found.items():
        total = sum(set(c) <= set(items) for items, _ in examples)
        if count >= least * n and count / total >= confidence:
            rules[c, verdict] = (count / total, count / n)
    return {k: v for k, v in rules.items() if not any(
        set(o) < set(k[0]) and verdict == k[1] and rules[o, verdict][0] >= v[0] for o, verdict in rules)}


@pytest.mark.parametrize("seed", range(2))
def test_mined_rules_and_verdicts(spark, seed):
    rng = random.Random(seed)
    pages = [(i, f"http://{rng.choice(['www', 'm', 'blog'])}.{rng.choice('abcde')}.{rng.choice(['com', 'org', 'net'])}/"
              f"{rng.choice(['en', 'fr', 'de', 'es'])}/{rng.randrange(99)}", "x") for i in range(400)]
    pages += [(900, None, "y"), (901, "no url", "y"), (902, pages[0][1], "y"), (902, pages[0][1], "y")]
    listed_rules = [url_rules.UrlRule("allow", "org/"), url_rules.UrlRule("block", "com/de/"), url_rules.UrlRule("allow", "com/fr/")]
    df = spark.createDataFrame(pages, SCHEMA)
    got = url_rules.decide(df, listed_rules, support=0.02, confidence=0.8)
    assert got.columns == ["page_id", "url", "decision"]
    got = [r.asDict(True) for r in got.collect()]
    assert sorted(r["page_id"] for r in got) == sorted(p[0] for p in pages)

    def items(d):
        parts = [p for p in d["path"].split("/") if p]
        return {*(f"host:{x}" for x in d["host"].split(".") if d["host"]), *("path:" + ("0" if p.isdigit() else p) for p in parts)}
    examples = [(items(r["decision"]), r["decision"]["verdict"]) for r in got if r["decision"]["rule"]]
    rules = plain_rules(examples, 0.02, 0.8)
    assert rules
    for r in got:
        d = r["decision"]
        if not d["rule"]:
            fits = sorted((-v[0], -v[1], list(k[0]), k[1]) for k, v in rules.items() if set(k[0]) <= items(d))
            assert d["verdict"] == (fits[0][3] if fits else "allow")
            assert d["mined"] == (fits[0][2] if fits else None)


def deep_pages(rng, segments, n):
    """URLs that share a deep path, on hosts that decide and on one that doesn't, and a word that tells."""
    path = "/".join(f"s{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(segments))
    pages = []
    for i in range(n):
        host = rng.choice(["x.bad", "x.good", "y.net"])
        word = rng.choice(["spam", "ad", "page"] if host == "x.bad" else ["fine", "page", "ad", "ad"])
        place = rng.choice(["top", "low"]) if word != "page" or rng.random() < .15 else "top" if host == "x.bad" else "low"  # page and top together tell
        pages.append((i, f"http://{host}/{path}/{place}/{word}" if rng.random() < .8 else f"http://{host}/{word}/{place}", "x"))
    # parts of the path only
    return pages + [(n, "http://y.net/saa", "x"), (n + 1, "http://y.net/sab/spam", "x"), (n + 2, "http://y.net/other", "x")]


@pytest.mark.parametrize("segments, merged", [(5, False), (60, True)])
def test_deep_common_paths(spark, segments, merged):
    """Against all combinations of tokens; with 60 segments, of one token for each set of examples."""
    rng = random.Random(segments)
    df = spark.createDataFrame(deep_pages(rng, segments, 120), SCHEMA)
    rules = [url_rules.UrlRule("block", "bad/"), url_rules.UrlRule("allow", "good/")]
    started = time.monotonic()
    got = [r.asDict(True) for r in url_rules.decide(df, rules, support=0.05, confidence=0.7).collect()]
    assert time.monotonic() - started < 60

    def items(d):
        return {*(f"host:{x}" for x in d["host"].split(".") if d["host"]), *(f"path:{p}" for p in d["path"].split("/") if p)}
    examples = [(items(r["decision"]), r["decision"]["verdict"]) for r in got if r["decision"]["rule"]]
    named = {}  # one token for each set of examples
    for token in sorted(set().union(*[i for i, _ in examples])):
        named[token] = min(t for t in set().union(*[i for i, _ in examples]) if not merged and t == token or merged and all(
            (t in i) == (token in i) for i, _ in examples))
    found = plain_rules([({named[t] for t in i}, v) for i, v in examples], 0.05, 0.7)
    assert found and max(len(k[0]) for k in found) > 1
    for r in got:
        d = r["decision"]
        if not d["rule"]:
            own = {}
            for t in sorted(items(d)):
                if t in named:
                    own.setdefault(named[t], t)
            fits = sorted((-v[0], -v[1], sorted(own[c] for c in k[0]), k[1]) for k, v in found.items() if set(k[0]) <= set(own))
            assert d["verdict"] == (fits[0][3] if fits else "allow")
            assert d["mined"] == (fits[0][2] if fits else None)


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "http://a.net/x", "q"), (2, None, "q")], SCHEMA)
    assert {r.decision.verdict for r in url_rules.decide(df, URL_RULES).collect()} == {"allow"}
    assert url_rules.decide(df.limit(0), URL_RULES).count() == 0


def test_tokens_from_the_whole_url(spark):
    rows = [(i, f"http://{h}/{i}/a/b/c/{word}", "x") for i, (h, word) in enumerate([("x.bad", "spam"), ("x.good", "fine")] * 10)]
    rows += [(i + 100, f"http://{h}/{i}?{key}=1#f", "x") for i, (h, key) in enumerate([("x.bad", "track"), ("x.good", "page")] * 10)]
    rows += [(200, "http://y.net/7/d/e/f/spam", "x"), (201, "http://y.net/7/d/e/f/fine", "x"),
             (202, "http://y.net/7?q=a&track=9", "x"), (203, "http://y.net/7?q=a/track", "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    rules = [url_rules.UrlRule("block", "bad/"), url_rules.UrlRule("allow", "good/")]
    got = {r.page_id: r.decision.mined for r in url_rules.decide(df, rules).collect() if r.page_id >= 200}
    assert got == {200: ["path:spam"], 201: ["path:fine"], 202: ["query:track"], 203: None}
