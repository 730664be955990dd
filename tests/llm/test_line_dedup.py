"""Line deduplication against a quadratic search for shared passages."""

import random

import pytest

from tarnish.llm import line_dedup

SCHEMA = "doc_id long, text string, n_chars long, blocks string"


def covered(lines, earlier, least):
    """Lines inside a stretch of ``least`` words that some earlier document has too."""
    out = set()
    mine = [(i, x.split()) for i, x in enumerate(lines) if x.split()]
    for other in earlier:
        theirs = [x.split() for x in other if x.split()]
        for i in range(len(mine)):
            for j in range(len(theirs)):
                n = 0
                while i + n < len(mine) and j + n < len(theirs) and mine[i + n][1] == theirs[j + n]:
                    n += 1
                if sum(len(w) for _, w in mine[i:i + n]) >= least:
                    out.update(k for k, _ in mine[i:i + n])
    return out


def made(seed, n=60):
    rng = random.Random(seed)

    def line(words):
        return " ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(words))
    passages = [[line(rng.choice([4, 9, 20, 40])) for _ in range(rng.randrange(1, 5))] for _ in range(8)]
    short = [line(6) for _ in range(3)]
    docs = []
    for i in range(n):
        lines = []
        for _ in range(rng.randrange(1, 7)):
            what = rng.random()
            lines += rng.choice(passages) if what < .35 else [rng.choice(short)] if what < .5 else [line(rng.randrange(1, 50))]
            if rng.random() < .2:
                lines.append("")
        docs.append(lines if rng.random() < .9 or not docs else list(docs[-1]))
    return docs


@pytest.mark.parametrize("seed", range(3))
def test_every_shared_passage_goes(spark, seed):
    docs = made(seed)
    df = spark.createDataFrame([(i, "\n".join(d), 1, "x") for i, d in enumerate(docs)], SCHEMA).repartition(4)
    got = {r.doc_id: r for r in line_dedup.deduplicate(df).collect()}
    for i, lines in enumerate(docs):
        gone = covered(lines, docs[:i], line_dedup.LEAST)
        want = [x.split() for k, x in enumerate(lines) if k not in gone and x.split()]
        assert [x.split() for x in got[i].text.split("\n") if x.split()] == want
        assert bool(gone) == bool(got[i].blocks)
        if not gone:
            assert got[i].text == "\n".join(lines)
        assert all(b.partner < i and b.words >= line_dedup.LEAST for b in got[i].blocks)


def test_no_passage_is_lost(spark):
    docs = made(9)
    df = spark.createDataFrame([(i, "\n".join(d), 1, "x") for i, d in enumerate(docs)], SCHEMA)
    left = {" ".join(x.split()) for r in line_dedup.cleaned(df).collect() for x in r.text.split("\n")}
    assert {" ".join(x.split()) for d in docs for x in d if x.split()} <= left


def test_alignment_in_crossed_order():
    runs = [(bytes([d]), i, i) for i, d in enumerate([5, 1, 2, 9, 1])]
    # 5 and 2 are unique but crossed: one aligns, then the other, then the two occurrences of 1
    assert list(line_dedup.align(runs, {b"\x01": 0, b"\x02": 1, b"\x05": 2})) == [(2, 2), (0, 0), (1, 1), (4, 4)]
    assert line_dedup.longest_increasing([3, 1, 2, 5, 4]) == [1, 2, 4]
    # runs that overlap at the same distance are one block
    assert list(line_dedup.align([(b"a", 0, 1), (b"b", 1, 2)], {b"a": 7, b"b": 8})) == [(0, 2)]


def test_spans():
    assert line_dedup.spans([10, 10, 15], 30) == [(0, 2)]
    assert line_dedup.spans([40, 2, 40], 30) == [(0, 0), (0, 1), (1, 2), (2, 2)]
    assert line_dedup.spans([], 30) == [] == line_dedup.spans([29], 30)


def test_defined_cases(spark):
    long = " ".join(f"x{i}" for i in range(60))
    rows = [(1, long, 5, "k"), (2, f"{long}\n\nkept", 5, "k"), (None, f" {long} ", 5, None), (3, None, None, "k"),
            (3, "", 0, "k"), (2, f"{long}\nother", 1, "k"), (1, long, 5, "k")]
    df = spark.createDataFrame(rows, SCHEMA)
    done = line_dedup.cleaned(df)
    assert done.columns == df.columns
    got = sorted(((r.doc_id, r.text, r.n_chars) for r in done.collect()), key=str)
    assert got == sorted([(1, long, 5), (1, long, 5), (2, "\nkept", 5), (2, "other", 5), (3, None, None), (3, "", 0)], key=str)
    assert line_dedup.deduplicate(df.limit(0)).count() == 0
