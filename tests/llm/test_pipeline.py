"""The pipeline, stage by stage against plain versions, and as a whole."""

import re

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tarnish.llm import line_dedup
from tests.llm.test_line_dedup import covered
from tests.llm.test_simhash import plain_components, plain_fingerprint

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base_ok(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    twice = {w for w in set(windows) if windows.count(w) > 1}
    inside = {i + s for i, w in enumerate(windows) if w in twice for s in range(3)}
    return len(words) >= 50 and 100 * len(inside) <= 50 * len(words)


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        from tarnish.session import materialise
        out.append(materialise(stage(spark, out[-1], SF), "test"))
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns(stages):
    assert [s.columns for s in stages[:5]] == [stages[0].columns] * 5
    assert [len(s.dtypes) for s in stages[:5]] == [len(stages[0].dtypes)] * 5
    assert all(s.dtypes == stages[0].dtypes for s in stages[:5])


def test_quality(stages):
    given, kept = rows(stages[0]), rows(stages[1])
    assert set(kept) == {d for d, r in given.items() if base_ok(r.text)}
    assert all(kept[d] == given[d] for d in kept)


def test_lines(stages):
    given, got = rows(stages[1]), rows(stages[2])
    texts = [(d, given[d].text.split("\n")) for d in sorted(given)]
    for i, (d, lines) in enumerate(texts):
        gone = covered(lines, [t for _, t in texts[:i]], line_dedup.LEAST)
        left = [x.split() for k, x in enumerate(lines) if k not in gone and x.split()]
        assert (d in got) == bool(left)
        if left:
            assert [x.split() for x in got[d].text.split("\n") if x.split()] == left
            assert got[d].n_chars == len(got[d].text)


def test_near_duplicates(stages):
    given, got = rows(stages[2]), rows(stages[3])
    ids = sorted(given)
    assert set(got) == set(plain_components(ids, [plain_fingerprint(given[d].text) for d in ids]))
    assert all(got[d] == given[d] for d in got)


def test_mix(stages):
    given, got = rows(stages[3]), stages[4].collect()
    sizes = {}
    for r in given.values():
        sizes[r.source] = sizes.get(r.source, 0) + len(WORD.findall(r.text))
    taken, times = {}, {}
    for r in got:
        assert r == given[r.doc_id]
        taken[r.source] = taken.get(r.source, 0) + len(WORD.findall(r.text))
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert max(times.values()) <= 3
    assert abs(sum(taken.values()) - sum(sizes.values())) < 0.02 * sum(sizes.values())


def test_packing(stages):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = 0
    for r in stages[4].collect():
        want += len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1
    bins = stages[5].groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).collect()
    assert sum(b.n for b in bins) == want and all(b.n == b.end <= 4096 for b in bins)
    assert len(bins) == -(-want // 4096)


def test_run_is_the_stages_one_after_another(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == stages[5].columns
    digest = [F.sum("length"), F.count(F.lit(1)), F.sum("ids_crc32"), F.countDistinct("sequence_id")]
    assert got.agg(*digest).first() == stages[5].agg(*digest).first()


def test_stages_on_odd_tables(spark, tmp_path):
    long = " ".join(f"word{i}" for i in range(80))
    odd = [(1, long, None, None, None, "a"), (1, long, None, None, None, "a"), (None, long + " x", "en", "s", 3, None), (2, None, None, "s", None, "b"),
           (3, "", "en", None, 0, "b"), (4, " \n\t", "en", "s", 3, "b"), (5, "w " * 100_000, "en", "s", 200_000, "b"), (None, None, None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, component_id string"
    for data in (odd, []):
        docs = spark.createDataFrame(data, schema)
        for name, stage in corpus_pipeline.STAGES:
            got = stage(spark, docs, str(tmp_path))
            got.collect()
            if name != corpus_pipeline.STAGES[-1][0]:
                assert got.columns == docs.columns
