"""Packing: ids against the tokenizer, bins against an exact search, seats by their definition."""

import random
import zlib
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from tarnish.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
PLAIN = Tokenizer.from_file(PATH)
TEXTS = ["", None, "a", "Two Words", "é ﬁ 12 345's don't", "<|endoftext|> x<|startoftext|>y <|ENDOFTEXT|>",
         "é e ́  　x\x0by\x1cz", "日本語 テキスト", "Σας ΣΑΣ", "🙂🙂" * 50, "x" * 3000, "word " * 9000,
         "Ünï'cödé ÀÖØÞß÷×µªº ŠžŸÿ İ", "".join(map(chr, range(1, 600))), "a\x7fb\x85c\xa0d\xadE", "__x--y''z''S'S 's'T"]


def ids(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids


def test_ids():
    known = packing.WordTokens(PATH)
    for text in TEXTS:
        assert np.frombuffer(known.of((text or "").encode()), "<u4").tolist() == ids(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n\t'stab1<|>́"))))
def test_ids_of_any_text(text):
    assert np.frombuffer(packing.tokens_of(PATH).of(text.encode()), "<u4").tolist() == ids(text)


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 10)
    known = packing.WordTokens(PATH)
    for text in [f"ab{i} Cd{i % 7} é{i % 5}ï œ{i}" for i in range(100)]:
        assert np.frombuffer(known.of(text.encode()), "<u4").tolist() == ids(text)


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet=st.characters(max_codepoint=0x17F)))
def test_ids_of_latin_text(text):
    assert np.frombuffer(packing.tokens_of(PATH).of(text.encode()), "<u4").tolist() == ids(text)


@pytest.mark.parametrize("seed", range(20))
def test_fullest_is_the_fullest(seed):
    rng = random.Random(seed)
    items = sorted((rng.randrange(1, 30) for _ in range(10)), reverse=True)
    room = rng.randrange(1, 90)
    best = max(sum(c) for n in range(11) for c in combinations(items, n) if sum(c) <= room)
    counts = {x: items.count(x) for x in items}
    taken = packing.fullest(counts, room)
    assert sum(k * v for k, v in taken.items()) == best
    assert all(v <= counts[k] for k, v in taken.items())


def test_plan_uses_every_piece():
    rng = np.random.default_rng(1)
    lengths = np.minimum(rng.lognormal(6, 1.2, 200_000).astype(int) + 1, 4096)
    counts = {int(k): int(v) for k, v in zip(*np.unique(lengths, return_counts=True))}
    plan = packing.minimum_bin_slack(counts, 4096)
    used = {}
    for bin_, bins in plan:
        assert sum(k * v for k, v in bin_.items()) <= 4096
        for k, v in bin_.items():
            used[k] = used.get(k, 0) + v * bins
    assert used == counts
    total = sum(bins for _, bins in plan)
    assert total <= -(-int(lengths.sum()) // 4096) * 1.001 + 1
    assert len(plan) <= 4096 * (1 + np.log(4096))


def test_table(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET", 7)
    rows = [(i, TEXTS[i % len(TEXTS)], "x") for i in range(60)] + [(None, "a", "y"), (1, None, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, offset string")
    made = packing.pieces(docs, PATH)
    assert made.columns == ["doc_id", "offset", "piece", "start", "length", "ids"]
    got = [r.asDict() for r in packing.pack(made).collect()]
    texts = {r[0]: r[1] for r in rows if r[0] not in (None, 1)}
    by_doc = {}
    for r in sorted(got, key=lambda r: r["start"]):
        if r["doc_id"] in texts:
            assert r["start"] == 4096 * r["piece"] and 4 * r["length"] == len(r["ids"])
            by_doc[r["doc_id"]] = by_doc.get(r["doc_id"], b"") + r["ids"]
    assert {k: np.frombuffer(v, "<u4").tolist() for k, v in by_doc.items()} == {k: [*ids(t), 1] for k, t in texts.items()}
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in sequences.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 4096
    assert len(sequences) == -(-sum(r["length"] for r in got) // 4096)
    assert packing.pack(packing.pieces(docs.limit(0), PATH)).count() == 0


def test_lengths_out_of_range(spark):
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(0,)], "length long"))


def test_digest_of_ids(spark):
    row = packing.pieces(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), PATH).selectExpr("crc32(ids) c", "ids").first()
    assert row.c == zlib.crc32(row.ids) == zlib.crc32(np.array([*ids("a b"), 1], "<u4").tobytes())
