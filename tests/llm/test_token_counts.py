"""Token counts against the library itself."""

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st

from tarnish.llm import token_counts

MODEL = public_tokenizers.path("piece_bpe_32k.model")
PLAIN = sentencepiece.SentencePieceProcessor(model_file=MODEL)
TEXTS = ["", " ", "   ", "a", " a", "a  b ", "a\nb\n\n c", "▁a▁ ▁", "<s>x</s> <unk> <0x0A>", "\x00a\t\r", "ﬁ   　é",
         "nowhitespaceatall" * 500, "the quick " * 3000, "日本語 テキスト", "🙂🙂 é", "\n", " \n ", "▁"]


@pytest.fixture(scope="module")
def known():
    return token_counts.PreTokenCounts(MODEL)


def test_texts(known):
    assert [known.of(t) for t in TEXTS] == [len(PLAIN.encode(t)) for t in TEXTS]


def test_most_of_the_vocabulary_is_proven(known):
    assert len(known.whole) > 25_000
    assert all(known.merged(w) == 1 for w in list(known.whole)[::500])


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n▁abth.,<>s"))))
def test_any_text(text):
    assert token_counts.counts_of(MODEL).of(text) == len(PLAIN.encode(text))


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(token_counts, "REMEMBERED", 31_000)
    known = token_counts.PreTokenCounts(MODEL)
    texts = [f"zq{i}xw y{i}" for i in range(2000)]
    assert [known.of(t) for t in texts] == [len(PLAIN.encode(t)) for t in texts]


def test_table(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x"), (None, None, "y")], "doc_id long, text string, known string")
    got = token_counts.token_counts(df, MODEL)
    assert got.columns == ["doc_id", "text", "known", "n_tokens"]
    assert sorted(r.n_tokens for r in got.collect()) == [0, 2, 2]
    assert token_counts.token_counts(df.limit(0), MODEL).count() == 0
