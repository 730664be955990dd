"""Exact token counts of a SentencePiece BPE model, most of them by looking words up.

The whole-token shortcut rests on two proofs about the vocabulary, made once per process before
any text is read:

* no piece goes on after a word's end (a space mark follows only space marks, and no piece holds
  a line feed), so no merge ever crosses the cuts that :data:`PRE_TOKEN` makes, and the count of
  a text is the sum of the counts of its pre-tokens;
* which strings of the vocabulary the model itself encodes, standing alone, as that one token.

A pre-token among these counts one. Only the rest goes through the model's merges, each string
once per worker while it is remembered, in tables of bounded size.

Defined cases: a null text is empty and has no tokens; repeated rows and extra columns pass
through; an empty table stays empty. Special strings inside a text are ordinary text, as the
library has it by default.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

SPACE = "▁"
#: A line feed; a word with the space marks before it; space marks alone.
PRE_TOKEN = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")
#: Strings remembered per worker in each generation, and the longest of them.
REMEMBERED, LONGEST = 100_000, 64


class PreTokenCounts(dict):
    """Tokens of each pre-token; begins with the proven whole tokens.

    When the younger of two generations is full, the older is forgotten: frequent strings stay.
    """

    def __init__(self, model: str):
        import sentencepiece
        super().__init__()
        self.model = sentencepiece.SentencePieceProcessor(model_file=model)
        self.feed = len(self.model.encode("\n", num_threads=1))
        self.older: dict[str, int] = {}
        self.prove()

    def prove(self) -> None:
        pieces = {}
        for i in range(self.model.get_piece_size()):
            if not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i)):
                pieces[self.model.id_to_piece(i)] = i
        for piece in pieces:
            if re.search(f"[^{SPACE}]{SPACE}|\n", piece):
                raise ValueError(f"the piece {piece!r} crosses a word's end: this model can't be counted by words")
        if self.model.encode(" a b", out_type=str) != [SPACE, f"{SPACE}a", f"{SPACE}b"]:
            raise ValueError("the model adds or removes white space in a way that is not provided for")
        self.whole = {piece for piece in pieces if self.merged(piece) == 1}
        self.update(dict.fromkeys(self.whole, 1))

    def merged(self, chunk: str) -> int:
        """Through the model. It puts a space mark before its input, which is taken off here, or
        a line feed shields the chunk from it."""
        if chunk.startswith(SPACE):
            return len(self.model.encode(chunk[1:], num_threads=1)) if chunk != SPACE else 1
        return len(self.model.encode("\n" + chunk, num_threads=1)) - self.feed

    def __missing__(self, chunk: str) -> int:
        count = self.older.get(chunk) or self.merged(chunk)
        if len(chunk) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
                self.update(dict.fromkeys(self.whole, 1))
            self[chunk] = count
        return count

    def of(self, text: str) -> int:
        if not text:
            return 0
        return sum(map(self.__getitem__, PRE_TOKEN.findall(SPACE + text.replace(" ", SPACE))))


@lru_cache(maxsize=4)
def counts_of(model: str) -> PreTokenCounts:
    return PreTokenCounts(model)


def token_counts(docs: DataFrame, model: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """``docs`` with the tokens of each whole text; ``model`` is a path that executors can read.

    One pass without a shuffle: every row is counted where it is read.
    """
    def count(texts: pa.Array) -> pa.Array:
        pa.default_memory_pool().release_unused()
        known = counts_of(model)
        return pa.array(np.fromiter((known.of(t.as_py() or "") for t in texts), np.int64, len(texts)))

    return docs.withColumn(out, F.arrow_udf(count, "bigint")(F.col(f"`{text}`").cast("string")))
