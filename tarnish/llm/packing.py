"""Packing token pieces into sequences by minimum bin slack.

Texts become token ids where they are read: words repeat, so a worker keeps the ids of those it
has met and has only new ones merged. Documents longer than a sequence are cut into
pieces.

Which pieces share a sequence depends on their lengths alone. The solver therefore sees the
counts of the lengths, at most ``capacity`` numbers whatever the input. Per bin it takes the
longest length left and finds, by a subset-sum over bitsets, the fullest combination with it
that the lengths left allow; that combination is taken off as often as the counts last. After
each one some length has fewer pieces than it took, so there are at most ``capacity * (1 + ln
capacity)`` different combinations: the plan that goes to the tasks has a fixed bound.

Pieces then need their number among those of their length. A length that very many pieces share
is dealt over random buckets, each numbered on its own and shifted by the buckets before it.

Defined cases: a null text is empty and still has its end token; an empty table has no rows;
repeated rows are packed as often as they occur; other columns go along with every piece.
"""

from __future__ import annotations

import re
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tarnish.llm.texts import fresh, raw_texts
from tarnish.session import materialise

CAPACITY = 4096
#: Words remembered per worker in each generation, and the longest of them.
REMEMBERED, LONGEST = 100_000, 64
#: Pieces of one length that are numbered together.
BUCKET = 1000


#: Characters whose treatment needs no Unicode tables: ASCII but the apostrophe, and Latin-1 letters.
LETTERS, MARKS = "a-zß-öø-ÿ", r"!-&(-/:-@\[-`{-~"
PLAIN = re.compile(rf"[ \t-\r0-9A-ZÀ-ÖØ-Þ{LETTERS}{MARKS}]*")
#: What the tokenizer's own pattern finds in a lower-cased text of such characters.
PART = re.compile(rf"[{LETTERS}]+|[0-9]|[{MARKS}]+")
#: A full stop or comma next to another mark, with which it is one part.
TOGETHER = re.compile(rf"[.,][{MARKS}]|[{MARKS}][.,]")


def byte_letters() -> dict[int, str]:
    """The letter that byte-level tokenizers write for each byte: itself if it shows, else the
    next one after the 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class WordTokens(dict):
    """Token ids of a text, as little-endian 32-bit numbers.

    For lower-casing byte-level BPE tokenizers that drop white space and cut a text into words
    before they merge. A text of plain characters is cut here, by the same pattern, and each word's
    parts merged by the tokenizer's model, once while it is remembered; any other word goes
    through the whole tokenizer. What is remembered has two generations: when the younger is full, the older
    is forgotten, so frequent parts stay.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model, self.letters, self.older = self.tokenizer.model, byte_letters(), {}
        self.odd: dict[str, bytes] = {}
        for text in ("Ab é0x!?\n c12 _ÀÖß", "".join(map(chr, [*range(32, 39), *range(40, 127), *range(192, 215), *range(216, 247), *range(248, 256)]))):
            if self.of(text.encode()) != self.whole(text):
                raise ValueError("this tokenizer doesn't cut texts in the way that is provided for")

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = b"".join(map(self.merged, PART.findall(word)))
        if len(word) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids

    def merged(self, part: str) -> bytes:
        seen = part if part.isascii() else part.encode().decode("latin-1").translate(self.letters)
        found = [t.id for t in self.model.tokenize(seen)]
        return struct.pack(f"<{len(found)}I", *found)

    def plain(self, text: str) -> bytes:
        text = text.lower()
        # a mark alone is a part of its own: apart from its word, both are met more often
        if not TOGETHER.search(text):
            text = text.replace(".", " . ").replace(",", " , ")
        return b"".join(map(self.__getitem__, text.split()))

    def word(self, word: str) -> bytes:
        if "<|" not in word and PLAIN.fullmatch(word):
            return self.plain(word)
        ids = self.odd.get(word)
        if ids is None:
            ids = self.whole(word)
            if len(word) <= LONGEST:
                if len(self.odd) >= REMEMBERED:
                    self.odd.clear()
                self.odd[word] = ids
        return ids

    def of(self, raw: bytes) -> bytes:
        text = raw.decode()
        if "<|" not in text and PLAIN.fullmatch(text):
            return self.plain(text)
        return b"".join(self.word(w.decode()) for w in raw.split())


@lru_cache(maxsize=2)
def tokens_of(path: str) -> WordTokens:
    return WordTokens(path)


def pieces(docs: DataFrame, tokenizer: str, text: str = "text", end: int | None = 1,
           capacity: int = CAPACITY) -> DataFrame:
    """A row per piece: the columns of ``docs`` but the text, then ``piece``, ``start``,
    ``length`` and ``ids`` (little-endian 32-bit numbers). Columns so called are replaced."""
    own = ("piece", "start", "length", "ids")
    columns = [c for c in docs.columns if c != text and c not in own]
    tail = b"" if end is None else np.array([end], "<u4").tobytes()
    kind = pa.list_(pa.struct([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())]))

    def cut(texts: pa.Array) -> pa.Array:
        known, rows = tokens_of(tokenizer), []
        for raw in raw_texts(texts):
            ids = known.of(raw) + tail
            rows.append([{"piece": i, "start": i * capacity, "length": len(part) // 4, "ids": part} for i, part in enumerate(
                ids[a:a + 4 * capacity] for a in range(0, len(ids), 4 * capacity))])
        return pa.array(rows, kind)

    cut_up = F.arrow_udf(cut, "array<struct<piece:int,start:bigint,length:bigint,ids:binary>>")
    p = fresh("_piece", columns)
    return docs.select(*[F.col(f"`{c}`") for c in columns], F.explode(cut_up(F.col(f"`{text}`").cast("string"))).alias(p)
                       ).select(*[F.col(f"`{c}`") for c in columns], f"{p}.*")


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The combination of lengths (each at most its count) whose sum comes nearest to ``room``.

    Longer lengths first, so of equally full combinations one with few and long pieces is found.
    """
    reach, mask, steps = 1, (1 << room + 1) - 1, []
    for length, count in counts.items():
        if length > room:
            continue
        steps.append((length, count, reach))
        left, part = min(count, room // length), 1
        while left:  # 1, 2, 4 ... and a rest make up every number from 0 to the count
            part = min(part, left)
            reach |= reach << part * length & mask
            left, part = left - part, 2 * part
        if reach >> room & 1:
            break
    total, taken = reach.bit_length() - 1, {}
    for length, _, before in reversed(steps):
        times = 0
        while not before >> total & 1:
            total, times = total - length, times + 1
        if times:
            taken[length] = times
    return taken


def minimum_bin_slack(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """``(combination, bins)``: how many bins hold which lengths how often."""
    left = {length: counts[length] for length in sorted(counts, reverse=True) if counts[length]}
    out = []
    while left:
        longest = next(iter(left))
        rest = {**left, longest: left[longest] - 1}
        bin_ = fullest({k: v for k, v in rest.items() if v}, capacity - longest) if longest < capacity else {}
        bin_[longest] = bin_.get(longest, 0) + 1
        bins = min(left[length] // times for length, times in bin_.items())
        for length, times in bin_.items():
            left[length] -= bins * times
            if not left[length]:
                del left[length]
        out.append((bin_, bins))
    return out


def seats(plan: list[tuple[dict[int, int], int]]) -> dict[str, np.ndarray]:
    """Where the pieces of each length sit, by their number among those of the length.

    A row per length and combination, in order of length and first number.
    """
    rows, filled, first = [], {}, 0
    for bin_, bins in plan:
        offset = 0
        for length, times in sorted(bin_.items(), reverse=True):
            rows.append((length, filled.get(length, 0), times, first, offset))
            filled[length] = filled.get(length, 0) + times * bins
            offset += times * length
        first += bins
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "number", "times", "sequence", "offset"), table.T))


def pack(items: DataFrame, length: str = "length", capacity: int = CAPACITY,
         out: tuple[str, str] = ("sequence_id", "offset")) -> DataFrame:
    """``items`` with the sequence and the place in it. Lengths are 1 to ``capacity``."""
    columns = [c for c in items.columns if c not in out]
    r, b, before, n = (fresh(x, columns) for x in ("_r", "_bucket", "_before", "_number"))
    # the random place is written with the row, so that every later read agrees on it
    items = materialise(items.select(*[F.col(f"`{c}`") for c in columns], F.rand(17).alias(r)), "pieces")
    size = F.col(f"`{length}`").cast("bigint")
    found = items.groupBy(size.alias("length")).agg(F.count(F.lit(1)).alias("n"))
    counts = {x.length: x.n for x in found.limit(capacity + 1).collect()}
    if any(x is None or not 0 < x <= capacity for x in counts):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    plan = seats(minimum_bin_slack(counts, capacity))

    # at most ``capacity`` rows: broadcast, so that no row is dealt by its length alone
    sizes = items.sparkSession.createDataFrame(
        [(k, -(-v // BUCKET)) for k, v in counts.items()], "_len bigint, _buckets bigint")
    of = fresh("_size", columns)
    dealt = items.join(F.broadcast(sizes.select(F.struct("_len", "_buckets").alias(of))), size == F.col(f"{of}._len"))
    dealt = dealt.select(*items.columns, F.floor(F.col(r) * F.col(f"{of}._buckets")).alias(b))
    totals = dealt.groupBy(size.alias("_len"), F.col(b).alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("_len").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(F.struct("_len", "_b", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start")).alias(of))
    here = Window.partitionBy(size, F.col(b)).orderBy(r)
    numbered = dealt.withColumn(n, F.row_number().over(here) - 1).join(
        starts, (size == F.col(f"{of}._len")) & (F.col(b) == F.col(f"{of}._b")))
    numbered = numbered.select(*[F.col(f"`{c}`") for c in columns], (F.col(n) + F.col(f"{of}._start")).alias(n))
    bits = np.int64(1 << 48)

    def seat(lengths: pa.Array, numbers: pa.Array) -> pa.Array:
        own, number = lengths.to_numpy(), numbers.to_numpy()
        at = np.searchsorted(plan["length"] * bits + plan["number"], own * bits + number, side="right") - 1
        step = number - plan["number"][at]
        return pa.StructArray.from_arrays([
            pa.array(plan["sequence"][at] + step // plan["times"][at]),
            pa.array(plan["offset"][at] + step % plan["times"][at] * own)], ["sequence", "offset"])

    s = fresh("_seat", columns)
    placed = numbered.withColumn(s, F.arrow_udf(seat, "struct<sequence:bigint,offset:bigint>")(size, F.col(n)))
    return placed.select(*[F.col(f"`{c}`") for c in columns], F.col(f"{s}.sequence").alias(out[0]),
                         F.col(f"{s}.offset").alias(out[1]))
