"""Deduplication of passages by pairwise alignment of lines.

A passage is a stretch of lines with at least ``least`` words. Every shortest such stretch that
begins at a line, and every one that ends at a line, is hashed: these *runs* cover each passage
wholly, so two documents share a passage exactly if they share a run. Runs are long and hence
rare: a short line that many documents carry is no candidate by itself, and nothing else limits
how many documents may share one. Of the holders of a run only the first keeps it. Each later
document is paired with that first holder (never all holders with each other) and aligned with
it by patience diff: runs that are unique in both are put in their longest common order, aligned
runs grow together into blocks, and what crosses them is aligned in further passes. The blocks
are deleted from the later document.

Only hashes and places are shuffled to find the pairs; a text is moved once, to meet the runs it
has to give up, and each text is handled by itself.

Defined cases: lines are equal if their words are; lines without words count nothing and go with
a block around them; a null text stays null; documents are ordered by id, those without one last;
rows that share an id are not compared with each other; a text of which nothing is left becomes
empty; other columns pass through.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tarnish.llm.texts import fresh, raw_texts
from tarnish.session import materialise

#: Words that make a passage.
LEAST = 30
RUN = "array<struct<digest:binary,place:int>>"
BLOCKS = "struct<text:string,blocks:array<struct<partner:bigint,first_line:int,last_line:int,words:int>>>"


def spans(counts: list[int], least: int) -> list[tuple[int, int]]:
    """First and last line of every shortest stretch of ``least`` words, from either end."""
    found, last, total = set(), 0, 0
    for first, own in enumerate(counts):  # the shortest stretch that begins here
        while last < len(counts) and total < least:
            total, last = total + counts[last], last + 1
        if total < least:
            break
        found.add((first, last - 1))
        total -= own
    first, total = 0, 0
    for last, own in enumerate(counts):  # the shortest that ends here
        total += own
        while total - counts[first] >= least:
            total, first = total - counts[first], first + 1
        if total >= least:
            found.add((first, last))
    return sorted(found)


class Document:
    """A text as its lines; those with words have places from 0."""

    def __init__(self, raw: bytes, least: int):
        self.lines = raw.split(b"\n")
        self.at, plain, self.counts = [], [], []
        for i, line in enumerate(self.lines):
            words = line.split()
            if words:
                self.at.append(i)
                plain.append(b" ".join(words))
                self.counts.append(len(words))
        self.runs = [(xxhash.xxh3_128_digest(plain[a] if a == b else b"\n".join(plain[a:b + 1])), a, b)
                     for a, b in spans(self.counts, least)]

    def first_places(self) -> dict[bytes, int]:
        places: dict[bytes, int] = {}
        for digest, first, _ in self.runs:
            places.setdefault(digest, first)
        return places

    def without(self, places: set[int]) -> bytes:
        """The text less these lines, and less the blank lines inside what is deleted."""
        gone = {self.at[p] for p in places}
        for p in places:
            if p + 1 in places:
                gone.update(range(self.at[p], self.at[p + 1]))
        return b"\n".join(line for i, line in enumerate(self.lines) if i not in gone)


def longest_increasing(values: list[int]) -> list[int]:
    """Positions of a longest strictly increasing subsequence, by patience sorting."""
    tops: list[int] = []
    at: list[int] = []
    below = [-1] * len(values)
    for i, value in enumerate(values):
        pile = bisect_left(tops, value)
        below[i] = at[pile - 1] if pile else -1
        tops[pile:pile + 1] = [value]
        at[pile:pile + 1] = [i]
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = below[i]
    return out[::-1]


def align(runs: list[tuple[bytes, int, int]], places: dict[bytes, int]) -> Iterator[tuple[int, int]]:
    """Blocks of this document, first and last place, that align with a partner whose runs lie at
    ``places``. Runs that are unique here anchor first; what is left is aligned again."""
    left = [(digest, a, b) for digest, a, b in runs if digest in places]
    while left:
        times = Counter(digest for digest, _, _ in left)
        unique = [r for r in left if times[r[0]] == 1]
        if not unique:  # of repeats, the first occurrence
            seen: set[bytes] = set()
            unique = [r for r in left if not (r[0] in seen or seen.add(r[0]))]
        # runs that begin at one place are one anchor for the order, the longest of them
        aligned = [unique[i] for i in longest_increasing([places[d] * 2 for d, _, _ in unique])]
        block = None
        for digest, a, b in aligned:
            shift = places[digest] - a
            if block and shift == block[2] and a <= block[1] + 1:
                block = (block[0], max(b, block[1]), shift)
            else:
                if block:
                    yield block[:2]
                block = (a, b, shift)
        if block:
            yield block[:2]
        done = set(map(id, aligned))
        left = [r for r in left if id(r) not in done]


def deduplicated(raw: bytes, anchors: list[tuple[bytes, int, int]], least: int) -> tuple[bytes, list[dict]]:
    """The text less its aligned blocks, and the blocks. ``anchors``: digest, partner, its place."""
    doc, partners = Document(raw, least), {}
    for digest, partner, place in anchors:
        partners.setdefault(partner, {})[digest] = place
    gone: set[int] = set()
    blocks = []
    for partner in sorted(partners):
        for a, b in align(doc.runs, partners[partner]):
            if not gone.issuperset(range(a, b + 1)):
                gone.update(range(a, b + 1))
                blocks.append({"partner": partner, "first_line": doc.at[a], "last_line": doc.at[b],
                               "words": sum(doc.counts[a:b + 1])})
    return doc.without(gone), blocks


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST,
                out: str = "blocks") -> DataFrame:
    """``docs`` with texts less their repeated passages, and the deleted ``out`` blocks: the
    partner's id and this text's first and last line and words (empty where nothing was deleted)."""
    columns = [c for c in docs.columns if c != out]
    ident = F.coalesce(F.col(f"`{doc_id}`").cast("bigint"), F.lit((1 << 63) - 1))
    body = F.col(f"`{text}`").cast("string")

    def runs(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("digest", pa.binary()), ("place", pa.int32())]))
        return pa.array([[{"digest": d, "place": p} for d, p in Document(raw, least).first_places().items()]
                         for raw in raw_texts(texts)], kind)

    found = materialise(docs.select(ident.alias("id"), F.xxhash64(body).alias("version"), F.explode(
        F.arrow_udf(runs, RUN)(body)).alias("run")).select("id", "version", "run.*"), "runs")
    shared = found.groupBy("digest").agg(
        F.min(F.struct("id", "place")).alias("first"), F.max("id").alias("last")).where("first.id < last")
    shared = materialise(shared.select("digest", F.col("first.id").alias("partner"), F.col("first.place").alias("there")), "shared")
    anchors = found.join(shared, "digest").where("id > partner").groupBy("id", "version").agg(
        F.collect_set(F.struct("digest", "partner", "there")).alias("anchors"))

    def delete(texts: pa.Array, anchors_: pa.Array) -> pa.Array:
        rows = []
        for raw, own in zip(raw_texts(texts), anchors_):
            given = [(x["digest"], x["partner"], x["there"]) for x in own.as_py() or []]
            left, blocks = deduplicated(raw, given, least)
            rows.append({"text": left.decode(), "blocks": blocks})
        return pa.array(rows, pa.struct([("text", pa.string()), ("blocks", pa.list_(pa.struct([
            ("partner", pa.int64()), ("first_line", pa.int32()), ("last_line", pa.int32()), ("words", pa.int32())])))]))

    a, d = fresh("_anchors", columns), fresh("_deduplicated", columns)
    joined = docs.join(anchors.select(F.struct("id", "version", "anchors").alias(a)), (ident == F.col(f"{a}.id")) & (
        F.xxhash64(body) == F.col(f"{a}.version")), "left")
    # texts without a run in common with an earlier one don't go to Python
    # called nondeterministic, so that a filter on its result doesn't have it done twice
    remove = F.arrow_udf(delete, BLOCKS).asNondeterministic()
    joined = joined.withColumn(d, F.when(F.col(f"{a}.anchors").isNotNull(), remove(
        F.when(F.col(f"{a}.anchors").isNotNull(), body), F.col(f"{a}.anchors"))))
    none = F.array().cast("array<struct<partner:bigint,first_line:int,last_line:int,words:int>>")
    return joined.select(*[(F.when(F.col(d).isNotNull(), F.col(f"{d}.text")).otherwise(F.col(f"`{c}`")).alias(c) if c == text
                            else F.col(f"`{c}`")) for c in columns], F.coalesce(F.col(f"{d}.blocks"), none).alias(out))


def cleaned(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_chars: str = "n_chars", **options) -> DataFrame:
    """The columns of ``docs`` after deduplication; documents of which nothing is left are gone."""
    out = fresh("blocks", docs.columns)
    done = deduplicate(docs, doc_id, text, out=out, **options)
    changed, body = F.size(out) > 0, F.col(f"`{text}`")
    if n_chars in docs.columns:
        kind = dict(docs.dtypes)[n_chars]
        done = done.withColumn(n_chars, F.when(changed, F.length(body)).otherwise(F.col(f"`{n_chars}`")).cast(kind))
    return done.where(~changed | body.rlike(r"[^\x20\x09-\x0D]")).select(*[F.col(f"`{c}`") for c in docs.columns])
