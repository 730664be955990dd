"""MinHash fingerprints, and near-duplicates by signature bands with the Jaccard verified.

A text's shingles are its windows of five lower-cased words (all its words if fewer). Each is
hashed to 64 bits, and every permutation ``x -> a * x + b`` of the 64-bit numbers (``a`` odd,
drawn once from a fixed seed) keeps its least value, in numpy over all shingles of a text at
once. A fingerprint holds one byte of each minimum; the likeness of two is the share of equal
bytes, set right for those that agree by chance.

Defined cases: a null text is empty; the fingerprint of a text without words is all zeros, and
such texts are alike; repeated rows stay; rows without an id come last; an empty table stays
empty; columns of the input other than the two named ones pass through :func:`near_duplicates`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from tarnish.llm.components import components
from tarnish.llm.texts import fresh, raw_texts
from tarnish.session import materialise

WIDTH, PERMUTATIONS = 5, 128
#: 32 bands of 4: a pair of likeness 0.8 shares no band with probability 4e-8.
BAND = 4
#: Shingles that go through all permutations at a time, and words remembered by a worker.
CHUNK, REMEMBERED = 2048, 1 << 18

_rng = np.random.default_rng(20240229)
FACTORS = _rng.integers(0, 1 << 64, PERMUTATIONS, np.uint64) | np.uint64(1)
OFFSETS = _rng.integers(0, 1 << 64, PERMUTATIONS, np.uint64)
#: One odd factor for each place in a shingle.
PLACES = _rng.integers(0, 1 << 64, WIDTH, np.uint64) | np.uint64(1)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit over the whole number (shift, multiply, shift)."""
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)


def shingles(raw: bytes, known: WordHashes) -> np.ndarray:
    """A 64-bit hash of every shingle, repeats included."""
    words = raw.lower().split()
    hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    width = min(WIDTH, len(words))
    if not width:
        return hashes
    n = len(words) - width + 1
    total = np.full(n, width, np.uint64)
    for place in range(width):
        total += mix(hashes[place:place + n] + np.uint64(place)) * PLACES[place]
    return mix(total)


def signature(hashes: np.ndarray) -> np.ndarray:
    """The least value under each permutation; zeros if there is no shingle."""
    if not len(hashes):
        return np.zeros(PERMUTATIONS, np.uint64)
    least = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(hashes), CHUNK):
        values = np.multiply.outer(FACTORS, hashes[start:start + CHUNK])
        values += OFFSETS[:, None]
        np.minimum(least, values.min(axis=1), out=least)
    return least


def short(signature_: np.ndarray) -> np.ndarray:
    """One byte of each minimum."""
    return (signature_ >> np.uint64(56) ^ signature_ >> np.uint64(20)).astype(np.uint8)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    same = float(np.mean(a == b))
    return max(0.0, (same - 1 / 256) / (1 - 1 / 256))


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by as many of the start of the next text."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


ROW = ("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint binary, edited_fingerprint binary, "
       "near_edited double, near_next double")


def compared(rows: Iterator[tuple], known: WordHashes) -> Iterator[dict]:
    """From ``(doc_id, text, fingerprint, next text, its fingerprint)`` to :data:`ROW`."""
    for doc_id, text, fp, following, next_fp in rows:
        other = edited(text, following).encode()
        other_fp = short(signature(shingles(other, known)))
        yield {"doc_id": doc_id, "n_chars": len(text), "edited_sha256": hashlib.sha256(other).hexdigest(),
               "fingerprint": fp.tobytes(), "edited_fingerprint": other_fp.tobytes(),
               "near_edited": likeness(fp, other_fp), "near_next": likeness(fp, next_fp)}


def _texts(batch: pa.RecordBatch) -> Iterator[tuple]:
    for doc_id, text in zip(batch.column(0), batch.column(1)):
        yield doc_id.as_py(), text.as_py() or ""


def _batches(rows: Iterator[dict], schema: pa.Schema, size: int = 256) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _schema(*more: tuple[str, pa.DataType]) -> pa.Schema:
    return pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
                      ("fingerprint", pa.binary()), ("edited_fingerprint", pa.binary()),
                      ("near_edited", pa.float64()), ("near_next", pa.float64()), *more])


def against_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edit with the next document by descending id.

    One range shuffle puts neighbours together, and each task walks its documents with one row of
    lookahead. Only the last document of a task still lacks its next one: the first and the last
    text of each task are written along with the results and paired up afterwards.
    """
    ident = F.col(f"`{doc_id}`").cast("bigint")
    ordered = docs.select(ident.alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    ordered = ordered.repartitionByRange(F.col("doc_id").desc_nulls_last()).sortWithinPartitions(
        F.col("doc_id").desc_nulls_last(), F.col("text").asc_nulls_first())
    schema = _schema(("task", pa.int32()), ("first_text", pa.string()), ("last_text", pa.string()))

    def walk(batches):
        known, task = WordHashes(), TaskContext.get().partitionId()
        ends: list[dict] = []

        def pairs():
            before = None
            for batch in batches:
                for ident, own in _texts(batch):
                    now = (ident, own, short(signature(shingles(own.encode(), known))))
                    if before is None:
                        ends.append({"task": task, "first_text": own})
                    else:
                        yield (*before, *now[1:])
                    before = now
            if before is not None:
                ends.append({"task": task, "doc_id": before[0], "last_text": before[1]})

        yield from _batches(compared(pairs(), known), schema)
        yield from _batches(iter(ends), schema)

    found = materialise(ordered.mapInArrow(walk, f"{ROW}, task int, first_text string, last_text string"), "minhash")
    firsts = found.where("first_text is not null").select("task", F.col("first_text").alias("next_text"))
    # one number per task: which task follows which, round in a circle
    tasks = sorted(r.task for r in firsts.select("task").collect())
    follows = docs.sparkSession.createDataFrame(
        [(t, tasks[(i + 1) % len(tasks)]) for i, t in enumerate(tasks)], "task int, after int")
    lasts = (found.where("last_text is not null").select("doc_id", "last_text", "task").join(follows, "task")
             .join(firsts.withColumnRenamed("task", "after"), "after").select("doc_id", "last_text", "next_text"))

    def finish(batches):
        known = WordHashes()

        def rows():
            for batch in batches:
                for row in batch.to_pylist():
                    fps = [short(signature(shingles(row[c].encode(), known))) for c in ("last_text", "next_text")]
                    yield row["doc_id"], row["last_text"], fps[0], row["next_text"], fps[1]
        yield from _batches(compared(rows(), known), _schema())

    inner = found.where("task is null").select("doc_id", *[f.name for f in _schema()][1:])
    whole = inner.union(lasts.mapInArrow(finish, ROW))
    return whole.withColumns({c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")})


def text_hash(text: Column) -> Column:
    """60 bits of SHA-256 stand for a text; a null text is empty."""
    return F.conv(F.substring(F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256), 1, 15), 16, 10).cast("bigint")


def links(texts: DataFrame, least: float = 0.8) -> DataFrame:
    """Edges ``(a, b)`` that connect what a likeness of ``least`` links among the ``node`` (see
    :func:`text_hash`) and ``text`` of ``texts``: two texts that share a band and whose true
    Jaccard reaches it. Rows may repeat. Only texts in company are moved.

    In every band group each text is first paired with the group's busiest one, that with the most
    company over all its bands: the original of many edits is in company with all of them. Pairs
    that these links leave apart are all looked at by :func:`apart`.
    """
    def hashed(column: pa.Array) -> pa.Array:
        known = WordHashes()
        return pa.array([np.unique(shingles(raw, known)).view(np.int64) for raw in raw_texts(column)],
                        pa.list_(pa.int64()))

    def banded(column: pa.Array) -> pa.Array:
        known, out_ = WordHashes(), []
        for raw in raw_texts(column):
            rows = signature(shingles(raw, known)).reshape(-1, BAND)
            out_.append([xxhash.xxh3_64_intdigest(r.tobytes(), i) >> 1 for i, r in enumerate(rows)])
        return pa.array(out_, pa.list_(pa.int64()))

    signed = texts.select("node", F.arrow_udf(banded, "array<bigint>")("text").alias("all")).dropDuplicates(["node"])
    bands = materialise(signed.select("node", F.explode("all").alias("band")), "signed")
    sizes = bands.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    bands = materialise(bands.join(sizes, "band").select("node", "band", "n"), "bands")
    company = materialise(bands.groupBy("node").agg(F.sum("n").alias("company")), "company")
    sets = materialise(texts.join(company, "node", "left_semi").dropDuplicates(["node"]).select(
        "node", F.arrow_udf(hashed, "array<bigint>")("text").alias("set")), "sets")
    busiest = bands.join(company, "node").groupBy("band").agg(F.max(F.struct("company", "node")).alias("of"))
    pairs = bands.join(busiest, "band").select(F.col("of.node").alias("a"), F.col("node").alias("b")).where("a <> b")
    close = materialise(verified(pairs.distinct(), sets, least), "links")
    roots = components(close)
    labelled = bands.join(roots, "node", "left").select("node", "band", F.coalesce("root", "node").alias("root"))
    mixed = labelled.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    split = materialise(labelled.join(mixed, "band", "left_semi").select("node", "root").distinct(), "split")
    return close.union(materialise(verified(apart(split.join(sets, "node"), least), sets, least), "links"))


def verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs ``(a, b)`` whose sets have a Jaccard of ``least`` or more."""
    one, two = (sets.select(F.col("node").alias(c), F.col("set").alias(f"set_{c}")) for c in "ab")
    both = F.size(F.array_intersect("set_a", "set_b"))
    union = F.size("set_a") + F.size("set_b") - both
    return pairs.join(one, "a").join(two, "b").where((union == 0) | (both >= F.lit(least) * union)).select("a", "b")


#: Holders of a shingle that meet in one piece of a join.
HOLDERS = 256


def apart(split: DataFrame, least: float) -> DataFrame:
    """Pairs ``(a, b)`` of different roots that may reach ``least``; none that does is left out.

    With the shingles of every set ordered from the rarest on, two sets of Jaccard ``least`` share
    one among the first ``n - ceil(least * n) + 1`` of each; the first that they share has enough
    shingles behind it on either side, and their sizes are near. Texts that a common passage
    has drawn together don't meet, for their rarest shingles lie outside it. Holders of one
    shingle meet chunk by chunk.
    """
    slack = 1e-9  # bounds are rounded towards more pairs
    each = split.select("node", "root", F.size("set").alias("n"), F.explode("set").alias("shingle"))
    often = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("df"), F.min("root").alias("low"), F.max("root").alias("high"))
    shared = each.join(often.where("df > 1"), "shingle").groupBy("node", "root", "n").agg(
        F.array_sort(F.collect_list(F.struct("df", "shingle", (F.col("low") < F.col("high")).alias("links")))).alias("shared"))
    # the shingles that no other set has come first and fill places too
    alone = F.col("n") - F.size("shared")
    places = F.col("n") - F.ceil(F.col("n") * least - slack) + 1 - alone
    first = shared.where(places > 0).select(
        "node", "root", "n", alone.alias("alone"), F.posexplode(F.slice("shared", F.lit(1), places.cast("int"))).alias("place", "of"))
    # a shingle whose holders are all connected links nothing
    held = materialise(first.where("of.links").select(
        "node", "root", "n", (F.col("alone") + F.col("place")).alias("place"), F.col("of.shingle").alias("shingle"),
        F.ceil(F.col("of.df") / HOLDERS).cast("int").alias("chunks")), "held")
    own = held.withColumn("own", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    rows = own.select(F.col("node").alias("a"), F.col("root").alias("root_a"), F.col("n").alias("n_a"), F.col("place").alias("place_a"),
                      "shingle", F.col("own").alias("row"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("column"))
    columns = own.select(F.col("node").alias("b"), F.col("root").alias("root_b"), F.col("n").alias("n_b"), F.col("place").alias("place_b"),
                         "shingle", F.col("own").alias("column"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("row"))
    needed = (F.col("n_a") + F.col("n_b")) * (least / (1 + least)) - slack
    behind = F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b"))
    return rows.join(columns, ["shingle", "row", "column"]).where(
        (F.col("a") < F.col("b")) & (F.col("root_a") != F.col("root_b")) & (behind >= needed)).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = 0.8,
                    out: str = "group_id") -> DataFrame:
    """``docs`` with the smallest id among the texts that verified links connect. Equal texts are one."""
    columns = [c for c in docs.columns if c != out]
    node = fresh("_text_hash", columns)
    # the id of the lowest row stands for its copies
    keyed = docs.select(*[F.col(f"`{c}`") for c in columns], text_hash(F.col(f"`{text}`")).alias(node))
    texts = docs.select(text_hash(F.col(f"`{text}`")).alias("node"), F.col(f"`{text}`").cast("string").alias("text"))
    roots = components(links(texts, least))
    firsts = keyed.groupBy(F.col(node).alias("node")).agg(F.min(f"`{doc_id}`").alias("first"))
    named = firsts.join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    least_id = named.groupBy("root").agg(F.min("first").alias("least"))
    of = fresh("_of", [*columns, node])
    of_node = named.join(least_id, "root").select(F.struct("node", "least").alias(of))
    return keyed.join(of_node, F.col(node) == F.col(f"{of}.node")).select(
        *[F.col(f"`{c}`") for c in columns], F.col(f"{of}.least").alias(out))
