"""SimHash near-duplicates by vantage-point trees.

Equal fingerprints collapse first. A vantage-point tree over Hamming distance, fitted on a
bounded sample of fingerprints, cuts all of them into shards: at each node those within the
radius go inside and the others outside. Two fingerprints at most ``k`` apart differ by at most
``k`` in their distance to the vantage point, so a pair that a node separates has its inner
member within ``k`` of the radius; such members are also sent outside, and no pair is lost. Each
shard then finds its pairs with a tree of its own, cut by the same bound, down to blocks that are
compared outright. A shard gives back a spanning star per group, never all pairs, and the stars
of all shards meet in distributed connected components.

Defined cases: a null or empty text has fingerprint zero; rows without an id get the smallest id
that their component has, or null; repeated rows give repeated rows; other columns pass through.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tarnish.llm import bayes_minhash, minhash
from tarnish.llm.components import components
from tarnish.llm.texts import fresh, raw_texts
from tarnish.session import materialise

#: The tree is fitted on about this many fingerprints, and on no more than a quarter of them.
SAMPLE = 1 << 16
#: A node that stands for fewer fingerprints, or has fewer sample members, becomes a shard.
SHARD, SHARD_SAMPLE = 4096, 16
#: Compared outright within a shard.
BLOCK = 512


def shingle_hashes(raw: bytes, width: int = 3, seed: int = 42) -> np.ndarray:
    """XXH64 of every window of ``width`` lower-cased words, of all the words if fewer."""
    words = raw.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    text, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(text, seed)], np.uint64)
    ends = list(accumulate(len(w) + 1 for w in words))
    spans = zip([0, *ends], ends[width - 1:])
    return np.fromiter((digest(text[a:b - 1], seed) for a, b in spans), np.uint64, len(words) - width + 1)


def fingerprint(raw: bytes) -> int:
    """A bit is set if it is set in over half the hashes. As a signed 64-bit number."""
    hashes = shingle_hashes(raw)
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 1 << 14):
        part = hashes[start:start + (1 << 14)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(text: Column) -> Column:
    def of(texts: pa.Array) -> pa.Array:
        return pa.array(np.fromiter(map(fingerprint, raw_texts(texts)), np.int64, len(texts)))
    return F.arrow_udf(of, "bigint")(text.cast("string"))


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def best_cut(sample: np.ndarray, k: int, rng: np.random.Generator) -> tuple[int, int, float]:
    """Vantage point, radius, and the work left by the cut relative to none (1: useless)."""
    points = np.concatenate([rng.choice(sample, 6), rng.integers(0, 1 << 64, 2, np.uint64)])
    best = (0, 0, 1.0)
    for point in points:
        upto = np.cumsum(np.bincount(np.bitwise_count(sample ^ point), minlength=65))
        inside, n = upto, upto[-1]
        outside = n - np.concatenate([np.zeros(k, upto.dtype), upto])[:65]
        # a radius of d puts distances 0..d inside, and those above d - k outside
        work = (inside.astype(float) ** 2 + outside.astype(float) ** 2) / float(n) ** 2
        d = int(work.argmin())
        if work[d] < best[2]:
            best = (int(point), d, float(work[d]))
    return best


def fit_tree(sample: np.ndarray, scale: float, k: int, seed: int = 7) -> tuple[list[tuple[int, int, int, int]], int]:
    """Nodes ``(point, radius, inside, outside)``; a negative child ``-1 - i`` is shard ``i``.

    The root is the first node. ``scale``: fingerprints that each sample member stands for.
    """
    rng, nodes, shards = np.random.default_rng(seed), [], 0
    todo: list[tuple[np.ndarray, int, int]] = [(sample, -1, 2)]
    while todo:
        own, parent, slot = todo.pop()
        at = None
        if len(own) > SHARD_SAMPLE and len(own) * scale > SHARD:
            point, radius, work = best_cut(own, k, rng)
            if work < 0.9:
                at = len(nodes)
                nodes.append([point, radius, 0, 0])
                apart = np.bitwise_count(own ^ np.uint64(point)).astype(np.int64)
                todo += [(own[apart <= radius], at, 2), (own[apart > radius - k], at, 3)]
        if at is None:
            at, shards = -1 - shards, shards + 1
        if parent >= 0:
            nodes[parent][slot] = at
    return [tuple(n) for n in nodes], shards


def deal(values: np.ndarray, nodes: list[tuple[int, int, int, int]], k: int):
    """``(shard, members)`` for every shard that the values reach."""
    todo = [(0 if nodes else -1, np.arange(len(values)))]
    while todo:
        at, own = todo.pop()
        if not len(own):
            continue
        if at < 0:
            yield -1 - at, own
            continue
        point, radius, inside, outside = nodes[at]
        apart = np.bitwise_count(values[own] ^ np.uint64(point)).astype(np.int64)
        todo += [(inside, own[apart <= radius]), (outside, own[apart > radius - k])]


class Groups:
    """Disjoint sets over 0..n-1, joined a block of pairs at a time; the least member is the root."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.root[a], self.root[b]
            open_ = x != y
            a, b, x, y = a[open_], b[open_], x[open_], y[open_]
            np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(up := self.root[self.root], self.root):
                self.root = up


def near_groups(values: np.ndarray, k: int) -> np.ndarray:
    """Root of each of the distinct ``values``, linked at ``k`` or fewer differing bits."""
    groups, rng = Groups(len(values)), np.random.default_rng(11)
    todo = [np.arange(len(values))]
    while todo:
        own = todo.pop()
        if len(own) > BLOCK:
            point, radius, work = best_cut(values[own], k, rng)
            if work < 0.9:
                apart = np.bitwise_count(values[own] ^ np.uint64(point)).astype(np.int64)
                todo += [own[apart <= radius], own[apart > radius - k]]
                continue
        for start in range(0, len(own), BLOCK):
            rows = own[start:start + BLOCK]
            for other in range(start, len(own), 8 * BLOCK):
                columns = own[other:other + 8 * BLOCK]
                i, j = np.nonzero(np.bitwise_count(values[rows, None] ^ values[None, columns]) <= k)
                groups.join(rows[i], columns[j])
    return groups.root


def links(distinct: DataFrame, k: int = 2) -> DataFrame:
    """Edges ``(a, b)`` that connect what is at most ``k`` bits apart; ``distinct`` has ``fp``."""
    n = distinct.count()
    share = min(0.25, SAMPLE / max(n, 1))
    picked = distinct.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 20)) < int(share * (1 << 20)))
    sample = np.array(sorted(r.fp for r in picked.collect()), np.int64).view(np.uint64)  # bounded by SAMPLE
    nodes, _ = fit_tree(sample, 1 / share, k)

    def to_shards(batches):
        for batch in batches:
            values = batch.column("fp").to_numpy().view(np.uint64)
            for shard, members in deal(values, nodes, k):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(members), shard, np.int64)), pa.array(values[members].view(np.int64))],
                    ["shard", "fp"])

    def stars(shard: pa.Table) -> pa.Table:
        values = shard.column("fp").to_numpy()
        root = near_groups(values.view(np.uint64), k)
        away = root != np.arange(len(values))
        return pa.table({"a": values[away], "b": values[root[away]]})

    shards = distinct.select("fp").mapInArrow(to_shards, "shard bigint, fp bigint")
    return shards.groupBy("shard").applyInArrow(stars, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 2,
                    out: tuple[str, str] = ("fingerprint", "component_id")) -> DataFrame:
    """Every row's columns but the text, its fingerprint, and its component's smallest id."""
    others = [c for c in docs.columns if c != text and c not in out]
    fp, ident = fresh("_fp", others), F.col(f"`{doc_id}`")
    marked = materialise(docs.select(*[F.col(f"`{c}`") for c in others], fingerprints(F.col(f"`{text}`")).alias(fp)),
                         "fingerprints")
    distinct = materialise(marked.groupBy(F.col(fp).alias("fp")).agg(F.min(ident).alias("first")), "distinct")
    linked = components(links(distinct, k))
    roots = materialise(distinct.join(linked, F.col("fp") == F.col("node"), "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")), "roots")
    named = roots.groupBy("root").agg(F.min("first").alias("component"))
    of_fp = roots.select("fp", "root").join(named, "root").select(
        F.struct("fp", "component").alias(fresh("_of", [*others, fp])))
    of = of_fp.columns[0]
    return marked.join(of_fp, F.col(fp) == F.col(f"{of}.fp")).select(
        *[F.col(f"`{c}`") for c in others], hex_digits(F.col(fp)).alias(out[0]), F.col(f"{of}.component").alias(out[1]))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 2,
                least: tuple[int, int] = (80, 100), width: int = 5) -> DataFrame:
    """One row of each component; texts are linked at ``k`` differing bits or fewer and, whatever
    their bits, where their sets of ``width`` words are alike in ``least`` (80 of 100).

    Fingerprint, set and signature of a text are made in one pass; what follows works on those. The
    row with the smallest id stays, one without an id only where its component has no other. Rows
    are told apart by id and text, so an id that stands for two texts keeps both.
    """
    ident, body = F.col(f"`{doc_id}`").cast("bigint"), F.col(f"`{text}`").cast("string")

    def read(column: pa.Array) -> pa.Array:
        known, rows = minhash.WordHashes(), []
        for raw in raw_texts(column):
            own = bayes_minhash.shingle_set(raw, known, width)
            rows.append((fingerprint(raw), bayes_minhash.digest(own), len(own), bayes_minhash.signature(own)))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 4, kinds)], ["fp", "node", "n", "sig"])

    plain = docs.select(ident.alias("id"), F.xxhash64(body).alias("key"), body.alias("text"))
    marked = materialise(plain.select("id", "key", F.arrow_udf(read, "struct<fp:bigint,node:bigint,n:bigint,sig:binary>")("text").alias("of")
                                      ).select("id", "key", "of.*"), "fingerprints")
    nodes = bayes_minhash.nodes_of(marked)
    near = bayes_minhash.links(plain, nodes, least, width=width)
    # a set stands for all fingerprints of its texts
    fps = materialise(marked.groupBy("fp", "node").agg(F.max("n").alias("n")), "fps")
    of_node = fps.where("n > 0").groupBy("node").agg(F.min("fp").alias("first"))
    same = fps.join(of_node, "node").where("n > 0 and fp <> first").select(F.col("fp").alias("a"), F.col("first").alias("b"))
    one, two = (of_node.select(F.col("node").alias(c), F.col("first").alias(f"fp_{c}")) for c in "ab")
    near = near.join(one, "a").join(two, "b").select(F.col("fp_a").alias("a"), F.col("fp_b").alias("b"))
    distinct = materialise(fps.select("fp").distinct(), "distinct")
    linked = components(links(distinct, k).union(near).union(same)).select(F.col("node").alias("fp"), "root")
    rows = marked.join(linked, "fp", "left").groupBy("id", "key").agg(F.min(F.coalesce("root", "fp")).alias("root"), F.count(F.lit(1)).alias("times"))
    rows = materialise(rows, "rooted")
    kept = rows.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("without"), "id", "key")).alias("first")).select("first.id", "first.key")
    i, n = fresh("_id", docs.columns), fresh("_key", docs.columns)
    same_row = ident.eqNullSafe(F.col(i)) & (F.xxhash64(body) == F.col(n))
    named = lambda x: x.select(F.col("id").alias(i), F.col("key").alias(n))
    # what goes is far less than what stays; rows with one id and text go too, and one of them comes back
    gone = materialise(named(rows.where("times > 1").union(rows.join(kept.withColumn("stays", F.lit(True)), rows.id.eqNullSafe(kept.id) & (
        rows.key == kept.key), "left").where("stays is null").select(rows["*"]))), "gone")
    left = docs.join(gone, same_row, "left_anti")
    repeated = rows.where("times > 1")
    if repeated.isEmpty():
        return left
    again = materialise(named(repeated.join(kept, rows.id.eqNullSafe(kept.id) & (rows.key == kept.key), "left_semi")), "repeated")
    back = docs.join(again, same_row, "left_semi").withColumn(n, F.xxhash64(body)).dropDuplicates([doc_id, n]).drop(n)
    return left.union(back)
