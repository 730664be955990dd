"""MinHash near-duplicates, candidates tested step by step by the posterior of their likeness.

A document's set holds its different windows of three lower-cased words (with fewer words, the whole
sequence is one). Documents with equal sets are one *node*. A signature keeps one byte of the least
value under each of 125 permutations; 25 bands of five of them propose candidates, and two sets that
are alike in 85 of 100 share none with a probability of 4e-7.

A candidate's signatures are compared a batch at a time. With a uniform prior, ``m`` agreements in
``n`` give the likeness a beta posterior; as soon as the posterior probability of reaching the
threshold falls below the chosen miss probability (divided by the number of batches), the pair is
dropped. All pairs that survive every batch are verified on their full sets.

Links need not be found twice. In a band group of any size each node first meets the group's busiest
one, that with the most company over all its bands. Where components leave a group split, the next
busiest meets those that it is not connected with. What is split after that is compared in blocks of
a few hundred nodes, the smaller components of a group with all of it, in numpy, survivors verified
there and then. No candidate is left out, and no block gives back more links than it takes to connect
its nodes. The worst case is a large group whose members are all just below the threshold: the work
inside its blocks then grows with the square of its size, and every 512 members add a copy of its rows.

Defined cases: a text without words, or null, has an empty set and is linked with nothing; rows without
an id get the smallest id of their component, or null; ``kept`` holds for the rows that carry that
id, and for all of a component without any; repeated rows give repeated rows; an empty table stays
empty; other columns pass through, those with the names of the results are replaced.
"""

from __future__ import annotations

from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tarnish.llm.components import components
from tarnish.llm.minhash import WordHashes, mix
from tarnish.llm.texts import fresh, raw_texts
from tarnish.session import materialise

WIDTH, BANDS, ROWS = 3, 25, 5
PERMUTATIONS = BANDS * ROWS
#: Hashes compared at a time, and the probability that a pair at the threshold is missed.
BATCH, MISS = 25, 1e-6
#: Least likeness, as a fraction.
LEAST = (85, 100)
#: Rounds of the busiest, and nodes of a block.
STARS, BLOCK = 2, 512
#: Shingles that go through all permutations at a time.
CHUNK = 2048

_rng = np.random.default_rng(20250713)
FACTORS = _rng.integers(0, 1 << 64, PERMUTATIONS, np.uint64) | np.uint64(1)
OFFSETS = _rng.integers(0, 1 << 64, PERMUTATIONS, np.uint64)
PLACES = _rng.integers(0, 1 << 64, 16, np.uint64) | np.uint64(1)


def shingle_set(raw: bytes, known: WordHashes, width: int = WIDTH) -> np.ndarray:
    """Ascending 64-bit hashes of the different shingles."""
    words = raw.lower().split()
    width = min(width, len(words))
    if not width:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = len(words) - width + 1
    total = np.full(n, width, np.uint64)
    for place in range(width):
        total += mix(hashes[place:place + n] + np.uint64(place)) * PLACES[place]
    return np.unique(mix(total))


def signature(own: np.ndarray) -> bytes:
    """A byte of the least value under each permutation."""
    least = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(own), CHUNK):
        values = np.multiply.outer(FACTORS, own[start:start + CHUNK])
        values += OFFSETS[:, None]
        np.minimum(least, values.min(axis=1), out=least)
    return (least >> np.uint64(56) ^ least >> np.uint64(20)).astype(np.uint8).tobytes()


def digest(own: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(own.tobytes(), 5) - (1 << 63)


@lru_cache(maxsize=16)
def needed(least: tuple[int, int] = LEAST, miss: float = MISS, batch: int = BATCH) -> tuple[tuple[int, int], ...]:
    """``(n, m)``: after ``n`` hashes a pair with fewer than ``m`` agreements is dropped.

    With a uniform prior, P(likeness >= t | m of n) = P(Binomial(n + 1, t) <= m).
    """
    t, out = least[0] / least[1], []
    steps = range(batch, PERMUTATIONS + 1, batch)
    for n in steps:
        below, m = 0.0, 0
        while True:
            below += comb(n + 1, m) * t ** m * (1 - t) ** (n + 1 - m)
            if below >= miss / len(steps):
                break
            m += 1
        out.append((n, m))
    return tuple(out)


def surviving(a: np.ndarray, b: np.ndarray, least: tuple[int, int], miss: float) -> np.ndarray:
    """Agreements of each pair of signature rows, -1 for the pairs that were dropped."""
    alive, agree, before = np.arange(len(a)), np.full(len(a), -1), 0
    count = np.zeros(len(a), np.int64)
    for n, m in needed(least, miss):
        count += (a[alive, before:n] == b[alive, before:n]).sum(axis=1)
        keep = count >= m
        alive, count, before = alive[keep], count[keep], n
    agree[alive] = count
    return agree


def rows_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(v.as_py() for v in column), np.uint8).reshape(len(column), PERMUTATIONS)


def candidates_left(pairs: DataFrame, nodes: DataFrame, least: tuple[int, int], miss: float) -> DataFrame:
    """The pairs ``(a, b)`` whose sizes allow the likeness and whose signatures survive."""
    def test(one: pa.Array, two: pa.Array) -> pa.Array:
        return pa.array(surviving(rows_of(one), rows_of(two), least, miss) >= 0)

    one, two = (nodes.select(*[F.col(c).alias(f"{c}_{x}") for c in ("node", "n", "sig")]) for x in "ab")
    met = pairs.join(one, F.col("a") == F.col("node_a")).join(two, F.col("b") == F.col("node_b"))
    met = met.where(F.least("n_a", "n_b") * least[1] >= F.greatest("n_a", "n_b") * least[0])
    return met.where(F.arrow_udf(test, "boolean")("sig_a", "sig_b")).select("a", "b")


def sets_of(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """``wanted`` nodes with their full ``set``, from one document of each; only their texts are moved."""
    def hashed(column: pa.Array) -> pa.Array:
        known = WordHashes()
        return pa.array([shingle_set(raw, known, width).tobytes() for raw in raw_texts(column)], pa.binary())

    of = wanted.select("node", "n", "sig", F.col("id").alias("of_id"), F.col("key").alias("of_key"))
    found = docs.join(of, F.col("id").eqNullSafe(F.col("of_id")) & (F.col("key") == F.col("of_key"))).dropDuplicates(["node"])
    return materialise(found.select("node", "n", "sig", F.arrow_udf(hashed, "binary")("text").alias("set")), "sets")


def verified(pairs: DataFrame, sets: DataFrame, least: tuple[int, int]) -> DataFrame:
    """The pairs ``(a, b)`` whose full sets are that alike."""
    def alike(one: pa.Array, two: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(one, two):
            p, q = (np.frombuffer(v.as_py(), np.uint64) for v in (x, y))
            both = len(np.intersect1d(p, q, assume_unique=True))
            out.append(least[1] * both >= least[0] * (len(p) + len(q) - both))
        return pa.array(out, pa.bool_())

    one, two = (sets.select(F.col("node").alias(x), F.col("set").alias(f"set_{x}")) for x in "ab")
    return pairs.join(one, "a").join(two, "b").where(F.arrow_udf(alike, "boolean")("set_a", "set_b")).select("a", "b")


def split_groups(bands: DataFrame, linked: DataFrame | None) -> DataFrame:
    """The rows of the groups that hold more than one component, with each node's ``root``."""
    if linked is None:
        return bands.withColumn("root", F.col("node"))
    labelled = bands.join(components(linked), "node", "left").select(*bands.columns, F.coalesce("root", "node").alias("root"))
    mixed = labelled.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    return labelled.join(mixed.select("band"), "band", "left_semi")


def unordered(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


class Cell:
    """Nodes that meet in one task: their components, signatures and sets."""

    def __init__(self, cell: pa.Table):
        self.node, self.n, self.minor, self.index = (cell.column(c).to_numpy() for c in ("node", "n", "minor", "index"))
        self.root = np.array(cell.column("root").to_numpy())  # changes as nodes are linked
        self.sig = rows_of(cell.column("sig"))
        sets = [np.frombuffer(v.as_py(), np.uint64) for v in cell.column("set")]
        self.starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
        # shingles by their number inside the cell
        names, self.shingles = np.unique(np.concatenate(sets), return_inverse=True)
        self.mark = np.zeros(len(names), np.int32)

    def own(self, i: int) -> np.ndarray:
        return self.shingles[self.starts[i]:self.starts[i + 1]]

    def shared(self, i: int, js: np.ndarray) -> np.ndarray:
        """Shingles that ``i`` has in common with each of ``js``."""
        self.mark[self.own(i)] = 1
        both = np.array([self.mark[self.own(j)].sum() for j in js], np.int64)
        self.mark[self.own(i)] = 0
        return both

    def links(self, i: int, js: np.ndarray, least: tuple[int, int], miss: float) -> np.ndarray:
        """Those of ``js`` that are alike and meet here first."""
        low, high = np.minimum(self.n[i], self.n[js]), np.maximum(self.n[i], self.n[js])
        js = js[(self.root[js] != self.root[i]) & (low * least[1] >= high * least[0])]
        js = js[surviving(np.broadcast_to(self.sig[i], (len(js), PERMUTATIONS)), self.sig[js], least, miss) >= 0]
        first = (self.sig[js] == self.sig[i]).reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1)
        js = js[first == self.index[i]]
        both = self.shared(i, js)
        return js[least[1] * both >= least[0] * (self.n[i] + self.n[js] - both)]


def in_blocks(rows: DataFrame, sets: DataFrame, least: tuple[int, int], miss: float) -> DataFrame:
    """Links ``(a, b)`` between the components in split groups, as few as connect them in each block.

    A pair that shares several bands is looked at in the first of them.
    """
    sizes = rows.groupBy("band", "root").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.groupBy("band").agg(F.max(F.struct("n", "root")).alias("largest"), F.sum("n").alias("all"))
    cells = lambda n: F.ceil(n / BLOCK).cast("int")
    rows = rows.join(largest, "band").select(
        "band", "index", "node", "root", (F.col("root") != F.col("largest.root")).alias("minor"),
        cells(F.col("all") - F.col("largest.n")).alias("down"), cells(F.col("all")).alias("across"))
    own = lambda n: F.pmod(F.xxhash64("node", "band"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    fields = ("index", "node", "root", "minor")
    left = rows.where("minor").select("band", own(F.col("down")).alias("i"), every(F.col("across")).alias("j"), *fields, F.lit(True).alias("left"))
    right = rows.select("band", every(F.col("down")).alias("i"), own(F.col("across")).alias("j"), *fields, F.lit(False).alias("left"))

    def meet(cell: pa.Table) -> pa.Table:
        own_, side = Cell(cell.combine_chunks()), cell.column("left").to_numpy()
        columns, found = np.flatnonzero(~side), [np.empty((0, 2), np.int64)]
        for i in np.flatnonzero(side):
            js = columns[~own_.minor[columns] | (own_.node[columns] > own_.node[i])]
            for j in own_.links(i, js, least, miss):
                if own_.root[j] != own_.root[i]:  # one link joins two components
                    found.append(own_.node[[i, j]][None])
                    own_.root[own_.root == own_.root[j]] = own_.root[i]
        pairs = np.concatenate(found)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    met = left.union(right).join(sets, "node")
    return met.groupBy("band", "i", "j").applyInArrow(meet, "a bigint, b bigint").distinct()


def links(docs: DataFrame, nodes: DataFrame, least: tuple[int, int] = LEAST, miss: float = MISS, width: int = WIDTH) -> DataFrame:
    """Edges ``(a, b)`` that connect the nodes as their verified links do.

    ``nodes``: see :func:`nodes_of`; ``docs``: ``id``, ``key`` and ``text``.
    """
    keys = F.array(*[F.xxhash64(F.lit(i), F.substring("sig", i * ROWS + 1, ROWS)) for i in range(BANDS)])
    bands = nodes.select("node", F.posexplode(keys).alias("index", "band"))
    sizes = bands.groupBy("band").agg(F.count(F.lit(1)).alias("company")).where("company > 1")
    bands = materialise(bands.join(sizes, "band"), "bands")
    company = materialise(bands.groupBy("node").agg(F.sum("company").alias("company")), "company")
    sets = sets_of(docs, nodes.join(company, "node", "left_semi"), width)
    rows = bands.select("band", "index", "node").join(company, "node")
    linked = None
    for _ in range(STARS):
        split = materialise(split_groups(rows, linked), "split")
        lead = materialise(split.groupBy("band").agg(F.max(F.struct("company", "node", "root")).alias("lead")).select("band", "lead.node", "lead.root"), "lead")
        met = split.alias("x").join(lead.alias("l"), "band").where("x.root <> l.root")
        pairs = met.select(*unordered("x.node", "l.node")).distinct()
        more = materialise(verified(candidates_left(pairs, nodes, least, miss), sets, least), "links")
        linked = more if linked is None else linked.union(more)
        # a lead has met all of its group
        rows = split.join(lead.select("band", "node"), ["band", "node"], "left_anti").select("band", "index", "node", "company")
    split = materialise(split_groups(rows, linked), "split")
    return linked if split.isEmpty() else linked.union(materialise(in_blocks(split, sets, least, miss), "links"))


def nodes_of(rows: DataFrame) -> DataFrame:
    """Of rows ``(id, key, node, n, sig)``, those with a set: a row per node, with the ``id`` and ``key`` of one of its rows."""
    first = rows.where("n > 0").groupBy("node").agg(F.min(F.struct(F.col("id").isNull().alias("without"), "id", "key", "n", "sig")).alias("f"))
    return materialise(first.select("node", "f.id", "f.key", "f.n", "f.sig"), "nodes")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: tuple[int, int] = LEAST,
                    miss: float = MISS, out: tuple[str, str, str] = ("n_shingles", "component_id", "kept")) -> DataFrame:
    """Every row's columns but the text, its set's size, its component's smallest id, and whether it
    is the one that stays."""
    columns = [c for c in docs.columns if c != text and c not in out]
    ident, body = F.col(f"`{doc_id}`").cast("bigint"), F.col(f"`{text}`").cast("string")

    def read(column: pa.Array) -> pa.Array:
        known, node, n, sig = WordHashes(), [], [], []
        for raw in raw_texts(column):
            own = shingle_set(raw, known)
            node.append(digest(own))
            n.append(len(own))
            sig.append(signature(own))
        return pa.StructArray.from_arrays([pa.array(node, pa.int64()), pa.array(n, pa.int64()), pa.array(sig, pa.binary())],
                                          ["node", "n", "sig"])

    s = fresh("_set", columns)
    marked = materialise(docs.select(*[F.col(f"`{c}`") for c in columns], F.struct(
        ident.alias("id"), F.xxhash64(body).alias("key"),
        F.arrow_udf(read, "struct<node:bigint,n:bigint,sig:binary>")(body).alias("of")).alias(s)), "signed")
    nodes = nodes_of(marked.select(f"{s}.id", f"{s}.key", f"{s}.of.*"))
    plain = docs.select(ident.alias("id"), F.xxhash64(body).alias("key"), body.alias("text"))
    roots = components(links(plain, nodes, least, miss))
    named = materialise(nodes.select("node", "id").join(roots, "node", "left").select("node", "id", F.coalesce("root", "node").alias("root")), "roots")
    smallest = named.groupBy("root").agg(F.min("id").alias("component"))
    of = fresh("_of", [*columns, s])
    of_node = named.join(smallest, "root").select(F.struct("node", "component").alias(of))
    # rows with an empty set meet nothing
    met = marked.join(of_node, (F.col(f"{s}.of.node") == F.col(f"{of}.node")) & (F.col(f"{s}.of.n") > 0), "left")
    component = F.when(F.col(f"{s}.of.n") > 0, F.col(f"{of}.component")).otherwise(F.col(f"{s}.id"))
    return met.select(*[F.col(f"`{c}`") for c in columns], F.col(f"{s}.of.n").alias(out[0]), component.alias(out[1]),
                      (component.isNull() | F.coalesce(F.col(f"{s}.id") == component, F.lit(False))).alias(out[2]))
