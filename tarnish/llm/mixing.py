"""Mixing sources to target weights by entropy balancing.

The mix gives every document a rate, the expected number of its copies. Among all rates from 0 to
``cap`` it takes those with the least relative entropy to the corpus as it is (each word one
unit), such that every source has exactly its target of words, while the words of each band of
document lengths (powers of two) stay near their share of the corpus. The solution is an
exponential tilt, ``rate = min(cap, exp(lambda[source] + mu[band]))``, whose multipliers solve a
convex dual. Given the bands' multipliers each source's own follows alone, inside the tasks, so
Newton's method runs over the bands only (at most 64): each iteration is one Spark job over the
table of sources that sums the gradient and the Hessian of the profiled dual, whatever the number
of sources. A small ridge on the bands' multipliers keeps the dual solvable where the bands'
shares can't all be met; the sources' targets are met exactly in any case.

Rates become copies by carrying the rounding error from document to document, longest first,
within buckets of a source, so each bucket is off by less than its shortest documents. No bucket
is large, and no source is one.

Defined cases: documents without a source are a source of their own, last in order; a document
without words counts nothing; no document has more than ``cap`` copies; rows that repeat are
rounded as rows of their own; an empty table has no rows; other columns pass through.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tarnish.llm.texts import fresh
from tarnish.session import discard, materialise

BANDS, RIDGE, TOLERANCE, ROUNDS = 64, 0.05, 1e-7, 50
#: Documents rounded together, and how many may meet by chance before a bucket is split.
BUCKET, CROWDED = 5000, 20_000


def words(text: Column) -> Column:
    """Words of a text: runs of anything but ASCII white space; none if null."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def in_order(table: DataFrame, key: str) -> DataFrame:
    """``table`` with ``position``, from 0 in the order of ``key``, nulls last."""
    ranged = table.repartitionByRange(F.col(key).asc_nulls_last()).sortWithinPartitions(F.col(key).asc_nulls_last())
    ranged = materialise(ranged.withColumn("_at", F.monotonically_increasing_id()), "in-order")
    part = F.shiftright("_at", 33)
    # one row per partition
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return ranged.withColumn("_part", part).join(starts, "_part").select(
        *table.columns, (F.col("_start") + F.col("_at").bitwiseAND((1 << 33) - 1)).alias("position"))


def share_out(sources: DataFrame, cap: float) -> DataFrame:
    """Add ``target``: the words of all ``sources`` (``size``, ``weight``) dealt by weight, none
    over ``cap`` times its own; what is over is dealt again until nothing is."""
    limit, level = F.lit(float(cap)) * F.col("size"), None
    total, weights = sources.agg(F.sum("size"), F.sum("weight")).first()
    deal = float(total or 0) / (weights or 1)
    while deal != level:
        level = deal
        full = F.col("weight") * F.lit(level) > limit
        fixed, open_ = sources.agg(F.sum(F.when(full, F.col("size"))), F.sum(F.when(~full, F.col("weight")))).first()
        if not open_:
            break
        deal = max(level, (float(total) - cap * float(fixed or 0)) / open_)
    return sources.withColumn("target", F.least(limit, F.col("weight") * F.lit(float(level or 0))))


def source_tilts(tokens: np.ndarray, target: np.ndarray, mu: np.ndarray, cap: float) -> np.ndarray:
    """lambda of each source: its words at ``min(cap, exp(lambda + mu))`` add up to its target."""
    with np.errstate(divide="ignore"):
        low = np.log(target) - np.log((tokens * np.exp(mu)).sum(1).clip(1e-300))
        high = np.full(len(tokens), math.log(cap) - mu.min())
    low = np.minimum(np.where(np.isfinite(low), low, -700.0), high)
    # at ``low`` the words are at most the target, at ``high`` every rate is the cap
    lam = low.copy()
    for _ in range(80):
        tilt = np.exp(lam[:, None] + mu)
        have = (tokens * np.minimum(cap, tilt)).sum(1)
        slope = (tokens * np.where(tilt < cap, tilt, 0)).sum(1)
        low, high = np.where(have < target, lam, low), np.where(have >= target, lam, high)
        step = lam + (target - have) / np.where(slope > 0, slope, 1)
        lam = np.where((slope > 0) & (step > low) & (step < high), step, (low + high) / 2)
    return np.where(target >= cap * tokens.sum(1), math.log(cap) - mu.min(), lam)


def dual(tokens: np.ndarray, target: np.ndarray, mu: np.ndarray, cap: float) -> np.ndarray:
    """Value, gradient and Hessian over ``mu`` of these sources' part of the profiled dual, flat."""
    lam = source_tilts(tokens, target, mu, cap)
    u = lam[:, None] + mu
    tilt, top = np.exp(u), u >= math.log(cap)
    rate = np.where(top, cap, tilt)
    conjugate = np.where(top, cap * u - (cap * math.log(cap) - cap + 1), tilt - 1)
    free = tokens * np.where(top, 0, tilt)
    own = free.sum(1)
    hessian = np.diag(free.sum(0)) - free.T @ (free / np.where(own > 0, own, 1)[:, None])
    value = (tokens * conjugate).sum() - (lam * target).sum()
    return np.concatenate([[value], (tokens * rate).sum(0), hessian.ravel()])


def balance(cells: DataFrame, cap: float) -> np.ndarray:
    """The bands' multipliers, by Newton's method; ``cells`` has ``tokens`` per band and ``target``."""
    size = 1 + BANDS + BANDS * BANDS

    def job(mu: np.ndarray) -> np.ndarray:
        def part(batches):
            for batch in batches:
                tokens = np.array(batch.column("tokens").to_pylist(), float).reshape(-1, BANDS)
                if len(tokens):
                    sums = dual(tokens, batch.column("target").to_numpy(), mu, cap)
                    at = np.flatnonzero(sums)
                    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(sums[at])], ["i", "v"])
        rows = cells.select("tokens", "target").mapInArrow(part, "i int, v double").groupBy("i").agg(F.sum("v").alias("v"))
        out = np.zeros(size)
        for r in rows.collect():  # at most ``size`` numbers
            out[r.i] = r.v
        return out

    wanted = np.zeros(BANDS)
    for r in cells.select(F.posexplode("tokens")).groupBy("pos").agg(F.sum("col").alias("n")).collect():
        wanted[r.pos] = r.n
    used, mu = wanted > 0, np.zeros(BANDS)

    def at(mu: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        out = job(mu)
        gradient = out[1:1 + BANDS] - wanted + RIDGE * wanted * mu
        hessian = out[1 + BANDS:].reshape(BANDS, BANDS) + np.diag(RIDGE * wanted)
        return out[0] - mu @ wanted + RIDGE / 2 * (wanted * mu * mu).sum(), gradient, hessian

    if not used.any():
        return mu
    value, gradient, hessian = at(mu)
    for _ in range(ROUNDS):
        if np.abs(gradient).max() <= TOLERANCE * wanted.sum():
            break
        step = np.zeros(BANDS)
        step[used] = -np.linalg.solve(hessian[np.ix_(used, used)], gradient[used])
        step /= max(1.0, np.abs(step).max() / 2)
        for _ in range(30):
            found = at(mu + step)
            if found[0] <= value + 1e-4 * (gradient @ step) + 1e-12 * abs(value):
                break
            step /= 2
        mu, (value, gradient, hessian) = mu + step, found
    # sums may differ in their last digits from run to run: the answer must not
    return np.round(mu, 6)


def rounded(group: pa.Table, cap: int) -> np.ndarray:
    """Copies of each document; the error is carried on from the longest to the shortest."""
    sizes, rates, ties = (group.column(c).to_numpy() for c in ("size", "rate", "tie"))
    copies, error = np.zeros(len(sizes), np.int64), 0.0
    for i in np.lexsort((ties, -sizes)):
        size = int(sizes[i])
        if not size:
            copies[i] = min(cap, round(float(rates[i])))
            continue
        wanted = float(rates[i]) * size + error
        copies[i] = times = min(cap, max(0, math.floor(wanted / size + 0.5)))
        error = wanted - times * size
    return copies


def mix(docs: DataFrame, size: str = "size", source: str = "source", doc_id: str = "doc_id",
        weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, out: str = "mix") -> DataFrame:
    """``docs`` with a struct ``out``: ``source_size``, ``target``, ``rate``, ``copies``, ``taken``.

    Sources in the order of their code points have the ``weights`` in turn and share the words of
    all documents; ``size`` is the column of a document's words.
    """
    columns = [c for c in docs.columns if c != out]
    row = fresh("_row", columns)
    docs = materialise(docs.select(*[F.col(f"`{c}`") for c in columns], F.monotonically_increasing_id().alias(row)), "mix")
    bare = docs.select(F.col(row).alias("row"), F.col(f"`{source}`").alias("source"), F.col(f"`{size}`").alias("size"),
                       F.xxhash64(F.col(f"`{doc_id}`"), F.col(f"`{size}`")).alias("tie"))
    band = F.when(F.col("size") > 0, F.length(F.conv(F.col("size"), 10, 2))).otherwise(0)
    cells = materialise(bare.groupBy("source", band.alias("band")).agg(
        F.sum("size").alias("n"), F.count(F.lit(1)).alias("docs")), "cells")
    # at most 64 cells per source
    tokens = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.coalesce(F.get(
        F.map_values(F.map_filter("m", lambda k, v: k == i)), F.lit(0)), F.lit(0)))
    sources = cells.groupBy("source").agg(
        F.sum("n").alias("size"), F.sum("docs").alias("docs"),
        F.map_from_entries(F.collect_list(F.struct("band", "n"))).alias("m"))
    ordered = in_order(sources.select("source", "size", "docs", tokens.alias("tokens")), "source")
    order = F.array(*[F.lit(int(w)) for w in weights])
    weighted = materialise(ordered.withColumn("weight", F.get(order, (F.col("position") % len(weights)).cast("int"))), "sources")
    targets = materialise(share_out(weighted, cap), "targets")
    mu = balance(targets, float(cap))

    def tilts(batches):
        for batch in batches:
            values = np.array(batch.column("tokens").to_pylist(), float).reshape(-1, BANDS)
            lam = source_tilts(values, batch.column("target").to_numpy(), mu, float(cap))
            rates = np.minimum(float(cap), np.exp(lam[:, None] + mu))
            rates[batch.column("target").to_numpy() >= cap * values.sum(1)] = cap
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("source", "size", "docs", "target")],
                                              pa.array(list(rates), pa.list_(pa.float64()))],
                                             ["source", "source_size", "docs", "target", "rates"])

    rates = materialise(targets.select("source", "size", "docs", "target", "tokens").mapInArrow(
        tilts, "source string, source_size bigint, docs bigint, target double, rates array<double>"), "rates")
    joined = bare.join(rates.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
    rated = joined.select("row", "source", "size", "tie", F.get("rates", band).alias("rate"), F.struct(
        "source_size", "target").alias("of"), F.pmod("tie", F.ceil(F.col("docs") / BUCKET)).alias("bucket"))
    # only ids that repeat very often crowd a bucket
    crowded = materialise(rated.groupBy("source", "bucket").agg(F.count(F.lit(1)).alias("n")).where(
        F.col("n") > CROWDED).select(F.struct("source", "bucket", "n").alias("c")), "crowded")
    rated = rated.join(crowded, F.col("source").eqNullSafe(F.col("c.source")) & (F.col("bucket") == F.col("c.bucket")), "left")
    part = F.coalesce(F.pmod(F.xxhash64("row"), F.ceil(F.col("c.n") / BUCKET)), F.lit(0))

    def round_group(group: pa.Table) -> pa.Table:
        return pa.table({"row": group.column("row"), "source_size": group.column("source_size"),
                         "target": group.column("target"), "rate": group.column("rate"),
                         "copies": rounded(group, cap)})

    copies = rated.select("row", "source", "bucket", part.alias("part"), "size", "tie", "rate", "of.*").groupBy(
        "source", "bucket", "part").applyInArrow(
        round_group, "row bigint, source_size bigint, target double, rate double, copies bigint")
    m = fresh("_mix", [*columns, row])
    taken = copies.select(F.struct("row", "source_size", "target", "rate", "copies").alias(m))
    result = docs.join(taken, F.col(row) == F.col(f"{m}.row")).select(
        *[F.col(f"`{c}`") for c in columns], F.struct(
            f"{m}.source_size", f"{m}.target", f"{m}.rate", f"{m}.copies",
            (F.col(f"{m}.copies") * F.col(f"`{size}`")).alias("taken")).alias(out))
    discard(weighted, cells)
    return result


def mixed(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """The mix itself: every document as often as it is taken."""
    size, out, nth = (fresh(c, docs.columns) for c in ("_size", "_mix_of", "_nth"))
    chosen = mix(docs.withColumn(size, words(F.col(f"`{text}`"))), size=size, out=out, **options)
    times = chosen.where(f"{out}.copies > 0").withColumn(nth, F.explode(F.sequence(F.lit(1), F.col(f"{out}.copies"))))
    return times.select(*[F.col(f"`{c}`") for c in docs.columns])
