"""Whitening of embeddings, with eigenvectors refined from single to full precision.

Entries become whole numbers, so that counts, sums and deviations are exact. The model is fitted on
each distinct vector once: their number and sums come first, then the covariance of the centred
vectors, a partial matrix per task and summed by Spark; only numbers per dimension and per pair of
dimensions reach the driver. There the eigenvectors of the covariance are found in single
precision and corrected by the iterations of Ogita and Aishima, which consist of matrix products
in higher precision and converge quadratically. Eigenvalues too close to be told apart at the
precision reached so far form a cluster, and the small eigenproblem of the cluster's subspace,
with the cluster's middle taken off, is solved by itself.

Defined cases: a row whose vector is null, or holds null or a non-finite entry, is dropped, and so
is one whose length is not the most frequent one (of equally frequent lengths, the longest counts);
entries saturate at ``±2**40``; a deviation that a 64-bit number can't hold is null; a component
without variance gives null for ``whitened``, as a table of one vector gives null for the shares;
vectors without entries have no components and no rows, as an empty table; repeated rows and other
columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tarnish.llm.texts import fresh
from tarnish.session import materialise

SCALE, LARGEST = 256, 1 << 40
#: Corrections at most; each doubles the digits, so a handful is enough from single precision.
ROUNDS = 24
EXACT = np.longdouble


def quantised(vectors: pa.Array) -> pa.Array:
    """``floor(256 * c)`` of every entry as 64-bit numbers, or null for an unusable vector."""
    vectors = vectors.cast(pa.list_(pa.float64()))
    ends, usable = vectors.offsets.to_numpy(), vectors.is_valid().to_numpy(zero_copy_only=False)
    values = vectors.values.to_numpy(zero_copy_only=False)  # null entries become NaN
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    usable &= bad[ends[1:]] == bad[ends[:-1]]
    with np.errstate(invalid="ignore", over="ignore"):
        whole = np.clip(np.nan_to_num(np.floor(SCALE * values)), -LARGEST, LARGEST).astype("<i8")
    return pa.array([whole[a:b].tobytes() if ok else None for a, b, ok in zip(ends, ends[1:], usable)], pa.binary())


def matrix(column: pa.Array) -> np.ndarray:
    """The vectors of a batch, which have one length, as rows."""
    joined = b"".join(v.as_py() for v in column)
    return np.frombuffer(joined, "<i8").reshape(len(column), -1)


def norm(a: np.ndarray) -> np.floating:
    return np.sqrt((a * a).sum())


def close_runs(values: np.ndarray, gap: float) -> list[np.ndarray]:
    """Positions of ascending runs of ``values`` whose neighbours are at most ``gap`` apart."""
    order = np.argsort(values)
    cuts = np.flatnonzero(np.diff(values[order]) > gap) + 1
    return [run for run in np.split(order, cuts) if len(run) > 1]


def corrected(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
    """One correction: new vectors, eigenvalues, the bound under which they are a cluster, and the
    largest change."""
    r = np.eye(len(a), dtype=x.dtype) - x.T @ x
    s = x.T @ (a @ x)
    values = np.diag(s) / (1 - np.diag(r))
    bound = 2 * (norm(s - np.diag(values)) + norm(a) * norm(r))
    gaps = values[None, :] - values[:, None]
    apart = np.abs(gaps) > bound
    e = np.where(apart, (s + values[None, :] * r) / np.where(apart, gaps, 1), r / 2)
    return x + x @ e, values, bound, np.abs(e).max(initial=0)


def solved_clusters(a: np.ndarray, x: np.ndarray, values: np.ndarray, bound: float) -> np.ndarray:
    """Turn the vectors of each cluster inside their subspace to the eigenvectors there."""
    x = x.copy()
    for run in close_runs(values, bound):
        own = x[:, run]
        small = own.T @ (a @ own - values[run].mean() * own)
        size = np.abs(small).max()
        if size > 0:
            x[:, run] = own @ np.linalg.eigh(((small + small.T) / (2 * size)).astype(np.float64))[1].astype(x.dtype)
    return x


def eigenvectors(covariance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns, to double precision."""
    size = np.abs(covariance).max(initial=0)
    if not size:
        return np.zeros(len(covariance)), np.eye(len(covariance))
    a = (covariance / size).astype(EXACT)
    a = (a + a.T) / 2
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(EXACT)
    least, idle = np.inf, 0
    for _ in range(ROUNDS):
        x, values, bound, change = corrected(a, x)
        x = solved_clusters(a, x, values, bound)
        # no more digits to gain once the changes stay as they are
        idle = 0 if change < least / 2 else idle + 1
        least = min(least, change)
        if change < 1e-17 or idle == 3:
            break
    for _ in range(2):  # small gaps magnify rounding; what that did to right angles is mended here
        x = x + x @ (np.eye(len(a), dtype=EXACT) - x.T @ x) / 2
    x /= np.sqrt((x * x).sum(axis=0))
    values = np.einsum("ij,ij->j", x, a @ x)
    order = np.argsort(-values, kind="stable")
    x = x[:, order]
    x = x * np.where(x[np.abs(x).argmax(axis=0), np.arange(len(a))] < 0, -1, 1)  # the largest entry is positive
    return (values[order] * size).astype(np.float64), x.astype(np.float64)


@dataclass(frozen=True)
class Whitening:
    """``sums`` are over the ``n`` distinct vectors, as whole numbers; ``axes`` has a column per component."""

    n: int
    sums: list[int]
    values: np.ndarray
    axes: np.ndarray
    trace: float

    def scales(self, k: int) -> np.ndarray:
        """Root of each component's variance; NaN where that is no more than rounding."""
        values = self.values[:k]
        real = values > self.trace * len(self.sums) * np.finfo(float).eps
        return np.sqrt(np.where(real, values, np.nan))

    def centred(self, x: np.ndarray) -> np.ndarray:
        """``n * x - sums``, exact: as 64-bit numbers, or as Python's where those could not hold it."""
        bound = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums))
        if bound * bound * x.shape[1] < 1 << 63:
            return self.n * x - np.array(self.sums, np.int64)
        return self.n * x.astype(object) - np.array(self.sums, object)

    def projected(self, x: np.ndarray, k: int) -> tuple[list[int], np.ndarray]:
        """Exact deviations, and the first ``k`` whitened coordinates."""
        y = self.centred(x)
        deviation = (y * y).sum(axis=1)
        return deviation.tolist(), (y / self.n).astype(np.float64) @ (self.axes[:, :k] / self.scales(k))


def sums_of(vectors: DataFrame, dimensions: int) -> tuple[int, list[int]]:
    """Number and sum of the vectors, exact: a row per dimension and batch, summed by Spark."""
    def add(batches):
        for batch in batches:
            x = matrix(batch.column(0))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.arange(-1, dimensions), pa.int32()), pa.array(np.concatenate([[len(x)], x.sum(axis=0)]))], ["i", "s"])

    total = vectors.mapInArrow(add, "i int, s bigint").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    sums = {r.i: int(r.s) for r in total.collect()}  # a row per dimension
    return sums.get(-1, 0), [sums.get(i, 0) for i in range(dimensions)]


def covariance_of(vectors: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """Covariance with divisor ``n``: centred products, a matrix per task, summed pair by pair."""
    d = len(sums)
    mean, (rows, columns) = np.array([s / n for s in sums]), np.triu_indices(d)

    def multiply(batches):
        total = np.zeros((d, d))
        for batch in batches:
            y = matrix(batch.column(0)) - mean
            total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(columns, pa.int32()), pa.array(total[rows, columns])],
                                         ["i", "j", "v"])

    out = np.zeros((d, d))
    pairs = vectors.mapInArrow(multiply, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    i, j = (pairs.column(c).to_numpy() for c in "ij")
    out[i, j] = out[j, i] = pairs.column("v").to_numpy() / n
    return out


def quantise(vector: Column) -> Column:
    return F.arrow_udf(quantised, "binary")(vector.cast("array<double>"))


def fit(distinct: DataFrame, dimensions: int) -> Whitening | None:
    """From the distinct quantised vectors, all of ``dimensions`` entries, in one column."""
    n, sums = sums_of(distinct, dimensions)
    if not n or not dimensions:
        return None
    covariance = covariance_of(distinct, n, sums)
    values, axes = eigenvectors(covariance)
    return Whitening(n, sums, values, axes, float(np.trace(covariance)))


def identity_error(distinct: DataFrame, model: Whitening, k: int) -> float | None:
    """Largest entry of the whitened vectors' covariance less the identity, measured on them."""
    def coordinates(column: pa.Array) -> pa.Array:
        return pa.array(list(model.projected(matrix(column), k)[1]), pa.list_(pa.float64()))

    k = min(k, len(model.sums))
    w = distinct.select(F.arrow_udf(coordinates, "array<double>")(distinct.columns[0]).alias("w"))
    # Spark's covariance is centred as it goes
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    found = w.agg(*[F.covar_pop(F.col("w")[i], F.col("w")[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    errors = [abs(found[f"c{i}_{j}"] - (i == j)) for i, j in pairs]
    return None if any(np.isnan(errors)) else max(errors)


def whiten(rows: DataFrame, vector: str = "embedding", k: int = 4, out: str = "whitening") -> DataFrame:
    """A row for each usable row and each of its first ``k`` components: the columns of ``rows`` but
    the vector, and a struct ``out`` of ``component`` (from 1), ``n``, ``deviation``, ``whitened``,
    ``explained`` and ``identity_error``."""
    columns = [c for c in rows.columns if c not in (vector, out)]
    x = fresh("_x", columns)
    marked = materialise(rows.select(*[F.col(f"`{c}`") for c in columns], quantise(F.col(f"`{vector}`")).alias(x)).where(
        F.col(x).isNotNull()), "quantised")
    # a row per length that occurs; the first of them is all that is fetched
    length = marked.groupBy(F.length(x).alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    marked = marked.where(F.length(x) == (length.n if length else 0))
    distinct = materialise(marked.select(x).distinct(), "distinct")
    model = fit(distinct, length.n // 8 if length else 0)
    kind = "struct<component:int,n:bigint,deviation:bigint,whitened:double,explained:double,identity_error:double>"
    if model is None:
        return marked.where("false").select(*[F.col(f"`{c}`") for c in columns], F.lit(None).cast(kind).alias(out))
    k = min(k, len(model.sums))
    error = identity_error(distinct, model, k)

    def project(vectors: pa.Array) -> pa.Array:
        deviation, w = model.projected(matrix(vectors), k)
        flat = pa.array(w.ravel(), from_pandas=True)  # NaN is null
        return pa.StructArray.from_arrays([
            pa.array([x if x < 1 << 63 else None for x in deviation], pa.int64()),
            pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, k), pa.int32()), flat)], ["deviation", "w"])

    p, at, w = (fresh(c, [*columns, x]) for c in ("_projected", "_at", "_w"))
    each = marked.select(*[F.col(f"`{c}`") for c in columns], F.arrow_udf(project, "struct<deviation:bigint,w:array<double>>")(x).alias(p))
    each = each.select(*[F.col(f"`{c}`") for c in columns], F.col(f"{p}.deviation").alias(p), F.posexplode(f"{p}.w").alias(at, w))
    shares = F.array(*[F.lit(float(v) / model.trace if model.trace > 0 else None).cast("double") for v in model.values[:k]])
    return each.select(*[F.col(f"`{c}`") for c in columns], F.struct(
        (F.col(at) + 1).alias("component"), F.lit(model.n).cast("bigint").alias("n"), F.col(p).alias("deviation"),
        F.col(w).alias("whitened"), F.get(shares, F.col(at)).alias("explained"),
        F.lit(error).cast("double").alias("identity_error")).cast(kind).alias(out))
