"""Dimension reduction: PCA and truncated SVD."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA, ElementwiseProduct, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tarnish.functions.grams import portions
from tarnish.session import materialise


def pca_reduce(df: DataFrame, v: str, k: int, train: Column | None = None,
               centre: str = "train") -> DataFrame:
    """Replace an array column by its first ``k`` principal components.

    Fitted on the training rows. MLlib does not centre when it transforms, so rows are centred
    first: by the mean of the training rows or, with ``centre="batch"``, by the mean of the rows
    being transformed (training and other rows apart). Component signs are fixed: the largest
    loading is positive.
    """
    flag = F.lit(True) if train is None else train
    rows = df.withColumn("_train", flag).withColumn(
        "_x", array_to_vector(F.col(v).cast("array<double>")))
    scaler = StandardScaler(withMean=True, withStd=False, inputCol="_x", outputCol="_c")
    centred = scaler.fit(rows.where("_train"))
    model = PCA(k=k, inputCol="_c", outputCol="_p").fit(centred.transform(rows.where("_train")))
    # the loadings are dimensions x k, whatever the number of rows
    loadings = model.pc.toArray()
    signs = np.sign(loadings[np.abs(loadings).argmax(0), np.arange(k)])
    flip = ElementwiseProduct(scalingVec=Vectors.dense(signs), inputCol="_p", outputCol="_s")

    def apply(part: DataFrame, by) -> DataFrame:
        return flip.transform(model.transform(by.transform(part)))

    if centre == "batch":
        other = rows.where("not _train")
        out = apply(rows.where("_train"), centred)
        if train is not None and not other.isEmpty():
            out = out.unionByName(apply(other, scaler.fit(other)))
    else:
        out = apply(rows, centred)
    return out.withColumn(v, vector_to_array("_s")).select(*df.columns)


# Entries of sparse rows that are multiplied at a time.
ENTRIES = 1 << 17

# Cells of a portion laid out as a dense matrix, unless a single row has more.
CELLS = 1 << 22


def packed_rows(long: DataFrame, row_id: str, train: Column | None = None) -> DataFrame:
    """``(row_id, dims, ws, fit)``: sparse rows ``(row_id, dim, w)``, each with all its entries."""
    fit = F.lit(True) if train is None else F.coalesce(train, F.lit(False))
    rows = long.groupBy(row_id).agg(F.collect_list(F.struct("dim", "w")).alias("e"), F.max(fit).alias("fit"))
    return rows.select(row_id, F.col("e.dim").alias("dims"), F.col("e.w").alias("ws"), "fit")


class SparseRows:
    """Products of packed rows ``(row_id, dims, ws, ...)`` with small matrices, a portion at a time.

    ``factors`` multiply the entries of each dimension, after which a row gets unit length; an entry
    of a dimension without a factor is dropped. A task adds up its own rows: what it gives back is as
    large as the small matrix, whatever the number of entries.
    """

    def __init__(self, rows: DataFrame, row_id: str, dims: list[int], factors: dict[int, float] | None = None):
        self.rows, self.row_id = rows, row_id
        top = max([*dims, *(factors or ())]) + 1
        index = np.full(top, -1)
        index[sorted(dims)] = np.arange(len(dims))
        scale = None if factors is None else np.zeros(top)
        if factors:
            scale[list(factors)] = list(factors.values())
        self.shared = rows.sparkSession.sparkContext.broadcast((index, scale))

    def _portions(self, basis):
        """Ids of a portion's rows, the places of its dimensions in the basis, the rows as a dense matrix
        over those, and its product with the basis. Rows without a known dimension are left out."""
        shared, name = self.shared, self.row_id

        def each(batches: Iterator[pd.DataFrame]):
            index, scale = shared.value
            # rows of a dense matrix over all dimensions
            least = max(1, -(-ENTRIES * len(basis.value) // CELLS))
            for pdf in batches:
                for cut in portions(np.maximum(pdf["dims"].map(len).to_numpy(), least), ENTRIES):
                    part = pdf.iloc[cut]
                    row = np.repeat(np.arange(len(part)), part["dims"].map(len))
                    d = np.concatenate(part["dims"].to_numpy()).astype("int64")
                    w = np.concatenate(part["ws"].to_numpy()).astype(float)
                    inside = d < len(index)
                    row, d, w = row[inside], d[inside], w[inside]
                    if scale is not None:
                        # the length counts every dimension that has a factor
                        w = w * scale[d]
                        norm = np.sqrt(np.bincount(row, w * w, len(part)))
                        w = w / np.where(norm > 0, norm, 1.0)[row]
                    keep = (index[d] >= 0) & (True if scale is None else scale[d] > 0)
                    row, at, w = row[keep], index[d[keep]], w[keep]
                    if not len(row):
                        continue
                    rows, row = np.unique(row, return_inverse=True)
                    held = np.flatnonzero(np.bincount(at))
                    place = np.zeros(held[-1] + 1, "int64")
                    place[held] = np.arange(len(held))
                    dense = np.bincount(row * len(held) + place[at], w, len(rows) * len(held)).reshape(len(rows), len(held))
                    yield part[name].to_numpy()[rows], held, dense, dense @ basis.value[held]
        return each

    def _summed(self, work, size: tuple[int, int], basis: np.ndarray) -> np.ndarray:
        """Sum over the fitted rows' tasks of the matrices that ``work`` adds to, row by row of the matrix."""
        spark = self.rows.sparkSession
        each = self._portions(spark.sparkContext.broadcast(basis))

        def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros(size)
            for portion in each(batches):
                work(total, portion)
            i = np.flatnonzero(total.any(1))
            yield pd.DataFrame({"i": i.astype("int32"), "b": list(total[i])})

        found = self.rows.where("fit").select(self.row_id, "dims", "ws").mapInPandas(task, "i int, b array<double>")
        sums = found.groupBy("i").agg(Summarizer.sum(array_to_vector("b")).alias("b"))
        out = np.zeros(size)
        for r in sums.collect():
            out[r["i"]] = r["b"].toArray()
        return out

    def back(self, basis: np.ndarray) -> np.ndarray:
        """``X^T X basis`` over the fitted rows."""
        def add(total, portion):
            _, held, dense, scores = portion
            total[held] += dense.T @ scores
        return self._summed(add, basis.shape, basis)

    def gram(self, basis: np.ndarray) -> np.ndarray:
        """``(X basis)^T (X basis)`` over the fitted rows."""
        def add(total, portion):
            total += portion[3].T @ portion[3]
        return self._summed(add, (basis.shape[1], basis.shape[1]), basis)

    def project(self, basis: np.ndarray) -> DataFrame:
        """``(row_id, v)``: every row that has a known dimension, times ``basis``."""
        each = self._portions(self.rows.sparkSession.sparkContext.broadcast(basis))
        name = self.row_id

        def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for ids, _, _, scores in each(batches):
                yield pd.DataFrame({name: ids, "v": list(scores)})

        schema = T.StructType([self.rows.schema[name], T.StructField("v", T.ArrayType(T.DoubleType()))])
        return self.rows.select(name, "dims", "ws").mapInPandas(task, schema)


def truncated_svd(long: DataFrame, row_id: str, k: int = 30, train: Column | None = None,
                  n_iter: int = 3, oversample: int = 10, dimensions: int = 2 ** 14) -> DataFrame:
    """``(row_id, v)``: projection of sparse rows ``(row_id, dim, w)`` on ``k`` singular vectors.

    Weights are n-gram weights, so never negative; ``train`` marks whole rows. No centring. Dimensions
    are hashed, so ``dim`` stays below ``dimensions``. See :func:`packed_svd`.
    """
    return packed_svd(materialise(packed_rows(long, row_id, train), "svd"), row_id, k, n_iter, oversample, dimensions)


def packed_svd(rows: DataFrame, row_id: str, k: int = 30, n_iter: int = 3, oversample: int = 10,
               dimensions: int = 2 ** 14, factors: dict[int, float] | None = None) -> DataFrame:
    """``(row_id, v)`` from written packed rows ``(row_id, dims, ws, fit)``; see :class:`SparseRows`.

    Randomised subspace iteration (Halko, Martinsson, Tropp 2011) over the rows marked ``fit``: each
    pass reads the rows once and adds up a ``dimensions x k`` matrix per task. No entry is shuffled;
    only the basis, of fixed size, visits the driver.
    """
    seen = rows.where("fit").select(F.explode("dims").alias("dim")).distinct()
    dims = [r["dim"] for r in seen.limit(dimensions + 1).collect()]
    if len(dims) > dimensions:
        raise ValueError(f"hash the n-grams into at most {dimensions} dimensions first")
    if not dims:
        return rows.select(row_id, F.lit(None).cast("array<double>").alias("v")).where("false")
    width = min(k + oversample, len(dims))
    basis = np.linalg.qr(np.random.default_rng(42).standard_normal((len(dims), width)))[0]
    x = SparseRows(rows, row_id, dims, factors)
    for _ in range(n_iter):
        basis = np.linalg.qr(x.back(basis))[0]
    # rotate the subspace to the singular vectors with the small matrix (X B)^T (X B)
    values, vectors = np.linalg.eigh(x.gram(basis))
    basis = basis @ vectors[:, np.argsort(values)[::-1][:k]]
    basis *= np.sign(basis[np.abs(basis).argmax(0), np.arange(basis.shape[1])])
    return x.project(basis)
