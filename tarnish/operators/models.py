"""Model evaluation: features, splits, MLlib models, one record per configuration."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from contextvars import copy_context
from dataclasses import dataclass, field
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Pipeline, Transformer
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest
from pyspark.ml.feature import (PCA, ElementwiseProduct, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tarnish.operators import metrics
from tarnish.operators.encoders import auto_type_columns, encode, high_cardinality_columns, packed_hashes
from tarnish.operators.reduction import packed_svd
from tarnish.operators.splits import stratified_kfold
from tarnish.session import materialise

# Model names used in result tables.
LINEAR = ("LogisticRegression", "LinearRegression")
BOOSTED = ("GradientBoostingClassifier", "GradientBoostingRegressor")
# Encoder families whose vectors are already short.
SHORT_VECTORS = ("skrub", "fasttext__")
FEATURES = ("all", "text_only", "rest_only")


def make_model(name: str, n_classes: int = 2, trees: int = 100):
    """Estimator for a model name; boosting of several classes is one-vs-rest."""
    if name == "LogisticRegression":
        return UnitLogistic()
    if name == "LinearRegression":
        return LinearRegression(labelCol="y")
    if name == "GradientBoostingRegressor":
        return GBTRegressor(maxIter=trees, maxDepth=3, stepSize=0.1, labelCol="y", seed=42)
    if name == "GradientBoostingClassifier":
        one = GBTClassifier(maxIter=trees, maxDepth=3, stepSize=0.1, labelCol="y", seed=42)
        return one if n_classes <= 2 else OneVsRest(classifier=one, labelCol="y")
    raise ValueError(f"unknown model {name!r}")


class UnitLogistic(Estimator):
    """Logistic regression with inverse penalty C = 1 on the features as they are.

    MLlib averages the loss over rows, so the penalty is divided by their number. It scales features
    by their deviation and the penalty back, which fails on features that hold nothing but rounding,
    such as the components of a reduction beyond the rank: those count as zero.
    """

    def _fit(self, df: DataFrame):
        found = df.select(Summarizer.metrics("count", "std").summary(F.col("features")).alias("s")).first().s
        std = found.std.toArray()
        model = LogisticRegression(maxIter=100, regParam=1.0 / max(1, found["count"]), standardization=False, labelCol="y")
        real = std > 1e-9 * std.max(initial=0.0)
        if real.all() or not real.any():
            return model.fit(df)
        mask = ElementwiseProduct(scalingVec=Vectors.dense(real.astype(float)), inputCol="features", outputCol="features_kept")
        return Pipeline(stages=[mask, model.setFeaturesCol("features_kept")]).fit(df)


class PopulationScaler(Estimator):
    """z-scores of number columns as a vector, with the population deviation of the fitted rows;
    a constant column is only centred."""

    def __init__(self, columns: list[str], out: str):
        super().__init__()
        self.columns, self.out = columns, out

    def _fit(self, df: DataFrame) -> "ScaledNumbers":
        stats = df.agg(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")) for c in self.columns]).first()
        return ScaledNumbers(self.columns, self.out, [(s.m or 0.0, s.s or 1.0) for s in stats])


class ScaledNumbers(Transformer):
    def __init__(self, columns: list[str], out: str, stats: list[tuple[float, float]]):
        super().__init__()
        self.columns, self.out, self.stats = columns, out, stats

    def _transform(self, df: DataFrame) -> DataFrame:
        z = [(F.col(c).cast("double") - m) / s for c, (m, s) in zip(self.columns, self.stats)]
        return df.withColumn(self.out, array_to_vector(F.array(*z)))


def pairing_allowed(reduction: Column, model: Column, encoding: Column,
                    exempt: tuple[str, ...] = SHORT_VECTORS) -> Column:
    """Combinations worth running.

    Full-length vectors only go to linear models, unless their family is ``exempt``; min-hash is
    never reduced. Ensembles exempt min-hash alone.
    """
    short = reduce(lambda a, b: a | b, [encoding.startswith(p) for p in exempt])
    full = reduction == "passthrough"
    return ~(full & ~model.isin(*LINEAR) & ~short) & ~(~full & encoding.startswith(SHORT_VECTORS[0]))


def pairing_rules(grid: DataFrame, exempt: tuple[str, ...] = SHORT_VECTORS) -> DataFrame:
    return grid.where(pairing_allowed(F.col("dim_reduction"), F.col("model"), F.col("encoding"), exempt))


@dataclass
class Features:
    """Which columns feed a model, by kind.

    ``vectors`` are array columns; ``reductions`` maps some of them to a component count.
    """

    vectors: list[str] = field(default_factory=list)
    numbers: list[str] = field(default_factory=list)
    categories: list[str] = field(default_factory=list)
    reductions: dict[str, int] = field(default_factory=dict)

    def regime(self, name: str, text: list[str]) -> "Features":
        """``all``, only the encoded ``text`` columns, or only the others."""
        if name == "all":
            return self
        if name not in FEATURES:
            raise ValueError(f"features should be one of {FEATURES}")
        keep = [v for v in self.vectors if (v in text) == (name == "text_only")]
        rest = name == "rest_only"
        return Features(keep, self.numbers if rest else [], self.categories if rest else [],
                        {v: k for v, k in self.reductions.items() if v in keep})

    def stages(self, scale: bool) -> list:
        """Pipeline stages ending in the column ``features``; all are fitted on training rows."""
        out, inputs = [], []
        for v in self.vectors:
            if v in self.reductions:
                out += [StandardScaler(withMean=True, withStd=False, inputCol=v, outputCol=f"{v}_c"),
                        PCA(k=self.reductions[v], inputCol=f"{v}_c", outputCol=f"{v}_r")]
                inputs.append(f"{v}_r")
            else:
                inputs.append(v)
        for c in self.categories:
            # an unknown category gets the slot that the encoder drops: all zeros
            out += [StringIndexer(inputCol=c, outputCol=f"{c}_i", handleInvalid="keep"),
                    OneHotEncoder(inputCols=[f"{c}_i"], outputCols=[f"{c}_h"], dropLast=True)]
            inputs.append(f"{c}_h")
        if self.numbers and scale:
            out.append(PopulationScaler(self.numbers, "_scaled"))
            inputs.append("_scaled")
        elif self.numbers:
            inputs += self.numbers
        return [*out, VectorAssembler(inputCols=inputs, outputCol="features")]


def date_parts(c: str) -> dict[str, Column]:
    """Year, month, day and seconds since 1970 of a date or time column."""
    return {f"{c}_year": F.year(c), f"{c}_month": F.month(c), f"{c}_day": F.dayofmonth(c),
            f"{c}_total_seconds": F.unix_seconds(F.col(c).cast("timestamp"))}


def table_vectorizer(df: DataFrame, columns: list[str], threshold: int = 30, components: int = 10,
                     hashing: str = "fast") -> tuple[DataFrame, Features]:
    """Route columns by type: numbers as they are, truth values as 0 and 1, dates by their parts,
    few categories one-hot, many by min-hash. Text that looks like numbers or dates throughout is
    cast first; a column of any other type is refused.

    Min-hash needs no fitting, so those columns are encoded here; the rest is left to the stages.
    """
    df = auto_type_columns(df, [c for c in columns if isinstance(df.schema[c].dataType, T.StringType)])
    types = {f.name: f.dataType for f in df.schema.fields}
    numbers = []
    for c in columns:
        if isinstance(types[c], T.BooleanType):
            df = df.withColumn(c, F.col(c).cast("double"))
            numbers.append(c)
        elif isinstance(types[c], (T.DateType, T.TimestampType, T.TimestampNTZType)):
            parts = date_parts(c)
            df = df.withColumns({n: p.cast("double") for n, p in parts.items()})
            numbers += parts
        elif isinstance(types[c], T.NumericType):
            numbers.append(c)
        elif not isinstance(types[c], T.StringType):
            raise TypeError(f"column {c!r} of type {types[c].simpleString()} can't be a feature")
    texts = [c for c in columns if isinstance(types[c], T.StringType)]
    high = {r["name"] for r in high_cardinality_columns(df, threshold, texts).where("high").collect()
            } if texts else set()
    for c in sorted(high):
        df = encode(df, c, f"skrub__minhash_{components}", f"{c}_mh", hashing=hashing).withColumn(
            f"{c}_mh", array_to_vector(f"{c}_mh"))
    return df, Features([f"{c}_mh" for c in sorted(high)], numbers,
                        [c for c in texts if c not in high])


def with_vectors(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: array_to_vector(F.col(c).cast("array<double>")) for c in columns})


@dataclass
class Placed:
    """Rows with the splits they train and test in, ``_train`` and ``_test``, written once: a part of
    any split is a filter of ``data`` then, and no fit joins anything. Several evaluations of the
    same rows and splits share one."""

    data: DataFrame
    ids: list[int]
    sizes: dict[str, int]

    @classmethod
    def of(cls, df: DataFrame, row_id: str, splits: DataFrame) -> "Placed":
        splits = materialise(splits, "splits")
        ids = _split_ids(splits)
        roles = splits.groupBy(F.col(row_id).alias("_row")).agg(*[
            F.collect_set(F.when(F.col("role") == r, F.col("split_id"))).alias(f"_{r}") for r in ("train", "test")])
        # a row in no split is of no use here
        data = materialise(df.join(roles, F.col(row_id) == F.col("_row")).drop("_row"), "features")
        return cls(data, ids, split_sizes(splits, ids))

    def part(self, split: int, role: str) -> DataFrame:
        return self.data.where(F.array_contains(f"_{role}", F.lit(split))).drop("_train", "_test")


def _probabilities(df: DataFrame, n_classes: int) -> DataFrame:
    """Class scores as an array, whatever the model offers."""
    if "probability" in df.columns:
        return df.withColumn("p", vector_to_array("probability"))
    if "rawPrediction" in df.columns:
        return df.withColumn("p", vector_to_array("rawPrediction"))
    return df.withColumn("p", F.array(F.col("prediction")))


def cross_predict(placed: Placed, row_id: str, fit: Callable[[DataFrame], object], n_classes: int) -> DataFrame:
    """Predictions of every test part: ``(split_id, row_id, y, prediction, p)``."""
    def one(s: int) -> DataFrame:
        model = fit(placed.part(s, "train"))
        test = model.transform(placed.part(s, "test"))
        return _probabilities(test, n_classes).select(F.lit(s).alias("split_id"), row_id, "y", "prediction", "p")

    return materialise(reduce(DataFrame.unionByName, side_by_side(one, placed.ids)), "predictions")


def side_by_side(work: Callable[[int], DataFrame], splits: list[int], threads: int = 8) -> list[DataFrame]:
    """The splits' fits at the same time: each is a chain of small jobs that leaves cores idle."""
    with ThreadPoolExecutor(min(threads, max(1, len(splits)))) as pool:
        # every thread sees the caller's scratch scopes
        runs = [pool.submit(inheritable_thread_target(copy_context().run), work, s) for s in splits]
        return [r.result() for r in runs]


def score(predictions: DataFrame, regression: bool, n_classes: int) -> DataFrame:
    """One row per split with the metrics of the task."""
    keys = ["split_id"]
    if regression:
        return metrics.regression_scores(predictions, keys, "y", "prediction")
    acc = metrics.accuracy(predictions, keys, "y", "prediction").withColumnRenamed(
        "accuracy", "accuracies")
    if n_classes <= 2:
        hit = predictions.withColumn("s", F.element_at("p", -1))
        auc = metrics.roc_auc(hit, keys, "y", "s")
    else:
        auc = metrics.roc_auc_ovr(predictions, keys, "y", "p", n_classes)
    return acc.join(auc, keys)


def to_record(scores: DataFrame, labels: dict[str, str | int]) -> DataFrame:
    """One row per configuration: its labels and one array per metric, an element per split."""
    names = [c for c in scores.columns if c != "split_id"]
    listed = F.sort_array(F.collect_list(F.struct("split_id", *names)))
    one = scores.agg(listed.alias("s"))
    return one.select(*[F.lit(v).alias(k) for k, v in labels.items()],
                      *[F.col(f"s.{n}").alias(n) for n in names])


def fold_metrics_table(records: DataFrame, metrics_columns: list[str]) -> DataFrame:
    """One row per configuration and fold."""
    from tarnish.operators.tables import explode_parallel
    return explode_parallel(records, metrics_columns)


def _split_ids(splits: DataFrame) -> list[int]:
    return [r["split_id"] for r in splits.select("split_id").distinct().orderBy("split_id").collect()]


def evaluate_encoding(df: DataFrame | Placed, row_id: str, features: Features, splits: DataFrame | None,
                      model_name: str, labels: dict, regression: bool = False,
                      n_classes: int = 2, trees: int = 100) -> DataFrame:
    """Fit and score one configuration on every split; returns its record, with the rows of its
    first split. A combination that the pairing rules exclude is refused. Rows that are ``Placed``
    already bring their splits."""
    refuse_excluded(labels, model_name)
    placed = df if isinstance(df, Placed) else Placed.of(df, row_id, splits)
    estimator = make_model(model_name, n_classes, trees)
    stages = [*features.stages(model_name in LINEAR), estimator]
    predictions = cross_predict(placed, row_id, lambda train: Pipeline(stages=stages).fit(train), n_classes)
    return to_record(score(predictions, regression, n_classes), {
        **labels, "model": model_name, **placed.sizes})


def split_sizes(splits: DataFrame, ids: list[int]) -> dict[str, int]:
    """``n_train`` and ``n_test`` of the first split."""
    counts = {r.role: r["count"] for r in splits.where(F.col("split_id") == ids[0]).groupBy("role").count().collect()} if ids else {}
    return {f"n_{role}": counts.get(role, 0) for role in ("train", "test")}


def refuse_excluded(labels: dict, model_name: str, exempt: tuple[str, ...] = SHORT_VECTORS) -> None:
    """The pairing rules for one configuration that names its encoding and its reduction."""
    encoding, reduction = labels.get("encoding"), labels.get("dim_reduction")
    if encoding is None or reduction is None:
        return
    full, short = reduction == "passthrough", str(encoding).startswith(exempt)
    if (full and model_name not in LINEAR and not short) or (not full and str(encoding).startswith(SHORT_VECTORS[0])):
        raise ValueError(f"{encoding} with {reduction} is not to be run with {model_name}")


def reduction_names(features: Features, text: list[str]) -> str:
    """Label of the reductions, one per encoded column."""
    names = [f"PCA_{features.reductions[v]}" if v in features.reductions else "passthrough"
             for v in text]
    return "+".join(names)


class _Average:
    """Two fitted pipelines voting with the mean of their class probabilities."""

    def __init__(self, row_id: str, models: list):
        self.row_id, self.models = row_id, models

    def transform(self, df: DataFrame) -> DataFrame:
        both = _votes(df, self.models).select(self.row_id, "y", F.zip_with(
            "_p0", "_p1", lambda x, y: (x + y) / 2).alias("p"))
        best = F.array_position("p", F.array_max("p")) - 1
        return both.withColumn("prediction", best.cast("double")).withColumn(
            "probability", array_to_vector("p"))


def _votes(df: DataFrame, models: list) -> DataFrame:
    """The rows with the class probabilities of every model, ``_p0``, ``_p1``, ...: one model reads
    what the other leaves, so nothing is joined."""
    out = df
    for i, m in enumerate(models):
        out = _probabilities(m.transform(out), 2).withColumn(f"_p{i}", F.col("p")).select(
            *df.columns, *[f"_p{j}" for j in range(i + 1)])
    return out


class _Stacked:
    """Two fitted pipelines whose probabilities feed a fitted meta model."""

    def __init__(self, row_id: str, models: list, meta):
        self.row_id, self.models, self.meta = row_id, models, meta

    def transform(self, df: DataFrame) -> DataFrame:
        return self.meta.transform(stack_inputs(df, self.row_id, self.models))


def stack_inputs(df: DataFrame, row_id: str, models: list) -> DataFrame:
    """``(row_id, y, features)``: class probabilities of every model, the first class left out."""
    others = [F.slice(f"_p{i}", F.lit(2), F.size(f"_p{i}") - 1) for i in range(len(models))]
    return _votes(df, models).select(row_id, "y", array_to_vector(F.concat(*others)).alias("features"))


def evaluate_ensemble(df: DataFrame | Placed, row_id: str, text: Features, rest: Features,
                      splits: DataFrame | None, text_model: str, rest_model: str, aggregation: str,
                      labels: dict, n_classes: int = 2, trees: int = 100,
                      inner_folds: int = 5) -> DataFrame:
    """A model on the encoded text and one on the other columns, combined.

    ``voting`` averages probabilities; ``stacking`` fits a logistic model on out-of-fold
    probabilities of the training rows.
    """
    for name in (text_model, rest_model):
        refuse_excluded(labels, name, exempt=SHORT_VECTORS[:1])
    placed = df if isinstance(df, Placed) else Placed.of(df, row_id, splits)
    pipelines = [
        Pipeline(stages=[*f.stages(m in LINEAR), make_model(m, n_classes, trees)])
        for f, m in ((text, text_model), (rest, rest_model))]

    def voting(train: DataFrame):
        return _Average(row_id, [p.fit(train) for p in pipelines])

    def stacking(train: DataFrame):
        folds = materialise(stratified_kfold(train, "y", row_id, inner_folds), "folds")
        outside = []
        for f in range(inner_folds):
            inner = [p.fit(folds.where(F.col("fold") != f)) for p in pipelines]
            outside.append(stack_inputs(folds.where(F.col("fold") == f), row_id, inner))
        # read many times by the fit
        meta = UnitLogistic().fit(materialise(reduce(DataFrame.unionByName, outside), "stacked"))
        return _Stacked(row_id, [p.fit(train) for p in pipelines], meta)

    if aggregation not in ("voting", "stacking"):
        raise ValueError("aggregation should be 'voting' or 'stacking'")
    predictions = cross_predict(placed, row_id, voting if aggregation == "voting" else stacking, n_classes)
    return to_record(score(predictions, False, n_classes), {
        **labels, "enc_model": text_model, "rest_model": rest_model, "aggregation": aggregation})


def evaluate_ngram_matrix(df: DataFrame, row_id: str, texts: list[str], rest: list[str],
                          splits: DataFrame, model_name: str, labels: dict, analyzer: str = "char",
                          ngram_range: tuple[int, int] = (2, 3), components: int = 30,
                          tfidf: bool = False, fit_on: str = "train", features: str = "all",
                          dimensions: int = 2 ** 14, trees: int = 100) -> DataFrame:
    """Hashed n-gram counts or TF-IDF, truncated SVD per column and split, then a model.

    ``fit_on="all"`` takes document frequencies from all rows. AUC comes both from class scores
    (``roc_auc``) and from hard labels (``roc_auc_hard``).
    """
    base, routed = table_vectorizer(df, rest) if features == "all" else (df, Features())
    # the texts themselves are not needed again
    base = materialise(base.drop(*[c for c in texts if c not in rest]), "base")
    splits = materialise(splits, "splits")
    placed = splits.groupBy(row_id).agg(
        F.collect_set("split_id").alias("_in"), F.collect_set(F.when(F.col("role") == "train", F.col("split_id"))).alias("_fit"))
    # written once for all splits
    packed = {c: materialise(packed_hashes(df, row_id, c, analyzer, ngram_range, dimensions).join(placed, row_id), "ngrams")
              for c in texts}

    def one(s: int) -> DataFrame:
        mine = splits.where(F.col("split_id") == s).select(row_id, "role")
        data, used = base.join(mine, row_id), list(routed.vectors)
        for c, rows in packed.items():
            rows = rows.where(F.array_contains("_in", s)).withColumn("fit", F.array_contains("_fit", s))
            factors = _idf(rows.where("fit") if fit_on == "train" else rows) if tfidf else None
            reduced = packed_svd(rows, row_id, components, dimensions=dimensions, factors=factors)
            zeros = F.array_repeat(F.lit(0.0), components)
            data = data.join(reduced.withColumnRenamed("v", f"{c}_svd"), row_id, "left").withColumn(
                f"{c}_svd", array_to_vector(F.coalesce(f"{c}_svd", zeros)))
            used.append(f"{c}_svd")
        data = materialise(data, "fold")
        stages = Features(used, routed.numbers, routed.categories).stages(model_name in LINEAR)
        model = Pipeline(stages=[*stages, make_model(model_name, 2, trees)]).fit(
            data.where("role = 'train'"))
        test = _probabilities(model.transform(data.where("role = 'test'")), 2)
        return test.select(F.lit(s).alias("split_id"), row_id, "y", "prediction", "p")

    predictions = materialise(reduce(DataFrame.unionByName, side_by_side(one, _split_ids(splits))), "predictions")
    scores = score(predictions, False, 2).join(
        metrics.balanced_accuracy(predictions, ["split_id"], "y", "prediction"), "split_id")
    return to_record(scores, {**labels, "model": model_name, "features": features,
                              "analyzer": analyzer, "tfidf": str(tfidf),
                              "ngram_range": str(ngram_range)})


def _idf(rows: DataFrame) -> dict[int, float]:
    """Inverse document frequency by hashed dimension, of which there is a fixed number."""
    n = rows.count()
    df = rows.select(F.explode("dims").alias("dim")).groupBy("dim").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log((F.lit(1.0) + F.lit(n)) / (F.lit(1.0) + F.col("df"))) + 1.0
    return {r.dim: r.idf for r in df.select("dim", idf.alias("idf")).collect()}


def column_replacement_ablation(df: DataFrame, row_id: str, columns: list[str],
                                other: list[str], base_spec: str, new_spec: str,
                                splits: DataFrame, model_name: str, labels: dict,
                                n_train: int, n_test: int, models=None, components: int = 30,
                                trees: int = 100) -> DataFrame:
    """For each text column: swap its encoder (or drop it), keep the others, evaluate.

    ``no_column`` keeps the base encoder everywhere. Every encoding is computed once and shared
    by all configurations.
    """
    if df.count() < n_train + n_test:
        raise ValueError("not enough rows for the split")
    data, rest = table_vectorizer(df, other)
    for c in columns:
        data = encode(data, c, base_spec, f"{c}_base", models)
        if new_spec != "drop":
            data = encode(data, c, new_spec, f"{c}_new", models)
    names = [f"{c}_{k}" for c in columns for k in (("base", "new") if new_spec != "drop" else ("base",))]
    # all configurations read the same rows and splits
    placed = Placed.of(with_vectors(data, names), row_id, splits)
    records = []
    for replaced in [*columns, "no_column"]:
        vectors, reductions = [], {}
        for c in columns:
            if c != replaced:
                vectors.append(f"{c}_base")
            elif new_spec != "drop":
                vectors.append(f"{c}_new")
                reductions[f"{c}_new"] = components
        both = Features([*vectors, *rest.vectors], rest.numbers, rest.categories, reductions)
        for regime in ("all", "text_only"):
            if regime == "text_only" and not vectors:
                continue
            records.append(evaluate_encoding(
                placed, row_id, both.regime(regime, vectors), None, model_name,
                {**labels, "base_encoder_name": base_spec, "new_encoder_name": new_spec,
                 "col_to_encode_with_new": replaced, "features": regime}, trees=trees))
    return reduce(DataFrame.unionByName, records)
