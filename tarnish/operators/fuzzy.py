"""Approximate join: every row of one table gets its single nearest row of the other."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tarnish.functions.text import ANALYZERS, key_text
from tarnish.operators.nearest import nearest_numeric, nearest_text, nearest_vectors
from tarnish.session import materialise

SCORE = "matching_score"


@dataclass(frozen=True)
class FuzzyMatches:
    """Result of the neighbour search, before any threshold is applied.

    ``frame`` has one row per main row: struct ``main``, struct ``aux`` (its nearest row) and the
    score. Thresholds are cheap filters over it, so a sweep needs one search.
    """

    frame: DataFrame
    main_columns: list[str]
    aux_columns: list[str]
    main_keys: list[str]
    how: str
    suffixes: tuple[str, str]

    def apply(self, match_score: float | Column = 0.0, drop_unmatched: bool = False,
              return_score: bool = False, sort: bool = False,
              extra: Iterable[str] = ()) -> DataFrame:
        threshold = match_score if isinstance(match_score, Column) else F.lit(float(match_score))
        df = self.frame
        accepted = F.coalesce(F.col(SCORE) >= threshold, F.lit(False))
        if drop_unmatched:
            df = df.where(accepted)
        if sort:
            df = df.orderBy(*[F.col(f"main.`{c}`") for c in self.main_keys])
        shared = set(self.main_columns) & set(self.aux_columns)
        left, right = self.suffixes
        main_suffix, aux_suffix = (left, right) if self.how == "left" else (right, left)
        main = [F.col(f"main.`{c}`").alias(c + main_suffix if c in shared else c)
                for c in self.main_columns]
        aux = [F.when(accepted, F.col(f"aux.`{c}`")).alias(c + aux_suffix if c in shared else c)
               for c in self.aux_columns]
        columns = main + aux if self.how == "left" else aux + main
        if return_score:
            columns = [*columns, F.col(SCORE)]
        return df.select(*extra, *columns)


def _names(value, name: str) -> list[str] | None:
    if value is None:
        return None
    if isinstance(value, str):
        return [value]
    if not isinstance(value, Iterable):
        raise TypeError(f"parameter {name!r} should be a column name or a list of them")
    return list(value)


def _kind(dtype: T.DataType) -> str:
    if isinstance(dtype, T.NumericType):
        return "number"
    return "time" if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)) else "text"


def _as_number(c: Column, kind: str) -> Column:
    return (F.unix_seconds(c.cast("timestamp")) if kind == "time" else c).cast("double")


def _digest(*parts: Column) -> Column:
    """Fixed-size key of a row's join values; null when a number is missing."""
    if len(parts) == 1:
        return F.md5(parts[0].cast("string"))
    return F.md5(F.concat(*[F.concat(F.length(p.cast("string")).cast("string"), F.lit(":"),
                                     p.cast("string")) for p in parts]))


def _distinct_main(main: DataFrame, columns: list[str]) -> DataFrame:
    return main.where("k is not null").groupBy("k", *columns).agg(F.count(F.lit(1)).alias("m"))


def _distinct_aux(aux: DataFrame, columns: list[str]) -> DataFrame:
    """One row per distinct key: its lowest order, that row, and the values to compare.

    The values follow from the key; grouping by them too spares an aggregate over them.
    """
    return aux.where("k is not null").groupBy("k", *columns).agg(
        F.count(F.lit(1)).alias("m"), F.min("o").alias("o"), F.min_by("row", "o").alias("row"))


@dataclass(frozen=True)
class JoinKeys:
    """The searched (main) and the searching table, and their key columns by kind."""

    main: DataFrame
    aux: DataFrame
    main_on: list[str]
    aux_on: list[str]
    kinds: list[str]

    @classmethod
    def of(cls, left: DataFrame, right: DataFrame, how: str, on: list[str], left_on: list[str],
           right_on: list[str]) -> JoinKeys:
        sides = [(left, on or left_on), (right, on or right_on)]
        if how == "right":
            sides.reverse()
        elif how != "left":
            raise ValueError(f"a fuzzy join goes left or right, not {how!r}")
        (main, main_on), (aux, aux_on) = sides
        if not (main_on and aux_on):
            raise KeyError("key columns are missing: name them with on, or with left_on and right_on")
        kinds, others = ([_kind(df.schema[c].dataType) for c in names] for df, names in sides)
        if len(kinds) != len(others):
            raise ValueError("left_on and right_on differ in length")
        if kinds != others:
            raise TypeError(f"keys of kinds {kinds} can't be compared with {others}")
        return cls(main, aux, main_on, aux_on, kinds)

    @property
    def texts(self) -> list[tuple[str, str]]:
        return [(m, a) for m, a, k in zip(self.main_on, self.aux_on, self.kinds) if k == "text"]

    @property
    def numbers(self) -> list[tuple[str, str, str]]:
        return [x for x in zip(self.main_on, self.aux_on, self.kinds) if x[2] != "text"]


def fuzzy_matches(
    left: DataFrame, right: DataFrame, how: str = "left",
    left_on=None, right_on=None, on=None, *,
    encoder: Callable[[DataFrame], DataFrame] | None = None,
    analyzer: str = "char_wb", ngram_range: tuple[int, int] = (2, 4),
    suffixes: tuple[str, str] = ("_x", "_y"),
    main_vectors: str | None = None, aux_vectors: str | None = None,
    order_by: str | list[str] | None = None, null_as_text: bool = True,
) -> FuzzyMatches:
    """Nearest aux row of every main row, with its score in [0.5, 1].

    Text keys are compared by TF-IDF over n-grams, numbers and times by z-scores over both
    tables, and the blocks' squared distances add up. ``main_vectors``/``aux_vectors`` name
    columns with ready-made vectors; ``encoder`` maps distinct texts ``(k, t)`` to ``(k, v)``.
    ``order_by`` names the aux columns that decide between equally near rows (lowest wins; by
    default all aux columns). ``null_as_text`` compares a missing text as ``nan``; otherwise such
    rows stay unmatched, as rows with a missing number or time always do.
    """
    keys = JoinKeys.of(left, right, how, _names(on, "on"), _names(left_on, "left_on"), _names(right_on, "right_on"))
    main, aux, main_on, aux_on = keys.main, keys.aux, keys.main_on, keys.aux_on
    texts, numbers = keys.texts, keys.numbers
    choices = {"analyzer": (analyzer, ANALYZERS)}
    for name, (given, allowed) in choices.items():
        if given not in allowed:
            raise ValueError(f"{name}={given!r} is none of {', '.join(allowed)}")
    if not (encoder is None or callable(encoder)):
        raise ValueError("an encoder is called with the distinct texts")
    ready = [v for v in (main_vectors, aux_vectors) if v is not None]
    if len(ready) == 1 or (ready and numbers):
        raise ValueError("vectors come for both tables, and take the place of text keys only")

    order = _names(order_by, "order_by") or list(aux.columns)

    def prepare(df: DataFrame, side: int) -> DataFrame:
        """``(row, k, [o], [v | t], [raw])``; the table's own columns stay inside ``row``."""
        def of(c: str) -> Column:
            return F.col(f"row.`{c}`")

        out = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
        vector = (main_vectors, aux_vectors)[side]
        parts: list[Column] = []
        missing = F.lit(False)
        if vector is not None:
            # single precision moves as it is and is measured in double precision
            single = all(dict(d.dtypes)[c] == "array<float>" for d, c in ((main, main_vectors), (aux, aux_vectors)))
            out = out.withColumn("v", of(vector).cast(f"array<{'float' if single else 'double'}>"))
            parts.append(F.col("v"))
        elif texts:
            out = out.withColumn("t", key_text(*[of(p[side]) for p in texts]))
            parts.append(F.col("t"))
            if not null_as_text:
                for p in texts:
                    missing = missing | of(p[side]).isNull()
        if numbers:
            out = out.withColumn("raw", F.array(*[_as_number(of(p[side]), p[2]) for p in numbers]))
            parts += [F.get("raw", F.lit(i)) for i in range(len(numbers))]
        out = out.withColumn("k", F.when(~missing, _digest(*parts)))
        if side == 1:
            out = out.withColumn("o", of(order[0]) if len(order) == 1 else F.concat_ws(
                "\x01", *[of(c).cast("string") for c in order]))
        return out

    main_rows, aux_rows = prepare(main, 0), prepare(aux, 1)
    values = [c for c in ("v", "t", "raw") if c in main_rows.columns]
    mains, auxs = _distinct_main(main_rows, values), _distinct_aux(aux_rows, values)

    if main_vectors is not None:
        near = nearest_vectors(mains.select("k", "v"), auxs.select("k", "o", "v"))
    elif numbers:
        near = _with_numbers(main_rows, aux_rows, mains, auxs, len(numbers), bool(texts),
                             analyzer, ngram_range)
    elif encoder is not None:
        near = nearest_vectors(
            encoder(mains.select("k", "t")).select("k", F.col("v").cast("array<double>").alias("v")),
            auxs.select("k", "o").join(encoder(auxs.select("k", "t")), "k").select(
                "k", "o", F.col("v").cast("array<double>").alias("v")))
    else:
        near = nearest_text(mains, auxs, analyzer, ngram_range)

    near = materialise(near, "matches")
    worst = near.agg(F.max("d")).scalar()
    near = near.withColumn("_worst", worst).select("k", "ak", F.when(
        F.col("_worst") > 0, F.lit(1.0) - F.col("d") / (F.lit(2.0) * F.col("_worst"))
    ).when(F.col("d").isNotNull(), F.lit(1.0)).alias(SCORE))
    # many main rows may share one key or one neighbour: the adaptive skew join splits them
    frame = (main_rows.select(F.col("row").alias("main"), "k").join(near, "k", "left")
             .join(auxs.select(F.col("k").alias("ak"), F.col("row").alias("aux")), "ak", "left")
             .select("main", "aux", SCORE))
    return FuzzyMatches(frame, list(main.columns), list(aux.columns), main_on, how, suffixes)


def _with_numbers(main_rows: DataFrame, aux_rows: DataFrame, mains: DataFrame, auxs: DataFrame,
                  n: int, with_text: bool, analyzer: str,
                  ngram_range: tuple[int, int]) -> DataFrame:
    """Number and time keys: z-scores with the mean and population deviation of both tables."""
    every = main_rows.where("k is not null").select("raw").unionByName(
        aux_rows.where("k is not null").select("raw"))
    deviations = every.agg(F.array(*[
        F.when(F.stddev_pop(F.col("raw")[i]) > 0, F.stddev_pop(F.col("raw")[i])).otherwise(1.0)
        for i in range(n)])).scalar()
    if n == 1 and not with_text:
        return nearest_numeric(mains.select("k", F.col("raw")[0].alias("z")),
                               auxs.select("k", "o", F.col("raw")[0].alias("z")),
                               F.get(deviations, F.lit(0)))
    # differences do not depend on the mean, so scaling alone gives the same distances
    scaled = F.zip_with("raw", "_dev", lambda x, s: x / s)
    mains = mains.withColumn("_dev", deviations).withColumn("z", scaled).drop("_dev")
    auxs = auxs.withColumn("_dev", deviations).withColumn("z", scaled).drop("_dev")
    if not with_text:
        return nearest_vectors(mains.select("k", F.col("z").alias("v")),
                               auxs.select("k", "o", F.col("z").alias("v")))
    return nearest_text(mains, auxs, analyzer, ngram_range, numbers=True)


def fuzzy_join(
    left: DataFrame, right: DataFrame, how: str = "left",
    left_on=None, right_on=None, on=None, *,
    return_score: bool = False, match_score: float = 0.0, drop_unmatched: bool = False,
    sort: bool = False, **search,
) -> DataFrame:
    """Join two tables on their nearest keys; see :func:`fuzzy_matches` for ``search``.

    A row whose score is below ``match_score`` keeps its own columns and gets nulls for the
    other table, or is dropped with ``drop_unmatched``.
    """
    if isinstance(match_score, bool) or not isinstance(match_score, (int, float)):
        raise TypeError("match_score should be a number")
    found = fuzzy_matches(left, right, how, left_on, right_on, on, **search)
    return found.apply(match_score, drop_unmatched, return_score, sort)


def sweep_thresholds(found: FuzzyMatches, thresholds: list[float]) -> DataFrame:
    """Apply several thresholds to one search; adds the column ``match_score``."""
    grid = F.array(*[F.lit(float(t)) for t in thresholds])
    frame = found.frame.withColumn("match_score", F.explode(grid))
    copy = FuzzyMatches(frame, found.main_columns, found.aux_columns, found.main_keys,
                        found.how, found.suffixes)
    return copy.apply(F.col("match_score"), return_score=True, extra=["match_score"])
