"""Text expressions: cleaning, n-grams, label handling. JVM-side, but for the n-gram totals of long texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tarnish.functions.grams import CHARACTERS, char_ngrams, portions
from tarnish.session import parallelism

ANALYZERS = ("char", "char_wb", "word")

# A token is a run of at least two letters, digits or underscores.
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def collapse_spaces(text: str | Column) -> Column:
    """Lower-case and turn every run of two or more blanks into one."""
    return F.regexp_replace(F.lower(col(text)), r"\s\s+", " ")


def _windows(items: Column, n: int, sep: str) -> Column:
    """All runs of ``n`` neighbouring items of an array, joined by ``sep``.

    Indexing an array is constant time, whereas ``substring`` walks the text from its start,
    so this stays linear in the length of the text.
    """
    def run(i: Column) -> Column:
        parts = [F.get(items, i + j) for j in range(n)]
        return F.concat_ws(sep, *parts) if sep else F.concat(*parts)

    return F.when(
        F.size(items) >= n, F.transform(F.sequence(F.lit(0), F.size(items) - n), run)
    ).otherwise(F.array().cast("array<string>"))


def _sizes(items: Column, lo: int, hi: int, sep: str = "") -> Column:
    return F.flatten(F.array(*[_windows(items, n, sep) for n in range(lo, hi + 1)]))


def with_ngrams(df: DataFrame, text: str | Column, analyzer: str = "char_wb",
                ngram_range: tuple[int, int] = (2, 4), out: str = "grams") -> DataFrame:
    """Add an array column with every n-gram occurrence of the whole text.

    ``char``    substrings of the lower-cased text, runs of blanks collapsed;
    ``char_wb`` substrings of each word padded by one blank on both sides, where a padded
                word shorter than the smallest size is emitted once as it is;
    ``word``    runs of tokens joined by a blank.

    The split pieces live in a column of their own: they are referenced several times, so
    Catalyst keeps that projection and the text is split once per row.
    """
    lo, hi = ngram_range
    if analyzer not in ANALYZERS:
        raise ValueError(f"analyzer should be one of {ANALYZERS}, got {analyzer!r}")
    if not 1 <= lo <= hi:
        raise ValueError(f"ngram_range should satisfy 1 <= lo <= hi, got {ngram_range!r}")
    pieces = "_pieces"
    if analyzer == "char":
        df = df.withColumn(pieces, F.split(collapse_spaces(text), ""))
        # an empty text splits into one empty piece
        df = df.withColumn(pieces, F.filter(pieces, lambda c: c != ""))
        grams = _sizes(F.col(pieces), lo, hi)
    elif analyzer == "word":
        df = df.withColumn(
            pieces, F.regexp_extract_all(F.lower(col(text)), F.lit(TOKEN_PATTERN), F.lit(0)))
        grams = _sizes(F.col(pieces), lo, hi, sep=" ")
    else:
        words = F.filter(F.split(F.lower(col(text)), r"\s+"), lambda w: w != "")
        df = df.withColumn(pieces, F.transform(
            words, lambda w: F.filter(
                F.split(F.concat(F.lit(" "), w, F.lit(" ")), ""), lambda c: c != "")))
        grams = F.flatten(F.transform(pieces, lambda w: F.when(
            F.size(w) < lo, F.array(F.array_join(w, ""))).otherwise(_sizes(w, lo, hi))))
    return df.withColumn(out, grams).drop(pieces)


def gram_counts(df: DataFrame, keys: list[str], text: str, analyzer: str = "char_wb",
                ngram_range: tuple[int, int] = (2, 4), by: list[str] | None = None) -> DataFrame:
    """Long table ``(*keys, gram, cnt)``; without keys the counts of the whole table.

    Texts are spread by their key (or ``by``) before they are cut up: the n-gram counts of a key
    are then complete inside one task, so what is shuffled are texts and not n-grams. Without a
    key, copies of a text are counted first, and character n-grams are added up batch by batch.

    The outer form of explode matters: for the inner one Catalyst derives a filter on the array,
    pushes it below the projections and so evaluates the whole split once per n-gram.
    """
    if keys:
        rows = df.select(*keys, text).repartition(parallelism(df.sparkSession), *(by or keys))
        weight = F.count(F.lit(1))
    else:
        rows = df.groupBy(text).agg(F.count(F.lit(1)).alias("_m"))
        if analyzer == "char":
            return char_totals(rows, [], text, "_m", ngram_range).withColumnRenamed("n", "cnt")
        weight = F.sum("_m")
    kept = keys or ["_m"]
    grams = with_ngrams(rows, text, analyzer, ngram_range, "_grams")
    return (grams.select(*kept, F.explode_outer("_grams").alias("gram")).where("gram is not null")
            .groupBy(*keys, "gram").agg(weight.alias("cnt")))


def char_totals(rows: DataFrame, keys: list[str], text: str, m: str, ngram_range: tuple[int, int] = (2, 4)) -> DataFrame:
    """Long table ``(*keys, gram, n)``: occurrences of every character n-gram in all texts of a key,
    a text counting ``m`` times.

    A task adds up the n-grams of about a million characters at once, so what leaves it are distinct
    n-grams of a portion, not those of every text.
    """
    lo, hi = ngram_range
    if not 1 <= lo <= hi:
        raise ValueError(f"ngram_range should satisfy 1 <= lo <= hi, got {ngram_range!r}")
    source = rows.select(*keys, F.col(m).cast("bigint").alias("_m"), collapse_spaces(text).alias("_t")).where("_t is not null")
    schema = T.StructType([*[source.schema[k] for k in keys], T.StructField("gram", T.StringType()), T.StructField("n", T.LongType())])

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parts = pdf.groupby(keys, dropna=False, sort=False) if keys else [((), pdf)]
            for key, part in parts:
                texts, times = part["_t"].tolist(), part["_m"].to_numpy()
                for cut in portions(np.array([len(t) for t in texts]), CHARACTERS):
                    for at, ranks, grams in char_ngrams(texts[cut], lo, hi):
                        # exact: the totals of a portion are far below 2 to the 53rd
                        n = np.bincount(ranks, times[cut][at], len(grams)).astype("int64")
                        yield pd.DataFrame({**dict(zip(keys, key)), "gram": grams, "n": n})

    return source.mapInPandas(counted, schema).groupBy(*keys, "gram").agg(F.sum("n").alias("n"))


def key_text(*columns: str | Column) -> Column:
    """Several key columns as one text, two blanks between them, a null as the text ``nan``."""
    return F.concat_ws("  ", *[F.coalesce(col(c).cast("string"), F.lit("nan")) for c in columns])


def concat_key(*columns: str | Column, sep: str = "__") -> Column:
    """Label built from several columns; null when one of them is."""
    parts: list[Column] = []
    for c in columns:
        parts += [F.lit(sep), col(c).cast("string")]
    return F.concat(*parts[1:])


def extract(text: str | Column, pattern: str, group: int = 1) -> Column:
    """Captured group, null where the pattern does not match."""
    return F.when(col(text).rlike(pattern), F.regexp_extract(col(text), pattern, group))


def piece(text: str | Column, delimiter: str, k: int) -> Column:
    """k-th piece (1-based, negative from the end)."""
    return F.split_part(col(text), F.lit(delimiter), F.lit(k))


def strip_parts(text: str | Column, *parts: str) -> Column:
    out = col(text)
    for p in parts:
        out = F.replace(out, F.lit(p), F.lit(""))
    return out


def newlines_to_blanks(text: str | Column) -> Column:
    return F.replace(col(text), F.lit("\n"), F.lit(" "))


def encoder_input(text: str | Column, encoder: str) -> Column:
    """Text as an encoder wants it: one model family is fed a fixed prefix."""
    return F.concat(F.lit("query: "), col(text)) if "e5" in encoder else col(text)


def n_words(text: str | Column) -> Column:
    return F.size(F.filter(F.split(col(text), r"\s+"), lambda w: w != ""))


def n_distinct_words(text: str | Column) -> Column:
    return F.size(F.array_distinct(F.filter(F.split(col(text), r"\s+"), lambda w: w != "")))
