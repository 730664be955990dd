"""Text statistics of columns: lengths, cardinality, words and n-gram sharing."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tarnish.functions.text import char_totals, n_distinct_words, n_words
from tarnish.operators.ordering import group_quantiles

# The reported quantiles of gram frequencies.
QUANTILES = {"q_25_shared_ngrams": 0.25, "q_50_shared_ngrams": 0.5, "q_75_shared_ngrams": 0.75,
             "q_90_shared_ngrams": 0.9, "q_95_shared_ngrams": 0.95, "q_99_shared_ngrams": 0.99}


def long_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(col, text, m)``: distinct texts of several columns with their multiplicity.

    A text that fills a third of a column is analysed once.
    """
    return (df.unpivot([], columns, "col", "text").where("text is not null")
            .groupBy("col", "text").agg(F.count(F.lit(1)).alias("m")))


def column_grams(texts: DataFrame, ngram_range: tuple[int, int] = (2, 4)) -> DataFrame:
    """``(col, gram, n)``: total occurrences of every character n-gram of every column."""
    return char_totals(texts, ["col"], "text", "m", ngram_range)


def profile_lengths(texts: DataFrame) -> DataFrame:
    """Row counts, mean length, cardinality and words per row."""
    m = F.col("m")
    rows = F.sum(m)
    return texts.groupBy("col").agg(
        rows.alias("n_rows"),
        (F.sum(m * F.length("text")) / rows).alias("mean_length"),
        F.count(F.lit(1)).alias("cardinality"),
        (F.count(F.lit(1)) / rows).alias("cardinality_div_by_nrows"),
        (F.sum(m * n_words("text")) / rows).alias("mean_word_length"),
        (F.sum(m * n_distinct_words("text")) / rows).alias("mean_word_length_unique"))


def profile_grams(grams: DataFrame, lengths: DataFrame) -> DataFrame:
    """Distinct n-grams and the share of rows an n-gram occurs in, as totals and means."""
    one = grams.groupBy("col").agg(F.count(F.lit(1)).alias("ngrams"), F.sum("n").alias("total"))
    n, rows = F.col("ngrams"), F.col("n_rows")
    density = n / F.col("mean_length")
    return one.join(lengths, "col").select(
        "col", "ngrams", (n / rows).alias("ngrams_div_by_nrows"),
        density.alias("ngrams_div_by_length"),
        (density / rows).alias("ngrams_div_by_length_and_nrows"),
        (F.col("total") / rows / n).alias("prop_shared_ngrams"),
        (F.col("total") / rows).alias("prop_shared_ngrams_sum"))


def profile_gram_quantiles(grams: DataFrame, lengths: DataFrame) -> DataFrame:
    """Quantiles over n-grams of occurrences per row.

    The quantile is taken on counts, of which there are few distinct ones, and scaled after.
    """
    q = group_quantiles(grams, ["col"], "n", QUANTILES)
    return q.join(lengths.select("col", "n_rows"), "col").select(
        "col", *[(F.col(name) / F.col("n_rows")).alias(name) for name in QUANTILES])


def profile_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """All measures, one row per column."""
    texts = long_columns(df, columns)
    lengths = profile_lengths(texts)
    grams = column_grams(texts)
    return (lengths.join(profile_grams(grams, lengths), "col")
            .join(profile_gram_quantiles(grams, lengths), "col"))
