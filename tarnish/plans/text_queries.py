"""Text, vector and scalar functions, and column profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tarnish.functions import scalars, text, vectors
from tarnish.operators import profile
from tarnish.plans.registry import Tables, query

# --------------------------------------------------------------------------- n-grams in SQL

def gram_rows(source: str, keys: str, t: str, analyzer: str, lo: int, hi: int) -> str:
    """One row ``(keys, gram)`` per n-gram occurrence of a text, as DuckDB SQL.

    The prepared text is a column of the inner query: a lambda would prepare it per n-gram.
    """
    sizes = f"range({lo}, {hi + 1})"
    if analyzer == "char":
        s = f"regexp_replace(lower({t}), '\\s\\s+', ' ', 'g')"
        cols = f"{keys}, " if keys else ""
        after = ", ".join(f"lead(c, {j}) OVER w AS c{j}" for j in range(1, hi))
        parts = [" || ".join(["c", *[f"c{j}" for j in range(1, n)]]) for n in range(lo, hi + 1)]
        return (f"SELECT {cols}gram FROM (SELECT {cols}unnest([{', '.join(parts)}]) AS gram FROM ("
                f"SELECT {cols}c{', ' + after if after else ''} FROM ("
                f"SELECT {cols}r, unnest(string_split(s, '')) AS c, unnest(range(length(s))) AS i FROM ("
                f"SELECT {cols}row_number() OVER () AS r, {s} AS s FROM {source})) "
                "WINDOW w AS (PARTITION BY r ORDER BY i))) WHERE gram IS NOT NULL")
    if analyzer == "word":
        s = f"regexp_extract_all(lower({t}), '[\\p{{L}}\\p{{N}}_]{{2,}}')"
        g = (f"flatten(list_transform({sizes}, lambda n: list_transform("
             f"range(1, len(s) - n + 2), lambda i: array_to_string(list_slice(s, i, i + n - 1), ' '))))")
    else:
        s = f"list_filter(regexp_split_to_array(lower({t}), '\\s+'), lambda w: w <> '')"
        g = (f"flatten(list_transform(s, lambda w: CASE WHEN length(w) + 2 < {lo} THEN [' ' || w || ' '] ELSE "
             f"flatten(list_transform({sizes}, lambda n: list_transform(range(1, length(w) + 2 - n + 2), "
             f"lambda i: substring(' ' || w || ' ', i, n)))) END))")
    cols = f"{keys}, " if keys else ""
    return f"SELECT {cols}unnest({g}) AS gram FROM (SELECT {cols}{s} AS s FROM {source})"


def _gram_query(table: str, key: str, c: str, analyzer: str, lo: int, hi: int) -> str:
    cols = f"{key}, " if key else ""
    return (f"SELECT {cols}gram, count(*) AS cnt FROM ({gram_rows(table, key, c, analyzer, lo, hi)}) "
            "GROUP BY ALL")


@query("char_ngrams", _gram_query("customer", "c_custkey", "c_name", "char", 2, 4))
def char_ngrams(t: Tables) -> DataFrame:
    return text.gram_counts(t.customer, ["c_custkey"], "c_name", "char", (2, 4))


for _lo, _hi in ((1, 1), (1, 2), (1, 3), (2, 3)):
    def _ranged(t: Tables, r=(_lo, _hi)) -> DataFrame:
        return text.gram_counts(t.pages, ["page_id"], "url", "char", r)
    query(f"char_ngrams_{_lo}_{_hi}", _gram_query("pages", "page_id", "url", "char", _lo, _hi))(_ranged)


@query("char_ngrams_long_text", _gram_query("documents", "", "text", "char", 2, 4))
def char_ngrams_long_text(t: Tables) -> DataFrame:
    return text.gram_counts(t.documents, [], "text", "char", (2, 4))


@query("char_wb_ngrams", _gram_query("benchmark", "item_id", "text", "char_wb", 2, 4))
def char_wb_ngrams(t: Tables) -> DataFrame:
    return text.gram_counts(t.benchmark, ["item_id"], "text", "char_wb", (2, 4))


@query("word_ngrams", _gram_query("conversations", "conv_id, turn", "text", "word", 1, 3))
def word_ngrams(t: Tables) -> DataFrame:
    return text.gram_counts(t.conversations, ["conv_id", "turn"], "text", "word", (1, 3))


# --------------------------------------------------------------------------- scalar functions

@query("concat_with_sep", """
SELECT p_partkey, concat_ws('  ', p_brand, coalesce(nullif(p_type, 'PROMO'), 'nan'), p_name) AS key FROM part""")
def concat_with_sep(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", text.key_text(
        "p_brand", F.nullif(F.col("p_type"), F.lit("PROMO")), "p_name").alias("key"))


@query("concat_key", """
SELECT c_custkey, c_mktsegment || '__' || CASE WHEN c_nationkey > 3 THEN c_nationkey END AS key FROM customer""")
def concat_key(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", text.concat_key(
        "c_mktsegment", F.when(F.col("c_nationkey") > 3, F.col("c_nationkey"))).alias("key"))


@query("regex_extract", """
SELECT page_id, CASE WHEN regexp_matches(url, 'page=(\\d+)') THEN regexp_extract(url, 'page=(\\d+)', 1) END AS page FROM pages""")
def regex_extract(t: Tables) -> DataFrame:
    return t.pages.select("page_id", text.extract("url", r"page=(\d+)").alias("page"))


@query("split_part", """
SELECT page_id, split_part(url, '/', 3) AS host, split_part(url, '/', -1) AS tail FROM pages""")
def split_part(t: Tables) -> DataFrame:
    return t.pages.select("page_id", text.piece("url", "/", 3).alias("host"),
                          text.piece("url", "/", -1).alias("tail"))


@query("replace_substring", """
SELECT doc_id, replace(replace(replace(text, chr(10), ' '), 'the', ''), 'de', '') AS cleaned FROM documents""")
def replace_substring(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.strip_parts(
        text.newlines_to_blanks("text"), "the", "de").alias("cleaned"))


@query("prefix_text", "SELECT item_id, 'query: ' || text AS a, text AS b FROM benchmark")
def prefix_text(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", text.encoder_input("text", "lm__intfloat/e5-large-v2").alias("a"),
                              text.encoder_input("text", "lm__BAAI/bge-large-en-v1.5").alias("b"))


@query("log10_scale", "SELECT o_orderkey, round(log10(o_totalprice), 9) AS log_price FROM orders")
def log10_scale(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.round(scalars.log10_scale("o_totalprice"), 9).alias("log_price"))


# --------------------------------------------------------------------------- vectors

_LONG = ("SELECT vec_id, unnest(range(len(embedding)))::INT AS dim, unnest(embedding::DOUBLE[]) AS x FROM embeddings")


def _long(df: DataFrame, v: str) -> DataFrame:
    return df.select("vec_id", F.posexplode(v).alias("dim", "x"))


@query("wide_to_vector", "SELECT s_suppkey, [s_suppkey::DOUBLE, s_nationkey::DOUBLE][i + 1] AS x, i::INT AS dim, 'a__b' AS source FROM supplier, (SELECT unnest(range(2)) AS i) UNION ALL SELECT s_suppkey, s_acctbal, 0, 'c' FROM supplier")
def wide_to_vector(t: Tables) -> DataFrame:
    wide = t.supplier.selectExpr("s_suppkey", "s_nationkey AS a__b__1", "s_suppkey AS a__b__0", "s_acctbal AS c__0")
    v = vectors.wide_to_vectors(wide, ["s_suppkey"])
    parts = [v.select("s_suppkey", F.posexplode(F.col(c)).alias("dim", "x"), F.lit(c).alias("source"))
             for c in ("a__b", "c")]
    return parts[0].unionByName(parts[1])


@query("vector_to_wide", "SELECT vec_id, label, " + ", ".join(
    f"embedding[{i + 1}]::DOUBLE AS embedding__{i}" for i in range(64)) + " FROM embeddings")
def vector_to_wide(t: Tables) -> DataFrame:
    return vectors.vector_to_wide(t.embeddings.withColumn("embedding", vectors.to_double("embedding")),
                                  "embedding", 64)


@query("append_columns_by_row", """
SELECT doc_id, length(text) AS n, quality, toxic FROM documents JOIN labels USING (doc_id)""")
def append_columns_by_row(t: Tables) -> DataFrame:
    block = t.documents.select("doc_id", F.length("text").cast("bigint").alias("n"))
    return block.join(t.labels, "doc_id")


# Tokens of a text: eight runs of eight coordinates of a vector, the last ones masked.
_TOKENS = ("SELECT vec_id, dim // 8 AS token, dim % 8 AS d, x, CASE WHEN dim // 8 < label THEN 1 ELSE 0 END AS mask "
           f"FROM ({_LONG}) JOIN embeddings USING (vec_id)")


@query("vector_mean_pool_masked", f"""
SELECT vec_id, d::INT AS d, round(sum(x * mask) / greatest(sum(mask), 1e-9), 9) AS mean FROM ({_TOKENS}) GROUP BY vec_id, d""")
def vector_mean_pool_masked(t: Tables) -> DataFrame:
    long = t.embeddings.select("vec_id", "label", F.posexplode(vectors.to_double("embedding")).alias("dim", "x"))
    tokens = long.selectExpr("vec_id", "dim div 8 AS token", "dim % 8 AS d", "x",
                             "CASE WHEN dim div 8 < label THEN 1 ELSE 0 END AS mask")
    out = vectors.masked_mean(tokens, ["vec_id"], "d", "x", "mask")
    return out.withColumn("mean", F.round("mean", 9))


@query("vector_first_token", f"SELECT vec_id, dim, x FROM ({_LONG}) WHERE dim < 8")
def vector_first_token(t: Tables) -> DataFrame:
    v = vectors.to_double("embedding")
    tokens = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice(v, i * 8 + 1, 8))
    return _long(t.embeddings.withColumn("tokens", tokens).withColumn(
        "cls", vectors.first_token("tokens")), "cls")


@query("vector_l2_normalise", f"""
SELECT vec_id, dim, round(x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)), 9) AS x FROM ({_LONG})""")
def vector_l2_normalise(t: Tables) -> DataFrame:
    return _long(vectors.with_l2_normalised(t.embeddings, "embedding", "u"), "u").withColumn(
        "x", F.round("x", 9))


@query("vector_zero_pad", f"""
SELECT vec_id, dim, x FROM ({_LONG}) UNION ALL
SELECT vec_id, d::INT, 0.0::DOUBLE FROM embeddings, (SELECT unnest(range(64, 100)) AS d)""")
def vector_zero_pad(t: Tables) -> DataFrame:
    return _long(t.embeddings.withColumn("p", vectors.zero_pad("embedding", 100)), "p")


@query("vector_concat", f"""
SELECT vec_id, dim, x FROM ({_LONG}) UNION ALL SELECT vec_id, 64, label::DOUBLE FROM embeddings
UNION ALL SELECT vec_id, 65, vec_id::DOUBLE FROM embeddings""")
def vector_concat(t: Tables) -> DataFrame:
    return _long(t.embeddings.withColumn("c", vectors.concat("embedding", F.array("label", "vec_id"))), "c")


# --------------------------------------------------------------------------- profiles

_COLUMNS = [("customer", "c_name"), ("part", "p_name"), ("pages", "url"), ("orders", "o_orderpriority")]
_TEXTS = " UNION ALL ".join(f"SELECT '{c}' AS col, {c} AS text FROM {t}" for t, c in _COLUMNS)
_N_WORDS = "len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''))"
_U_WORDS = "len(list_distinct(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')))"
_LENGTHS = f"""
l AS (SELECT col, count(*) AS n_rows, avg(length(text)) AS mean_length, count(DISTINCT text) AS cardinality,
        avg({_N_WORDS}) AS words, avg({_U_WORDS}) AS uwords FROM ({_TEXTS}) GROUP BY col)"""
_GRAMS = f"""
g AS (SELECT col, gram, count(*) AS n FROM ({gram_rows(f"({_TEXTS})", 'col', 'text', 'char', 2, 4)}) GROUP BY ALL),
s AS (SELECT col, count(*) AS ngrams, sum(n) AS total FROM g GROUP BY col)"""


def _texts(t: Tables) -> DataFrame:
    out = None
    for table, c in _COLUMNS:
        one = profile.long_columns(getattr(t, table).select(c), [c])
        out = one if out is None else out.unionByName(one)
    return out


def _round_all(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if d == "double" else F.col(c) for c, d in df.dtypes])


@query("profile_mean_length", f"WITH {_LENGTHS} SELECT col, round(mean_length, 6) AS mean_length FROM l")
def profile_mean_length(t: Tables) -> DataFrame:
    return _round_all(profile.profile_lengths(_texts(t)).select("col", "mean_length"))


@query("profile_cardinality", f"""
WITH {_LENGTHS} SELECT col, n_rows, cardinality, round(cardinality / n_rows, 6) AS cardinality_div_by_nrows FROM l""")
def profile_cardinality(t: Tables) -> DataFrame:
    return _round_all(profile.profile_lengths(_texts(t)).select(
        "col", "n_rows", "cardinality", "cardinality_div_by_nrows"))


@query("profile_words", f"""
WITH {_LENGTHS} SELECT col, round(words, 6) AS mean_word_length, round(uwords, 6) AS mean_word_length_unique FROM l""")
def profile_words(t: Tables) -> DataFrame:
    return _round_all(profile.profile_lengths(_texts(t)).select(
        "col", "mean_word_length", "mean_word_length_unique"))


def _gram_profile(t: Tables, *columns: str) -> DataFrame:
    texts = _texts(t)
    return _round_all(profile.profile_grams(
        profile.column_grams(texts), profile.profile_lengths(texts)).select("col", *columns))


@query("profile_ngrams", f"""
WITH {_LENGTHS}, {_GRAMS} SELECT col, ngrams, round(ngrams / n_rows, 6) AS ngrams_div_by_nrows FROM l JOIN s USING (col)""")
def profile_ngrams(t: Tables) -> DataFrame:
    return _gram_profile(t, "ngrams", "ngrams_div_by_nrows")


@query("profile_ngram_density", f"""
WITH {_LENGTHS}, {_GRAMS} SELECT col, round(ngrams / mean_length, 6) AS ngrams_div_by_length,
  round(ngrams / mean_length / n_rows, 6) AS ngrams_div_by_length_and_nrows FROM l JOIN s USING (col)""")
def profile_ngram_density(t: Tables) -> DataFrame:
    return _gram_profile(t, "ngrams_div_by_length", "ngrams_div_by_length_and_nrows")


@query("profile_ngram_sharing", f"""
WITH {_LENGTHS}, {_GRAMS} SELECT col, round(total / n_rows / ngrams, 6) AS prop_shared_ngrams,
  round(total / n_rows, 6) AS prop_shared_ngrams_sum FROM l JOIN s USING (col)""")
def profile_ngram_sharing(t: Tables) -> DataFrame:
    return _gram_profile(t, "prop_shared_ngrams", "prop_shared_ngrams_sum")


@query("profile_ngram_quantiles", f"""
WITH {_LENGTHS}, {_GRAMS} SELECT col, """ + ", ".join(
    f"round(quantile_cont(n, {p}) / max(n_rows), 6) AS {name}" for name, p in profile.QUANTILES.items())
    + " FROM g JOIN l USING (col) GROUP BY col")
def profile_ngram_quantiles(t: Tables) -> DataFrame:
    texts = _texts(t)
    return _round_all(profile.profile_gram_quantiles(
        profile.column_grams(texts), profile.profile_lengths(texts)))


@query("profile_long_text", f"""
WITH t AS (SELECT 'text' AS col, text FROM documents),
g AS (SELECT gram, count(*) AS n FROM ({gram_rows('t', '', 'text', 'char', 2, 4)}) GROUP BY gram)
SELECT 'text' AS col, (SELECT count(*) FROM g) AS ngrams,
  round((SELECT avg(length(text)) FROM t), 6) AS mean_length,
  round((SELECT sum(n) FROM g) / (SELECT count(*) FROM t), 6) AS prop_shared_ngrams_sum""")
def profile_long_text(t: Tables) -> DataFrame:
    texts = profile.long_columns(t.documents, ["text"])
    lengths = profile.profile_lengths(texts)
    return _round_all(profile.profile_grams(profile.column_grams(texts), lengths).join(lengths, "col").select(
        "col", "ngrams", "mean_length", "prop_shared_ngrams_sum"))
