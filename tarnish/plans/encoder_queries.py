"""Encoders, scalers, feature selection and reduction."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from tarnish.functions import vectors
from tarnish.functions.scalars import QUANTILE_MIDDLE, QUANTILE_TAIL
from tarnish.operators import encoders, reduction, scaling
from tarnish.operators.models import SHORT_VECTORS, pairing_rules, table_vectorizer
from tarnish.operators.tables import grid
from tarnish.plans.registry import Tables, query
from tarnish.plans.table_queries import rounded
from tarnish.plans.text_queries import gram_rows
from tarnish.session import scratch_dir
from tarnish.sources.cache import VectorCache

_MATRIX = ("SELECT vec_id, label, unnest(range(64))::INT AS dim, unnest(embedding::DOUBLE[]) AS value FROM embeddings")
_TRAIN = "label < 7"


def _matrix(t: Tables) -> DataFrame:
    return scaling.matrix(t.embeddings, "vec_id", "embedding", F.expr(_TRAIN))


def _flat(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select("vec_id", "dim", F.round("value", digits).alias("value"))


# --------------------------------------------------------------------------- routing

_CARD = " UNION ALL ".join(f"SELECT '{c}' AS name, count(DISTINCT {c}) AS n_distinct FROM part"
                           for c in ("p_name", "p_brand", "p_type"))


@query("high_cardinality_columns", f"SELECT name, n_distinct, n_distinct >= 30 AS high FROM ({_CARD})")
def high_cardinality_columns(t: Tables) -> DataFrame:
    return encoders.high_cardinality_columns(t.part, 30)


_AUTO = ["c_custkey AS id", "CAST(c_acctbal AS STRING) AS amount", "substr(c_name, 10) AS digits",
         "concat('2024-01-', CASE WHEN c_nationkey < 9 THEN '0' ELSE '' END, CAST(c_nationkey + 1 AS STRING)) AS day",
         "CASE WHEN c_nationkey = 3 THEN 'n/a' ELSE CAST(c_nationkey AS STRING) END AS mixed"]
_AUTO_SQL = f"SELECT {', '.join(_AUTO).replace('AS STRING', 'AS VARCHAR')} FROM customer"


@query("auto_type_columns", f"""
SELECT id, amount::DOUBLE AS amount, digits::DOUBLE AS digits, day::TIMESTAMP AS day, mixed FROM ({_AUTO_SQL})""")
def auto_type_columns(t: Tables) -> DataFrame:
    return encoders.auto_type_columns(t.customer.selectExpr(*_AUTO))


# --------------------------------------------------------------------------- n-gram matrices

_HASH = "CAST(('0x' || substr(md5(gram), 1, 8))::BIGINT % {d} AS INT)"


@query("hashing_vectorizer", f"""
WITH c AS (SELECT item_id, {_HASH.format(d=2 ** 20)} AS dim, count(*) AS raw
  FROM ({gram_rows('benchmark', 'item_id', 'text', 'char', 2, 4)}) GROUP BY ALL)
SELECT item_id, dim, round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY item_id)), 9) AS w FROM c""")
def hashing_vectorizer(t: Tables) -> DataFrame:
    return rounded(encoders.hashing_vectorizer(t.benchmark, "item_id", "text"), "w")


def _tfidf_sql(source: str, key: str, c: str, analyzer: str, lo: int, hi: int, fit: str = "true",
               keys: str | None = None) -> str:
    return f"""
WITH s AS ({source}), n AS (SELECT count(*) AS n FROM s WHERE {fit}),
c AS (SELECT {key}, gram, count(*) AS c FROM ({gram_rows('s', key, c, analyzer, lo, hi)}) GROUP BY ALL),
d AS (SELECT gram, count(*) AS df FROM c JOIN s USING ({key}) WHERE {fit} GROUP BY gram),
r AS (SELECT {key}, gram, c * (ln((1.0 + n) / (1.0 + df)) + 1.0) AS raw FROM c JOIN d USING (gram), n)
SELECT {keys or key}, gram, round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY {key})), 9) AS w FROM r"""


@query("tfidf_vectorizer", _tfidf_sql("SELECT page_id, url FROM pages", "page_id", "url", "char", 2, 3))
def tfidf_vectorizer(t: Tables) -> DataFrame:
    return rounded(encoders.tfidf_vectorizer(t.pages, "page_id", "url", "char", (2, 3)), "w")


@query("tfidf_vectorizer_word", _tfidf_sql("SELECT doc_id, text FROM documents", "doc_id", "text", "word", 1, 1))
def tfidf_vectorizer_word(t: Tables) -> DataFrame:
    return rounded(encoders.tfidf_vectorizer(t.documents, "doc_id", "text", "word", (1, 1)), "w")


@query("tfidf_vectorizer_train_only", _tfidf_sql(
    "SELECT c_custkey, c_name, c_mktsegment FROM customer", "c_custkey", "c_name", "char", 2, 3,
    "c_mktsegment <> 'BUILDING'"))
def tfidf_vectorizer_train_only(t: Tables) -> DataFrame:
    return rounded(encoders.tfidf_vectorizer(t.customer, "c_custkey", "c_name", "char", (2, 3),
                                             F.col("c_mktsegment") != "BUILDING"), "w")


@query("tfidf_fit_on_union", _tfidf_sql(
    "SELECT 'main:' || s_suppkey AS k, s_name AS name FROM supplier UNION ALL SELECT 'aux:' || c_custkey, c_name FROM customer",
    "k", "name", "char_wb", 2, 4, keys="split_part(k, ':', 1) AS side, split_part(k, ':', 2) AS id"))
def tfidf_fit_on_union(t: Tables) -> DataFrame:
    return rounded(encoders.tfidf_fit_on_union(
        t.supplier.selectExpr("CAST(s_suppkey AS STRING) AS id", "s_name AS name"),
        t.customer.selectExpr("CAST(c_custkey AS STRING) AS id", "c_name AS name"), "id", "name"), "w")


# --------------------------------------------------------------------------- min-hash, models, lookups

def _minhash_sql(table: str, key: str, c: str, analyzer: str, lo: int, hi: int, n: int) -> str:
    return f"""
WITH g AS (SELECT DISTINCT {key}, gram FROM ({gram_rows(table, key, c, analyzer, lo, hi)})),
h AS (SELECT {key}, s, md5(s || ':' || gram) AS h FROM g, (SELECT unnest(range({-(-n // 4)})) AS s)),
m AS (SELECT {key}, (s * 4 + j)::INT AS dim, min(substr(h, 1 + 8 * j::INT, 8)) AS v
      FROM h, (SELECT unnest(range(4)) AS j) WHERE s * 4 + j < {n} GROUP BY ALL)
SELECT {key}, dim, coalesce(('0x' || v)::BIGINT / 4294967296.0::DOUBLE, 0.0) AS value
FROM (SELECT {key}, unnest(range({n}))::INT AS dim FROM {table}) LEFT JOIN m USING ({key}, dim)"""


@query("minhash_encode", _minhash_sql("customer", "c_custkey", "c_name", "char", 2, 4, 30))
def minhash_encode(t: Tables) -> DataFrame:
    return encoders.encode(t.customer, "c_name", "skrub__minhash_30", hashing="md5").select(
        "c_custkey", F.posexplode("v").alias("dim", "value"))


@query("minhash_encode_word", _minhash_sql("benchmark", "item_id", "text", "word", 1, 3, 10))
def minhash_encode_word(t: Tables) -> DataFrame:
    return encoders.encode(t.benchmark, "text", "skrub__minhash_10_word_none", hashing="md5").select(
        "item_id", F.posexplode("v").alias("dim", "value"))


def _letter_profile(texts: list[str]) -> np.ndarray:
    """Stand-in for a model: relative frequency of the 26 letters."""
    out = np.zeros((len(texts), 26))
    for i, text in enumerate(texts):
        codes = np.frombuffer(text.lower().encode("ascii", "ignore"), dtype=np.uint8)
        codes = codes[(codes >= 97) & (codes <= 122)] - 97
        out[i] = np.bincount(codes, minlength=26)[:26]
    return out / np.maximum(out.sum(1, keepdims=True), 1.0)


@query("encode_distinct", """
SELECT doc_id, d::INT AS dim, round((len(letters) - len(replace(letters, chr(97 + d::INT), ''))) / greatest(len(letters), 1), 9) AS value
FROM (SELECT doc_id, regexp_replace(lower(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')), '[^a-z]', '', 'g') AS letters FROM documents),
  (SELECT unnest(range(26)) AS d)""")
def encode_distinct(t: Tables) -> DataFrame:
    return rounded(encoders.encode_distinct(t.documents, "text", _letter_profile).select(
        "doc_id", F.posexplode("v").alias("dim", "value")), "value")


_LETTERS = "regexp_replace(lower(regexp_replace(p_name, '[^\\x00-\\x7F]', '', 'g')), '[^a-z]', '', 'g')"


@query("encode_dispatch", f"""
SELECT p_partkey, 'a' AS enc, d::INT AS dim,
  round((len(letters) - len(replace(letters, chr(97 + d::INT), ''))) / greatest(len(letters), 1), 9) AS value
FROM (SELECT p_partkey, {_LETTERS} AS letters FROM part), (SELECT unnest(range(26)) AS d)
UNION ALL SELECT p_partkey, 'b', dim, round(value, 9) FROM ({_minhash_sql('part', 'p_partkey', 'p_brand', 'char', 2, 4, 8)})""")
def encode_dispatch(t: Tables) -> DataFrame:
    models = {"letters": _letter_profile}
    df = encoders.encode(t.part, "p_name", "letters__26", "a", models)
    df = encoders.encode(df, "p_brand", "skrub__minhash_8_char_none", "b", hashing="md5")
    parts = [df.select("p_partkey", F.lit(c).alias("enc"), F.posexplode(c).alias("dim", "value")) for c in "ab"]
    return rounded(parts[0].union(parts[1]), "value")


@query("encode_high_cardinality", f"""
SELECT p_partkey, p_brand, code, dim, value FROM ({_minhash_sql('part', 'p_partkey', 'p_name', 'char', 2, 4, 10)})
JOIN (SELECT p_partkey, p_brand, p_partkey::DOUBLE AS code FROM part) USING (p_partkey)""")
def encode_high_cardinality(t: Tables) -> DataFrame:
    # a number written as text is a number, however many values it has
    parts = t.part.select("p_partkey", "p_name", "p_brand", F.col("p_partkey").cast("string").alias("code"))
    wide = encoders.encode_high_cardinality(parts, "skrub__minhash_10", 30, hashing="md5")
    return wide.select("p_partkey", "p_brand", "code", F.posexplode("p_name").alias("dim", "value"))


@query("encode_high_cardinality_cached", f"""
SELECT p_partkey, dim, value FROM ({_minhash_sql('part', 'p_partkey', 'p_name', 'char', 2, 4, 6)})""")
def encode_high_cardinality_cached(t: Tables) -> DataFrame:
    # filled from half of the rows, completed by all, then read alone
    cache = VectorCache(t.spark, f"{scratch_dir(t.spark)}/tarnish/vectors-{uuid.uuid4().hex}")
    parts = t.part.select("p_partkey", "p_name")
    for rows, flags in ((parts.where("p_partkey % 2 = 0"), {}), (parts, {}), (parts, {"fail_if_not_cached": True})):
        wide = encoders.encode_high_cardinality(
            rows, "skrub__minhash_6", 30, hashing="md5", cache=cache, dataset="part", **flags)
    return wide.select("p_partkey", F.posexplode("p_name").alias("dim", "value"))


# A word vector for every word of the benchmark texts: a row of the embeddings picked by hash.
_WORDS = """
SELECT word, embedding::DOUBLE[] AS v FROM (
  SELECT DISTINCT unnest(regexp_split_to_array(lower(replace(text, chr(10), ' ')), '\\s+')) AS word FROM benchmark)
JOIN embeddings ON vec_id = ('0x' || substr(md5(word), 1, 8))::BIGINT % (SELECT count(*) FROM embeddings)
WHERE word <> ''"""


@query("embedding_lookup_mean", f"""
WITH w AS (SELECT word, unnest(range(64))::INT AS dim, unnest(v) AS x FROM ({_WORDS})),
t AS (SELECT doc_id, word, count(*) AS n FROM (
  SELECT doc_id, unnest(regexp_split_to_array(lower(replace(text, chr(10), ' ')), '\\s+')) AS word FROM documents)
  WHERE word <> '' GROUP BY ALL)
SELECT doc_id, dim, round(sum(n * x) / sum(n), 6) AS value FROM t JOIN w USING (word) GROUP BY doc_id, dim""")
def embedding_lookup_mean(t: Tables) -> DataFrame:
    size = t.embeddings.agg(F.count(F.lit(1))).scalar()
    words = t.benchmark.select(F.explode_outer(F.split(F.lower(
        F.replace("text", F.lit("\n"), F.lit(" "))), r"\s+")).alias("word")).where("word <> ''").distinct()
    words = words.withColumn("vec_id", F.conv(F.substring(F.md5("word"), 1, 8), 16, 10).cast("bigint") % size)
    words = words.join(t.embeddings.select("vec_id", F.col("embedding").alias("v")), "vec_id")
    return rounded(encoders.embedding_lookup_mean(t.documents, "doc_id", "text", words).select(
        "doc_id", F.posexplode("v").alias("dim", "value")), "value", digits=6)


# --------------------------------------------------------------------------- categories

@query("one_hot", """
WITH k AS (SELECT DISTINCT 'o_orderstatus' AS n, o_orderstatus AS v FROM orders WHERE o_totalprice > 100000 AND o_orderstatus <> 'P'
  UNION ALL SELECT DISTINCT 'o_orderpriority', o_orderpriority FROM orders WHERE o_totalprice > 100000 AND o_orderstatus <> 'P')
SELECT o_orderkey, n || '=' || v AS feature FROM (
  SELECT o_orderkey, 'o_orderstatus' AS n, o_orderstatus AS v FROM orders
  UNION ALL SELECT o_orderkey, 'o_orderpriority', o_orderpriority FROM orders) JOIN k USING (n, v)""")
def one_hot(t: Tables) -> DataFrame:
    return encoders.one_hot_long(t.orders, "o_orderkey", ["o_orderstatus", "o_orderpriority"],
                                 (F.col("o_totalprice") > 100000) & (F.col("o_orderstatus") != "P"))


@query("ordinal_encode", """
WITH k AS (SELECT o_orderpriority, row_number() OVER (ORDER BY o_orderpriority) - 1 AS i FROM (
  SELECT DISTINCT o_orderpriority FROM orders WHERE o_orderpriority <> '3-MEDIUM'))
SELECT o_orderkey, coalesce(i, -1) AS code FROM orders LEFT JOIN k USING (o_orderpriority)""")
def ordinal_encode(t: Tables) -> DataFrame:
    return encoders.ordinal_encode(t.orders, "o_orderpriority", F.col("o_orderpriority") != "3-MEDIUM",
                                   "code").select("o_orderkey", "code")


# --------------------------------------------------------------------------- scaling

@query("standard_scale", """
WITH s AS (SELECT avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq, avg(l_extendedprice) AS mp,
  stddev_pop(l_extendedprice) AS sp FROM lineitem WHERE l_returnflag = 'N')
SELECT l_orderkey, l_linenumber, round((l_quantity - mq) / sq, 6) AS l_quantity,
  round((l_extendedprice - mp) / sp, 6) AS l_extendedprice FROM lineitem, s""")
def standard_scale(t: Tables) -> DataFrame:
    cols = ["l_quantity", "l_extendedprice"]
    out = scaling.standard_scale(t.lineitem, cols, F.col("l_returnflag") == "N")
    return rounded(out, *cols, digits=6).select("l_orderkey", "l_linenumber", *cols)


# Orders with a truth value and the size of the customer number as text; fitted on some of them.
_ORDERS = """SELECT o_orderkey, o_orderpriority, o_orderstatus, o_totalprice, o_orderdate, o_totalprice > 100000 AS dear,
  o_custkey::VARCHAR AS code, o_orderkey % 3 > 0 AND o_orderpriority <> '5-LOW' AS fit FROM orders"""


def _hot(column: str, first: int) -> str:
    """Categories of the fitted rows by falling number of rows; an unknown one has no slot."""
    return f"""SELECT o_orderkey, ({first} + i)::INT AS slot, CAST({column} = v AS DOUBLE) AS value FROM o, (
      SELECT {column} AS v, row_number() OVER (ORDER BY count(*) DESC, {column}) - 1 AS i FROM o WHERE fit GROUP BY {column})"""


def _scaled(slot: str, x: str) -> str:
    return f"""SELECT o_orderkey, ({slot})::INT AS slot, ({x} - avg({x}) FILTER (fit) OVER ()) / coalesce(
      nullif(stddev_pop({x}) FILTER (fit) OVER (), 0), 1) AS value FROM o"""


_NUMBERS = ["o_totalprice", "CAST(dear AS DOUBLE)", "year(o_orderdate)", "month(o_orderdate)", "day(o_orderdate)",
            "epoch(o_orderdate)", "code::DOUBLE"]
_SLOTS = "(SELECT count(DISTINCT o_orderpriority) FROM o WHERE fit) + (SELECT count(DISTINCT o_orderstatus) FROM o WHERE fit)"


@query("table_vectorizer", f"""
WITH o AS ({_ORDERS}) SELECT o_orderkey, slot, round(value, 6) AS value FROM (
  {_hot("o_orderpriority", 0)} UNION ALL {_hot("o_orderstatus", "(SELECT count(DISTINCT o_orderpriority) FROM o WHERE fit)")}
  UNION ALL {" UNION ALL ".join(_scaled(f"{_SLOTS} + {i}", x) for i, x in enumerate(_NUMBERS))}) WHERE round(value, 6) <> 0""")
def table_vectorizer_query(t: Tables) -> DataFrame:
    from pyspark.ml import Pipeline
    rows = t.orders.selectExpr(
        "o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice", "o_orderdate", "o_totalprice > 100000 AS dear",
        "string(o_custkey) AS code", "o_orderkey % 3 > 0 AND o_orderpriority <> '5-LOW' AS fit")
    df, features = table_vectorizer(rows, ["o_orderpriority", "o_orderstatus", "o_totalprice", "dear", "o_orderdate", "code"], 30)
    fitted = Pipeline(stages=features.stages(scale=True)).fit(df.where("fit"))
    long = fitted.transform(df).select("o_orderkey", F.posexplode(vector_to_array("features")).alias("slot", "value"))
    return rounded(long, "value", digits=6).where("value <> 0")


def _selected(method: str):
    def build(t: Tables) -> DataFrame:
        out = scaling.select_dimensions(t.embeddings, "embedding", 8, method)
        return out.select("vec_id", F.posexplode(vectors.to_double("embedding")).alias("dim", "x"))
    return build


for _method, _from in (("first", 1), ("last", 57), ("middle", 5)):
    query(f"select_features_{_method}", f"""
SELECT vec_id, unnest(range(8))::INT AS dim, unnest(embedding[{_from}:{_from + 7}]::DOUBLE[]) AS x FROM embeddings"""
          )(_selected(_method))

_VAR = f"SELECT dim, round(var_pop(value), 12) AS v FROM ({_MATRIX}) GROUP BY dim"
query("select_features_biggest_variance", f"""
WITH c AS (SELECT dim, row_number() OVER (ORDER BY v, dim)::INT - 57 AS i FROM ({_VAR}))
SELECT vec_id, i AS dim, value AS x FROM ({_MATRIX}) m JOIN c ON c.dim = m.dim WHERE i >= 0""")(_selected("biggest_variance"))
query("select_features_smallest_variance", f"""
WITH c AS (SELECT dim, row_number() OVER (ORDER BY v, dim)::INT - 1 AS i FROM ({_VAR}))
SELECT vec_id, i AS dim, value AS x FROM ({_MATRIX}) m JOIN c ON c.dim = m.dim WHERE i < 8""")(_selected("smallest_variance"))
query("select_features_random", f"""
WITH c AS (SELECT d AS dim, row_number() OVER (ORDER BY md5('42:' || d))::INT - 1 AS i FROM (SELECT unnest(range(64)) AS d))
SELECT vec_id, i AS dim, value AS x FROM ({_MATRIX}) m JOIN c ON c.dim = m.dim WHERE i < 8""")(_selected("random"))


@query("top_k_dims_by_variance", f"""
SELECT dim, round(v, 9) AS variance FROM ({_VAR}) ORDER BY v DESC, dim LIMIT 10""")
def top_k_dims(t: Tables) -> DataFrame:
    out = scaling.dimension_variances(t.embeddings, "embedding").withColumn("variance", F.round("variance", 12))
    return rounded(out.orderBy(F.desc("variance"), "dim").limit(10), "variance")


_CONFIGS = """
WITH g AS (SELECT p_type AS m, p_brand AS b, p_size AS s FROM (SELECT DISTINCT p_type FROM part),
  (SELECT DISTINCT p_brand FROM part), (SELECT DISTINCT p_size FROM part)),
n AS (SELECT CASE WHEN m IN ('LARGE', 'SMALL') THEN 'LogisticRegression' ELSE 'GradientBoostingClassifier' END AS model, m,
  CASE WHEN b < 'Brand#15' THEN 'skrub__' || b WHEN b < 'Brand#2' THEN 'fasttext__' || b ELSE 'lm__' || b END AS encoding,
  CASE WHEN s > 30 THEN 'passthrough' ELSE 'PCA_' || s END AS dim_reduction FROM g)"""


@query("pairing_rules", _CONFIGS + """
SELECT m, model, encoding, dim_reduction FROM n
WHERE NOT (dim_reduction = 'passthrough' AND model = 'GradientBoostingClassifier' AND encoding LIKE 'lm\\_\\_%' ESCAPE '\\')
  AND NOT (dim_reduction <> 'passthrough' AND starts_with(encoding, 'skrub'))""")
def pairing_rules_query(t: Tables) -> DataFrame:
    return pairing_rules(_configurations(t))


@query("ensemble_pairing_rules", f"""{_CONFIGS}
SELECT m, model, encoding, dim_reduction FROM n
WHERE NOT (dim_reduction = 'passthrough' AND model = 'GradientBoostingClassifier' AND NOT starts_with(encoding, 'skrub'))
  AND NOT (dim_reduction <> 'passthrough' AND starts_with(encoding, 'skrub'))""")
def ensemble_pairing_rules(t: Tables) -> DataFrame:
    return pairing_rules(_configurations(t), exempt=SHORT_VECTORS[:1])


def _configurations(t: Tables) -> DataFrame:
    configs = grid(t.part.select(F.col("p_type").alias("m")).distinct(), b=t.part.select("p_brand"),
                   s=t.part.select("p_size"))
    b = F.col("b")
    return (configs.select(
        "m", F.when(F.col("m").isin("LARGE", "SMALL"), "LogisticRegression").otherwise(
            "GradientBoostingClassifier").alias("model"),
        F.concat(F.when(b < "Brand#15", "skrub__").when(b < "Brand#2", "fasttext__").otherwise("lm__"), b)
        .alias("encoding"),
        F.when(F.col("s") > 30, "passthrough").otherwise(F.concat(F.lit("PCA_"), F.col("s"))).alias("dim_reduction")))


# --------------------------------------------------------------------------- matrix transforms

# Coordinates with some constant dimensions on the training rows.
_PARTLY = _MATRIX.replace("unnest(embedding::DOUBLE[]) AS value", "unnest(embedding::DOUBLE[]) AS v0")
_CONST = f"SELECT vec_id, dim, CASE WHEN dim < 5 AND {_TRAIN} THEN 1.0 ELSE v0 END AS value, label FROM ({_PARTLY})"


@query("drop_constant_features", f"SELECT vec_id, dim, round(value, 6) AS value FROM ({_CONST}) WHERE dim >= 5")
def drop_constant_features(t: Tables) -> DataFrame:
    m = _matrix(t).withColumn("value", F.when((F.col("dim") < 5) & F.col("train"), 1.0).otherwise(F.col("value")))
    return _flat(scaling.drop_constant_features(m))


@query("normalise_on_train", f"""
WITH s AS (SELECT dim, avg(value) AS m, stddev_samp(value) + 1e-6 AS s FROM ({_MATRIX}) WHERE {_TRAIN} GROUP BY dim)
SELECT vec_id, dim, round(greatest(-100, least(100, (value - m) / s)), 6) AS value FROM ({_MATRIX}) JOIN s USING (dim)""")
def normalise_on_train(t: Tables) -> DataFrame:
    return _flat(scaling.normalise_on_train(_matrix(t)))


@query("robust_scale", f"""
WITH s AS (SELECT dim, median(value) AS q2, (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) / 1.3489795003921634 AS w
  FROM ({_MATRIX}) WHERE {_TRAIN} GROUP BY dim)
SELECT vec_id, dim, round((value - q2) / w, 6) AS value FROM ({_MATRIX}) JOIN s USING (dim)""")
def robust_scale(t: Tables) -> DataFrame:
    return _flat(scaling.robust_scale(_matrix(t)))


def _ratio_sql(t: str, rational) -> str:
    def horner(terms) -> str:
        out = repr(terms[-1])
        for c in reversed(terms[:-1]):
            out = f"({out} * {t} + {c!r})"
        return out
    return f"({horner(rational[0])} / {horner(rational[1])})"


_PROBIT = f"""CASE WHEN abs(p - 0.5) <= 0.425 THEN (p - 0.5) * {_ratio_sql("(0.180625::DOUBLE - (p - 0.5) * (p - 0.5))", QUANTILE_MIDDLE)}
  ELSE sign(p - 0.5) * {_ratio_sql("(sqrt(-ln(least(p, 1.0 - p))) - 1.6::DOUBLE)", QUANTILE_TAIL)} END"""


@query("quantile_to_normal", f"""
WITH c AS (SELECT dim, value, count(*) FILTER ({_TRAIN}) AS t FROM ({_MATRIX}) GROUP BY dim, value),
r AS (SELECT dim, value, (coalesce(sum(t) OVER (PARTITION BY dim ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
  + t / 2.0)::DOUBLE / sum(t) OVER (PARTITION BY dim) AS p FROM c),
z AS (SELECT dim, value, greatest(1e-7::DOUBLE, least(1 - 1e-7::DOUBLE, p)) AS p FROM r)
SELECT vec_id, dim, round({_PROBIT}, 6) AS value FROM ({_MATRIX}) JOIN z USING (dim, value)""")
def quantile_to_normal(t: Tables) -> DataFrame:
    return _flat(scaling.quantile_to_normal(_matrix(t), "vec_id"))


def _yeo_sql(lam: str) -> str:
    return f"""CASE WHEN value >= 0 THEN CASE WHEN abs({lam}) < 1e-9 THEN ln(1 + value) ELSE (pow(value + 1, {lam}) - 1) / ({lam}) END
      ELSE CASE WHEN abs({lam} - 2) < 1e-9 THEN -ln(1 - value) ELSE -(pow(1 - value, 2 - ({lam})) - 1) / (2 - ({lam})) END END"""


def _power_sql() -> str:
    """The same search, a pass per step: 17 exponents around the best, then an eighth of the step."""
    parts, step, i = [f"b0 AS (SELECT DISTINCT dim, 0.0::DOUBLE AS lam FROM ({_MATRIX}))"], 1.0, 0
    while True:
        parts.append(f"""o{i} AS (SELECT dim, lam + k * {step!r}::DOUBLE AS l, value FROM ({_MATRIX}) JOIN b{i} USING (dim),
          (SELECT unnest(range(-8, 9)) AS k) WHERE {_TRAIN}),
        y{i} AS (SELECT dim, l, value, {_yeo_sql("l")} AS y FROM o{i}),
        s{i} AS (SELECT dim, l, avg(y) AS m, stddev_pop(y) AS s, round(-count(*) / 2.0 * ln(var_pop(y))
          + (l - 1) * sum(sign(value) * ln(1 + abs(value))), 9) AS ll FROM y{i} GROUP BY dim, l),
        b{i + 1} AS (SELECT dim, l AS lam, m, s FROM (SELECT *, row_number() OVER (PARTITION BY dim ORDER BY ll DESC, l DESC) AS r FROM s{i}) WHERE r = 1)""")
        i += 1
        if step <= 1e-4:
            return f"""WITH {", ".join(parts)} SELECT vec_id, dim, round((({_yeo_sql("lam")}) - m) / s, 3) AS value
              FROM ({_MATRIX}) JOIN b{i} USING (dim)"""
        step /= 8


@query("power_transform", _power_sql())
def power_transform(t: Tables) -> DataFrame:
    return _flat(scaling.power_transform(_matrix(t)), digits=3)


@query("rank_transform", f"""
SELECT vec_id, dim, count(*) OVER (PARTITION BY dim ORDER BY value)::DOUBLE AS value FROM ({_MATRIX})""")
def rank_transform(t: Tables) -> DataFrame:
    return _flat(scaling.rank_transform(_matrix(t), "vec_id"))


@query("soft_clip_outliers", f"""
WITH a AS (SELECT dim, avg(value) - 2 * stddev_samp(value) AS l, avg(value) + 2 * stddev_samp(value) AS h
  FROM ({_MATRIX}) WHERE {_TRAIN} GROUP BY dim),
b AS (SELECT dim, avg(value) - 2 * stddev_samp(value) AS l, avg(value) + 2 * stddev_samp(value) AS h
  FROM ({_MATRIX}) m JOIN a USING (dim) WHERE {_TRAIN} AND value BETWEEN a.l AND a.h GROUP BY dim),
c AS (SELECT vec_id, dim, h, greatest(-ln(1 + abs(value)) + l, value) AS x FROM ({_MATRIX}) JOIN b USING (dim))
SELECT vec_id, dim, round(least(ln(1 + abs(x)) + h, x), 6) AS value FROM c""")
def soft_clip_outliers(t: Tables) -> DataFrame:
    return _flat(scaling.soft_clip_outliers(_matrix(t), n_sigma=2.0))


@query("rescale_by_used_features", f"SELECT vec_id, dim, round(value * 100.0 / 64, 6) AS value FROM ({_MATRIX})")
def rescale_by_used_features(t: Tables) -> DataFrame:
    return _flat(scaling.rescale_by_used_features(_matrix(t), 100))


@query("preprocess_features", f"""
WITH s AS (SELECT dim, avg(value) AS m, stddev_samp(value) + 1e-6 AS s FROM ({_MATRIX}) WHERE {_TRAIN} GROUP BY dim HAVING min(value) < max(value)),
z AS (SELECT vec_id, label, dim, greatest(-100, least(100, (value - m) / s)) AS value FROM ({_MATRIX}) JOIN s USING (dim)),
a AS (SELECT dim, avg(value) - 4 * stddev_samp(value) AS l, avg(value) + 4 * stddev_samp(value) AS h FROM z WHERE {_TRAIN} GROUP BY dim),
b AS (SELECT dim, avg(value) - 4 * stddev_samp(value) AS l, avg(value) + 4 * stddev_samp(value) AS h
  FROM z JOIN a USING (dim) WHERE {_TRAIN} AND value BETWEEN a.l AND a.h GROUP BY dim),
c AS (SELECT vec_id, dim, h, greatest(-ln(1 + abs(value)) + l, value) AS x FROM z JOIN b USING (dim))
SELECT vec_id, dim, round(least(ln(1 + abs(x)) + h, x) * 100.0 / (SELECT count(*) FROM s), 6) AS value FROM c""")
def preprocess_features(t: Tables) -> DataFrame:
    return _flat(scaling.preprocess_features(_matrix(t), "vec_id"))


# --------------------------------------------------------------------------- reduction

# All components together are a rotation: it keeps every row's squared distance from the mean, and
# on the fitted rows the components' variances add up to those of the coordinates.
def _rotated(df: DataFrame, row_id: str, v: str) -> DataFrame:
    return df.select(row_id, F.round(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x), 6).alias("norm"),
                     F.size(v).alias("n"))


def _centred_sql(means: str, on: str) -> str:
    return f"""SELECT vec_id, round(sum((value - m) * (value - m)), 6) AS norm, count(*)::INT AS n
FROM ({_MATRIX}) x JOIN ({means}) s ON s.dim = x.dim AND {on} GROUP BY vec_id"""


@query("pca_reduce", _centred_sql(f"SELECT dim, avg(value) AS m FROM ({_MATRIX}) WHERE {_TRAIN} GROUP BY dim", "true"))
def pca_reduce(t: Tables) -> DataFrame:
    rows = t.embeddings.select("vec_id", "label", "embedding")
    return _rotated(reduction.pca_reduce(rows, "embedding", 64, F.expr(_TRAIN)), "vec_id", "embedding")


@query("pca_batch_centred", _centred_sql(
    f"SELECT dim, {_TRAIN} AS tr, avg(value) AS m FROM ({_MATRIX}) GROUP BY ALL", "s.tr = (x.label < 7)"))
def pca_batch_centred(t: Tables) -> DataFrame:
    rows = t.embeddings.select("vec_id", "label", "embedding")
    return _rotated(reduction.pca_reduce(rows, "embedding", 64, F.expr(_TRAIN), centre="batch"), "vec_id", "embedding")


@query("pca_variances", f"""
SELECT round(sum(v), 6) AS variance, true AS falling, true AS uncorrelated
FROM (SELECT var_pop(value) AS v FROM ({_MATRIX}) WHERE {_TRAIN} GROUP BY dim)""")
def pca_variances(t: Tables) -> DataFrame:
    out = reduction.pca_reduce(t.embeddings.select("vec_id", "label", "embedding"), "embedding", 64, F.expr(_TRAIN))
    scores = out.where(_TRAIN).select(*[F.col("embedding")[i].alias(f"p{i}") for i in range(64)])
    one = scores.agg(*[F.var_pop(f"p{i}").alias(f"v{i}") for i in range(64)],
                     *[F.abs(F.covar_pop(f"p{i}", f"p{i + 1}")).alias(f"c{i}") for i in range(63)])
    falling = F.lit(True)
    for i in range(63):
        falling = falling & (F.col(f"v{i}") >= F.col(f"v{i + 1}") - 1e-12)
    small = F.greatest(*[f"c{i}" for i in range(63)]) < 1e-9
    return one.select(F.round(sum((F.col(f"v{i}") for i in range(64)), F.lit(0.0)), 6).alias("variance"),
                      falling.alias("falling"), small.alias("uncorrelated"))


# The singular vectors of all dimensions are a rotation too; the rows are of different lengths.
@query("truncated_svd", """
SELECT c_custkey, round(pow(1 + c_nationkey, 2), 6) AS norm FROM customer""")
def truncated_svd(t: Tables) -> DataFrame:
    long = encoders.hashing_vectorizer(t.customer, "c_custkey", "c_name", "char", (1, 1), 2 ** 10)
    long = long.join(t.customer.select("c_custkey", "c_nationkey"), "c_custkey").withColumn(
        "w", F.col("w") * (1 + F.col("c_nationkey"))).drop("c_nationkey")
    return _rotated(reduction.truncated_svd(long, "c_custkey", 64), "c_custkey", "v").drop("n")


@query("truncated_svd_components")
def truncated_svd_components(t: Tables) -> DataFrame:
    long = encoders.hashing_vectorizer(t.customer, "c_custkey", "c_name", "char", (2, 3), 2 ** 14)
    return reduction.truncated_svd(long, "c_custkey", 30).select(
        "c_custkey", F.posexplode("v").alias("dim", "x")).withColumn("x", F.round("x", 6))
