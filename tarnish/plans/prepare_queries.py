"""Cleaning, target preparation, sampling and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tarnish.operators import clean, splits, tables, target
from tarnish.operators.clean import FALSE_MISSING
from tarnish.operators.loading import prepare_dataset
from tarnish.plans.fixtures import DIRTY_SQL, RESULTS_SQL, dirty, results
from tarnish.plans.registry import Tables, query

_LISTED = ", ".join("'" + v.replace("'", "''") + "'" for v in FALSE_MISSING)


def _real(c: str) -> str:
    return f"CASE WHEN {c} IN ({_LISTED}) OR regexp_matches({c}, '^\\s+$') THEN NULL ELSE {c} END"


_CLEAN = (f"SELECT id, {_real('name')} AS name, {_real('segment')} AS segment, "
          f"{_real('note')} AS note, balance, target FROM ({DIRTY_SQL})")
_FEATURES = ["name", "segment", "note", "balance"]


@query("replace_false_missing", _CLEAN)
def replace_false_missing(t: Tables) -> DataFrame:
    return clean.replace_false_missing(dirty(t))


@query("drop_null_target_rows", f"SELECT * FROM ({DIRTY_SQL}) WHERE target IS NOT NULL")
def drop_null_target_rows(t: Tables) -> DataFrame:
    return clean.drop_null_target_rows(dirty(t), "target")


@query("drop_sparse_columns", f"SELECT id, name, segment, balance, target FROM ({_CLEAN})")
def drop_sparse_columns(t: Tables) -> DataFrame:
    return clean.drop_sparse_columns(clean.replace_false_missing(dirty(t)), _FEATURES)


@query("drop_rows_any_null", f"""
SELECT id, name, segment, balance, target FROM ({_CLEAN})
WHERE name IS NOT NULL AND segment IS NOT NULL AND balance IS NOT NULL""")
def drop_rows_any_null(t: Tables) -> DataFrame:
    kept = clean.drop_sparse_columns(clean.replace_false_missing(dirty(t)), _FEATURES)
    return clean.drop_rows_any_null(kept, ["name", "segment", "balance"])


@query("remove_missing_values", f"""
WITH c AS ({_CLEAN}),
f AS (SELECT 'name' AS name, avg(CAST(name IS NULL AS INT)) AS v FROM c
      UNION ALL SELECT 'segment', avg(CAST(segment IS NULL AS INT)) FROM c
      UNION ALL SELECT 'note', avg(CAST(note IS NULL AS INT)) FROM c
      UNION ALL SELECT 'balance', avg(CAST(balance IS NULL AS INT)) FROM c)
SELECT 'column' AS kind, name, round(v, 9) AS null_frac, v > CAST(0.7 AS DOUBLE) AS dropped FROM f
UNION ALL
SELECT 'row', CAST(id AS VARCHAR), NULL, name IS NULL OR segment IS NULL OR balance IS NULL FROM c
UNION ALL
SELECT 'kept', CAST(id AS VARCHAR), NULL, false FROM c
WHERE NOT (name IS NULL OR segment IS NULL OR balance IS NULL)""")
def remove_missing_values(t: Tables) -> DataFrame:
    kept, columns, rows = clean.remove_missing_values(dirty(t), _FEATURES, "id")
    empty = F.lit(None).cast("double").alias("null_frac")
    name = F.col("id").cast("string").alias("name")
    return tables.union_all(
        columns.withColumn("null_frac", F.round("null_frac", 9)),
        rows.select(F.lit("row").alias("kind"), name, empty, "dropped"),
        kept.select(F.lit("kept").alias("kind"), name, empty, F.lit(False).alias("dropped")))


@query("split_text_rest", f"""
SELECT id, name, segment, balance, target FROM ({_CLEAN})
WHERE target IS NOT NULL AND segment IS NOT NULL AND balance IS NOT NULL""")
def split_text_rest(t: Tables) -> DataFrame:
    return clean.split_text_rest(dirty(t), "name", "target", "id")


@query("split_text_only", f"""
SELECT id, name, target FROM ({_CLEAN})
WHERE target IS NOT NULL AND segment IS NOT NULL AND balance IS NOT NULL""")
def split_text_only(t: Tables) -> DataFrame:
    return clean.split_text_rest(dirty(t), "name", "target", "id", include_all_columns=False)


@query("drop_columns", "SELECT o_orderkey, o_totalprice FROM orders")
def drop_columns(t: Tables) -> DataFrame:
    return t.orders.drop("o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")


@query("rename_columns", "SELECT n_nationkey AS id, n_name AS title, n_regionkey AS region FROM nation")
def rename_columns(t: Tables) -> DataFrame:
    return t.nation.withColumnsRenamed({"n_nationkey": "id", "n_name": "title", "n_regionkey": "region"})


@query("filter_isin", "SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem WHERE l_returnflag IN ('A', 'R')")
def filter_isin(t: Tables) -> DataFrame:
    return t.lineitem.where(F.col("l_returnflag").isin("A", "R")).select(
        "l_orderkey", "l_linenumber", "l_returnflag")


@query("filter_not_isin", """
SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')""")
def filter_not_isin(t: Tables) -> DataFrame:
    finished = t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.join(finished, "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("filter_compare_bool", """
SELECT l_orderkey, l_linenumber FROM lineitem
WHERE (l_quantity > 30 AND l_discount < 0.05) OR (l_returnflag <> 'N' AND l_tax = 0)""")
def filter_compare_bool(t: Tables) -> DataFrame:
    c = F.col
    return t.lineitem.where(((c("l_quantity") > 30) & (c("l_discount") < 0.05))
                            | ((c("l_returnflag") != "N") & (c("l_tax") == 0))).select(
        "l_orderkey", "l_linenumber")


@query("filter_string_match", """
SELECT p_partkey, p_name FROM part
WHERE contains(p_name, 'ring') OR (NOT contains(p_name, 'old') AND starts_with(p_name, 'b'))
   OR regexp_matches(p_name, 'g[ie]')""")
def filter_string_match(t: Tables) -> DataFrame:
    name = F.col("p_name")
    return t.part.where(name.contains("ring") | (~name.contains("old") & name.startswith("b"))
                        | name.rlike("g[ie]")).select("p_partkey", "p_name")


@query("filter_not_null", f"SELECT id, note FROM ({DIRTY_SQL}) WHERE note IS NOT NULL AND balance IS NOT NULL")
def filter_not_null(t: Tables) -> DataFrame:
    return dirty(t).na.drop(subset=["note", "balance"]).select("id", "note")


@query("map_values", """
SELECT event_id, CASE event_type WHEN 'click' THEN 'Click' WHEN 'error' THEN 'Failure' ELSE event_type END AS event_type FROM events""")
def map_values(t: Tables) -> DataFrame:
    return clean.map_values(t.events.select("event_id", "event_type"), "event_type",
                            {"click": "Click", "error": "Failure"})


@query("add_constant_column", "SELECT s_suppkey, 'autofj' AS encoder_name, 1 AS version FROM supplier")
def add_constant_column(t: Tables) -> DataFrame:
    return t.supplier.select("s_suppkey").withColumn("encoder_name", F.lit("autofj")).withColumn(
        "version", F.lit(1))


@query("conditional_column", """
SELECT p_partkey, CASE WHEN contains(p_type, 'STANDARD') THEN p_brand ELSE p_type END AS family FROM part""")
def conditional_column(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.when(F.col("p_type").contains("STANDARD"), F.col("p_brand"))
                         .otherwise(F.col("p_type")).alias("family"))


@query("cast_columns", """
SELECT CAST(c_custkey AS VARCHAR) AS key_text, CAST(trunc(c_acctbal) AS INTEGER) AS balance_int,
       CAST(c_nationkey AS BIGINT) AS nation, TRY_CAST(c_name AS INTEGER) AS bad,
       TRY_CAST(substr(c_name, 10) AS BIGINT) AS number
FROM customer""")
def cast_columns(t: Tables) -> DataFrame:
    c = F.col
    return t.customer.select(
        c("c_custkey").cast("string").alias("key_text"), c("c_acctbal").cast("int").alias("balance_int"),
        c("c_nationkey").cast("bigint").alias("nation"), c("c_name").try_cast("int").alias("bad"),
        F.substring("c_name", 10, 100).try_cast("bigint").alias("number"))


# --------------------------------------------------------------------------- target

@query("infer_task", """
SELECT 'orders' AS source, CASE WHEN count(DISTINCT o_totalprice) <= 20 THEN 'classification' ELSE 'regression' END AS task FROM orders
UNION ALL SELECT 'part', CASE WHEN count(DISTINCT p_type) <= 20 THEN 'classification' ELSE 'regression' END FROM part""")
def infer_task(t: Tables) -> DataFrame:
    return tables.union_all(
        target.infer_task(t.orders, "o_totalprice").select(F.lit("orders").alias("source"), "task"),
        target.infer_task(t.part, "p_type").select(F.lit("part").alias("source"), "task"))


@query("binarize_median", """
SELECT o_orderkey, o_totalprice > (SELECT median(o_totalprice) FROM orders) AS y FROM orders""")
def binarize_median(t: Tables) -> DataFrame:
    return target.binarize_median(t.orders, "o_totalprice").select("o_orderkey", "y")


@query("label_encode", """
SELECT p_partkey, p_type, CAST(dense_rank() OVER (ORDER BY p_type) - 1 AS BIGINT) AS y FROM part""")
def label_encode(t: Tables) -> DataFrame:
    return target.label_encode(t.part, "p_type").select("p_partkey", "p_type", "y")


@query("class_counts", "SELECT label, count(*) AS n FROM embeddings GROUP BY label")
def class_counts(t: Tables) -> DataFrame:
    return target.class_counts(t.embeddings, "label")


@query("validate_target", """
SELECT 'label' AS source, count(DISTINCT label) AS n_classes, count(*) AS n_rows,
       count(DISTINCT label) < least(20, count(*)) AS valid FROM embeddings
UNION ALL SELECT 'price', count(DISTINCT o_totalprice), count(*),
       count(DISTINCT o_totalprice) < least(20, count(*)) FROM orders""")
def validate_target(t: Tables) -> DataFrame:
    return tables.union_all(
        target.validate_target(t.embeddings, "label").withColumn("source", F.lit("label")),
        target.validate_target(t.orders, "o_totalprice").withColumn("source", F.lit("price")))


@query("balance_classes", """
WITH r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality
             ORDER BY md5(concat('42:', CAST(doc_id AS VARCHAR))), doc_id) AS p FROM labels)
SELECT doc_id, quality FROM r
WHERE p <= (SELECT min(n) FROM (SELECT count(*) AS n FROM labels GROUP BY quality))""")
def balance_classes(t: Tables) -> DataFrame:
    return target.balance_classes(t.labels, "quality", "doc_id").select("doc_id", "quality")


@query("prepare_target", """
SELECT o_orderkey, CAST(o_totalprice > (SELECT median(o_totalprice) FROM orders) AS BIGINT) AS y FROM orders""")
def prepare_target(t: Tables) -> DataFrame:
    return target.prepare_target(t.orders, "o_totalprice").select("o_orderkey", "y")


@query("prepare_dataset", f"""
WITH k AS (SELECT * FROM ({_CLEAN}) WHERE target IS NOT NULL AND name IS NOT NULL AND segment IS NOT NULL AND balance IS NOT NULL)
SELECT id, name, segment, balance, CASE WHEN (SELECT count(DISTINCT target) FROM k) <= 20
  THEN dense_rank() OVER (ORDER BY target) - 1 ELSE CAST(target > (SELECT median(target) FROM k) AS BIGINT) END AS y FROM k
ORDER BY md5(concat('42:', CAST(id AS VARCHAR))), id LIMIT 500""")
def prepare_dataset_query(t: Tables) -> DataFrame:
    return prepare_dataset(dirty(t), "target", "id", _FEATURES, max_rows=500)


# --------------------------------------------------------------------------- splits

@query("shuffle_limit", """
SELECT o_orderkey, o_totalprice FROM orders
ORDER BY md5(concat('42:', CAST(o_orderkey AS VARCHAR))), o_orderkey LIMIT 1000""")
def shuffle_limit(t: Tables) -> DataFrame:
    return splits.shuffle_limit(t.orders, 1000, "o_orderkey").select("o_orderkey", "o_totalprice")


_ORDER = ("row_number() OVER (PARTITION BY split_id ORDER BY md5(concat('42:', CAST(split_id AS VARCHAR), "
          "':', CAST(c_custkey AS VARCHAR))), c_custkey)")
_SPLIT = f"SELECT split_id, c_custkey, {_ORDER} AS p FROM customer, (SELECT unnest(range(7))::INT AS split_id)"


@query("fixed_size_split", f"""
SELECT split_id, c_custkey, CASE WHEN p <= 60 THEN 'train' ELSE 'test' END AS role FROM ({_SPLIT}) WHERE p <= 90""")
def fixed_size_split(t: Tables) -> DataFrame:
    return splits.fixed_size_split(t.customer, "c_custkey", 60, 30, n_splits=7)


@query("fixed_size_split_rest", f"""
SELECT split_id, c_custkey, CASE WHEN p <= 100 THEN 'train' ELSE 'test' END AS role FROM ({_SPLIT})""")
def fixed_size_split_rest(t: Tables) -> DataFrame:
    return splits.fixed_size_split(t.customer, "c_custkey", 100, None, n_splits=7)


@query("kfold_contiguous", """
WITH r AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS p, count(*) OVER () AS n FROM customer)
SELECT c_custkey, CASE WHEN p < (n % 7) * (n // 7 + 1) THEN p // (n // 7 + 1)
  ELSE (n % 7) + (p - (n % 7) * (n // 7 + 1)) // (n // 7) END AS fold FROM r""")
def kfold_contiguous(t: Tables) -> DataFrame:
    return splits.kfold_contiguous(t.customer.select("c_custkey"), "c_custkey", 7)


@query("stratified_kfold", """
SELECT doc_id, quality, (row_number() OVER (PARTITION BY quality
   ORDER BY md5(concat('42:', CAST(doc_id AS VARCHAR))), doc_id) - 1) % 5 AS fold FROM labels""")
def stratified_kfold(t: Tables) -> DataFrame:
    return splits.stratified_kfold(t.labels, "quality", "doc_id").select("doc_id", "quality", "fold")


@query("group_kfold", """
WITH RECURSIVE g AS (
  SELECT c_nationkey AS g, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, c_nationkey) AS i
  FROM customer GROUP BY c_nationkey),
f AS (
  SELECT 0::BIGINT AS i, [0, 0, 0, 0, 0]::BIGINT[] AS loads, -1::BIGINT AS fold
  UNION ALL
  SELECT g.i, list_transform(f.loads, lambda x, j: CASE WHEN j = list_position(f.loads, list_min(f.loads))
           THEN x + g.n ELSE x END), CAST(list_position(f.loads, list_min(f.loads)) - 1 AS BIGINT)
  FROM f JOIN g ON g.i = f.i + 1)
SELECT c_custkey, c_nationkey, f.fold FROM customer JOIN g ON g.g = c_nationkey JOIN f ON f.i = g.i""")
def group_kfold(t: Tables) -> DataFrame:
    return splits.group_kfold(t.customer.select("c_custkey", "c_nationkey"), "c_nationkey", 5)


@query("split_size_guard", f"""
SELECT dataset, n_rows, n_train FROM (SELECT dataset, count(*) AS n_rows FROM ({RESULTS_SQL}) GROUP BY dataset),
  (SELECT unnest([500, 1000, 2000, 5000])::INT AS n_train) WHERE n_rows >= n_train + 500""")
def split_size_guard(t: Tables) -> DataFrame:
    sizes = results(t).groupBy("dataset").agg(F.count(F.lit(1)).alias("n_rows"))
    grid = tables.grid(sizes, n_train=F.array(*[F.lit(n) for n in (500, 1000, 2000, 5000)]))
    return splits.split_size_guard(grid.withColumn("n_test", F.lit(500))).drop("n_test")
