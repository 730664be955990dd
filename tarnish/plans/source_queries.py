"""Readers, sinks and the vector cache."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from tarnish.operators.encoders import minhash_distinct
from tarnish.plans.fixtures import typo
from tarnish.plans.registry import Tables, query
from tarnish.session import scratch_dir
from tarnish.sources.cache import VectorCache
from tarnish.sources.files import (Catalog, Dataset, decimal_comma, load_join_triple, scan_csv,
                                   sink_create_or_append, sink_csv, union_csv_files)


def scratch(t: Tables, name: str) -> str:
    return f"{scratch_dir(t.spark)}/tarnish/{name}-{uuid.uuid4().hex}"


@query("scan_parquet", "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate, o_orderpriority FROM orders")
def scan_parquet(t: Tables) -> DataFrame:
    return Dataset("orders", f"{t.folder}/orders.parquet", "o_totalprice").features(t.spark)


@query("dataset_catalog", """
SELECT 'customer' AS dataset, 'c_name' AS text_column, count(*) AS n, count(DISTINCT c_name) AS n_texts FROM customer
UNION ALL SELECT 'supplier', 's_name', count(*), count(DISTINCT s_name) FROM supplier
UNION ALL SELECT 'part', 'name', count(*), count(DISTINCT p_name) FROM part""")
def dataset_catalog(t: Tables) -> DataFrame:
    catalog = Catalog(
        Dataset("customer", f"{t.folder}/customer.parquet", "c_acctbal", "c_name"),
        Dataset("supplier", f"{t.folder}/supplier.parquet", "s_acctbal", "s_name"),
        Dataset("part", f"{t.folder}/part.parquet", "p_retailprice", renames={"p_name": "name"}))
    out = None
    for name in catalog.by_name:
        d = catalog.resolve(name)
        one = d.features(t.spark).agg(
            F.lit(name).alias("dataset"), F.lit(d.text).alias("text_column"),
            F.count(F.lit(1)).alias("n"), F.count_distinct(d.text).alias("n_texts"))
        out = one if out is None else out.unionByName(one)
    return out


@query("scan_csv", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def scan_csv_query(t: Tables) -> DataFrame:
    path = scratch(t, "csv")
    sink_csv(t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"), path)
    return scan_csv(t.spark, path, "o_orderkey bigint, o_custkey bigint, o_orderstatus string, "
                                   "o_totalprice double")


@query("scan_csv_semicolon_decimal_comma", """
SELECT c_custkey, c_name, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_acctbal END AS balance FROM customer""")
def scan_csv_semicolon(t: Tables) -> DataFrame:
    path = scratch(t, "csv")
    written = F.when(F.col("c_mktsegment") == "BUILDING", "Unknown").otherwise(
        F.replace(F.col("c_acctbal").cast("string"), F.lit("."), F.lit(",")))
    sink_csv(t.customer.select("c_custkey", "c_name", written.alias("balance")), path, ";")
    read = scan_csv(t.spark, path, "c_custkey bigint, c_name string, balance string", ";")
    return read.withColumn("balance", decimal_comma("balance"))


@query("union_csv_files", """
SELECT o_orderkey AS id, o_totalprice AS amount, o_orderpriority AS priority FROM orders
UNION ALL SELECT c_custkey, c_acctbal, NULL FROM customer""")
def union_csv(t: Tables) -> DataFrame:
    a, b = scratch(t, "csv"), scratch(t, "csv")
    sink_csv(t.orders.selectExpr("o_orderkey AS id", "o_totalprice AS amount",
                                 "o_orderpriority AS priority"), a)
    sink_csv(t.customer.selectExpr("c_custkey AS id", "c_acctbal AS amount"), b)
    return union_csv_files(t.spark, {a: "id bigint, amount double, priority string",
                                     b: "id bigint, amount double"})


@query("sink_create_or_append", """
SELECT event_type, count(*) AS n FROM (SELECT event_type FROM events
UNION ALL SELECT event_type FROM events) GROUP BY event_type""")
def create_or_append(t: Tables) -> DataFrame:
    path = scratch(t, "append")
    for _ in range(2):
        sink_create_or_append(t.events.select("event_id", "event_type"), path)
    return t.spark.read.parquet(path).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("sink_csv", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def sink_csv_query(t: Tables) -> DataFrame:
    path = scratch(t, "csv")
    sink_csv(t.supplier.select("s_suppkey", "s_name", "s_acctbal"), path)
    return scan_csv(t.spark, path, "s_suppkey bigint, s_name string, s_acctbal double")


@query("vector_cache", """
SELECT 'missing' AS kind, p_name AS text FROM (SELECT DISTINCT p_name FROM part
  WHERE p_name NOT IN (SELECT p_name FROM part WHERE p_type = 'ECONOMY' AND p_name IS NOT NULL))
UNION ALL
SELECT 'cached', p_name FROM (SELECT DISTINCT p_name FROM part)""")
def vector_cache(t: Tables) -> DataFrame:
    cache = VectorCache(t.spark, scratch(t, "cache"))
    names = t.part.select(F.col("p_name").alias("text"))

    def model(texts: DataFrame) -> DataFrame:
        keyed = texts.withColumn("k", F.md5("text"))
        return keyed.join(minhash_distinct(keyed, "k", "text", 4), "k")

    # fill from one part type, see what another sample lacks, then encode the whole table
    cache.encode(t.part.where("p_type = 'ECONOMY'"), "p_name", "part", "minhash_4", model)
    missing = _keep(t, cache.missing(names, "part", "p_name", "minhash_4"))
    cache.encode(t.part, "p_name", "part", "minhash_4", model)
    return missing.unionByName(cache.read("part", "p_name", "minhash_4").select(
        F.lit("cached").alias("kind"), "text"))


def _keep(t: Tables, missing: DataFrame) -> DataFrame:
    """What was missing at this moment, written down before the cache grows."""
    path = scratch(t, "missing")
    missing.select(F.lit("missing").alias("kind"), "text").write.parquet(path)
    return t.spark.read.schema("kind string, text string").parquet(path)


@query("load_join_triple", f"""
SELECT l.id AS id_l, r.id AS id_r, l.title AS title_l, r.title AS title_r
FROM (SELECT c_custkey AS id, c_name AS title FROM customer) l
JOIN (SELECT c_custkey AS id, {typo('c_name', 'c_custkey')} AS title FROM customer) r ON l.id = r.id""")
def join_triple(t: Tables) -> DataFrame:
    folder = scratch(t, "triple")
    t.customer.selectExpr("c_custkey AS id", "c_name AS title").write.parquet(f"{folder}/left.parquet")
    t.customer.selectExpr("c_custkey AS id", f"{typo('c_name', 'c_custkey')} AS title").write.parquet(
        f"{folder}/right.parquet")
    t.customer.selectExpr("c_custkey AS id_l", "c_custkey AS id_r").write.parquet(f"{folder}/gt.parquet")
    left, right, truth = load_join_triple(t.spark, folder)
    return (truth.join(left.selectExpr("id AS id_l", "title AS title_l"), "id_l")
            .join(right.selectExpr("id AS id_r", "title AS title_r"), "id_r"))
