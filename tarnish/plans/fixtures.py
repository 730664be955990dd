"""Inputs the queries derive from the given tables, as expressions both engines read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tarnish.plans.registry import Tables

# Customers with planted false-missing texts, a sparse column and missing numbers.
DIRTY = [
    "c_custkey AS id",
    "c_name AS name",
    "CASE c_nationkey WHEN 0 THEN 'N/A' WHEN 1 THEN '' WHEN 2 THEN '  ' WHEN 3 THEN '?' "
    "WHEN 4 THEN 'nan' ELSE c_mktsegment END AS segment",
    "CASE WHEN c_nationkey < 20 THEN NULL ELSE c_mktsegment END AS note",
    "CASE WHEN c_nationkey = 24 THEN NULL ELSE c_acctbal END AS balance",
    "CASE WHEN c_nationkey = 7 THEN NULL ELSE c_nationkey END AS target",
]
DIRTY_SQL = f"SELECT {', '.join(DIRTY)} FROM customer"

# Score of one evaluation run per order line: data set, method, settings.
RESULTS = [
    "p_brand AS dataset",
    "p_type AS encoding",
    "split_part(p_name, ' ', 1) AS model",
    "concat('PCA_', CAST(p_size AS STRING)) AS dim_reduction",
    "CASE l_returnflag WHEN 'A' THEN 'all' WHEN 'N' THEN 'text_only' ELSE 'rest_only' END AS features",
    "CASE l_linestatus WHEN 'F' THEN 1000 ELSE 2000 END AS n_train",
    "CAST(0.5 + l_quantity / 100 AS DOUBLE) AS roc_auc",
    "CAST(l_linenumber AS INT) AS fold",
    "CAST(l_discount AS DOUBLE) AS match_score",
    "CAST(p_size AS INT) AS p_size",
]
RESULTS_SQL = (f"SELECT {', '.join(RESULTS).replace('AS STRING', 'AS VARCHAR')} "
               "FROM lineitem JOIN part ON l_partkey = p_partkey")


def dirty(t: Tables) -> DataFrame:
    return t.customer.selectExpr(*DIRTY)


def results(t: Tables) -> DataFrame:
    lines = t.lineitem.withColumnRenamed("l_partkey", "p_partkey").join(t.part, "p_partkey")
    return lines.selectExpr(*RESULTS)


def typo(text: str, key: str) -> str:
    """The text without one character, at a position that depends on the key."""
    at = f"CAST(({key} * 7919) % length({text}) AS INT)"
    return f"concat(substr({text}, 1, {at}), substr({text}, {at} + 2))"
