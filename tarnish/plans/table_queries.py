"""Equal-key joins, aggregations, ranks, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tarnish.functions.scalars import percent_gain
from tarnish.operators import ordering, quality, tables
from tarnish.operators.metrics import accuracy, balanced_accuracy, regression_scores, roc_auc, roc_auc_ovr
from tarnish.plans.fixtures import RESULTS_SQL, results
from tarnish.plans.registry import Tables, query

R = f"({RESULTS_SQL})"


def rounded(df: DataFrame, *columns: str, digits: int = 9) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# --------------------------------------------------------------------------- joins

@query("inner_join_on", """
SELECT n.n_nationkey, n.name AS name_x, s.name AS name_y
FROM (SELECT n_nationkey, n_name AS name FROM nation) n
JOIN (SELECT s_nationkey AS n_nationkey, s_name AS name FROM supplier) s USING (n_nationkey)""")
def inner_join_on(t: Tables) -> DataFrame:
    return tables.inner_join_on(
        t.nation.selectExpr("n_nationkey", "n_name AS name"),
        t.supplier.selectExpr("s_nationkey AS n_nationkey", "s_name AS name"), ["n_nationkey"])


@query("natural_join", """
SELECT doc_id, quality, toxic, lang FROM labels NATURAL JOIN (SELECT doc_id, lang FROM documents)""")
def natural_join(t: Tables) -> DataFrame:
    return tables.natural_join(t.labels, t.documents.select("doc_id", "lang"))


@query("join_different_names", """
SELECT l_orderkey, l_linenumber, p_name, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey""")
def join_different_names(t: Tables) -> DataFrame:
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey")
    parts = t.part.select("p_partkey", "p_name", "p_brand")
    return tables.join_different_names(lines, parts, ["l_partkey"], ["p_partkey"]).drop(
        "l_partkey", "p_partkey")


@query("self_join_baseline", f"""
WITH m AS (SELECT dataset, n_train, encoding, avg(roc_auc) AS roc_auc FROM {R} GROUP BY ALL)
SELECT m.dataset, m.n_train, m.encoding, round(m.roc_auc, 9) AS roc_auc,
       round(b.roc_auc, 9) AS roc_auc_base
FROM m JOIN m b ON m.dataset = b.dataset AND m.n_train = b.n_train AND b.encoding = 'STANDARD'""")
def self_join_baseline(t: Tables) -> DataFrame:
    means = results(t).groupBy("dataset", "n_train", "encoding").agg(F.avg("roc_auc").alias("roc_auc"))
    out = tables.with_baseline(means, ["dataset", "n_train"], "roc_auc",
                               F.col("encoding") == "STANDARD", "_base")
    return rounded(out, "roc_auc", "roc_auc_base")


@query("grid_cross_join", """
SELECT dataset, encoder_name, match_score FROM (SELECT DISTINCT p_brand AS dataset FROM part),
  (SELECT DISTINCT p_type AS encoder_name FROM part), (SELECT DISTINCT l_discount AS match_score FROM lineitem)""")
def grid_cross_join(t: Tables) -> DataFrame:
    return tables.grid(
        t.part.select(F.col("p_brand").alias("dataset")).distinct(),
        encoder_name=t.part.select("p_type"), match_score=t.lineitem.select("l_discount"))


@query("lookup_join_back", "SELECT p_partkey, p_name, length(p_name) AS n_chars FROM part")
def lookup_join_back(t: Tables) -> DataFrame:
    return tables.lookup_join_back(
        t.part.select("p_partkey", "p_name"), "p_name",
        lambda texts: texts.withColumn("n_chars", F.length("p_name").cast("bigint")))


# --------------------------------------------------------------------------- aggregations

@query("group_mean", f"SELECT dataset, encoding, round(avg(roc_auc), 9) AS roc_auc FROM {R} GROUP BY ALL")
def group_mean(t: Tables) -> DataFrame:
    return results(t).groupBy("dataset", "encoding").agg(F.round(F.avg("roc_auc"), 9).alias("roc_auc"))


@query("group_mean_all_numeric", """
SELECT l_returnflag, l_linestatus, round(avg(l_orderkey), 4) AS l_orderkey, round(avg(l_partkey), 4) AS l_partkey,
  round(avg(l_suppkey), 4) AS l_suppkey, round(avg(l_linenumber), 4) AS l_linenumber,
  round(avg(l_quantity), 4) AS l_quantity, round(avg(l_extendedprice), 4) AS l_extendedprice,
  round(avg(l_discount), 4) AS l_discount, round(avg(l_tax), 4) AS l_tax FROM lineitem GROUP BY ALL""")
def group_mean_all_numeric(t: Tables) -> DataFrame:
    out = tables.group_mean_all_numeric(t.lineitem, ["l_returnflag", "l_linestatus"])
    return rounded(out, *out.columns[2:], digits=4)


@query("group_count", f"""
SELECT dataset, features, count(roc_auc) AS n, count(nullif(match_score, 0)) AS n_scored FROM {R} GROUP BY ALL""")
def group_count(t: Tables) -> DataFrame:
    return results(t).groupBy("dataset", "features").agg(
        F.count("roc_auc").alias("n"), F.count(F.nullif(F.col("match_score"), F.lit(0.0))).alias("n_scored"))


@query("group_max", f"""
SELECT dataset, encoding, max(roc_auc) AS roc_auc, max(match_score) AS match_score FROM {R} GROUP BY ALL""")
def group_max(t: Tables) -> DataFrame:
    return results(t).groupBy("dataset", "encoding").agg(
        F.max("roc_auc").alias("roc_auc"), F.max("match_score").alias("match_score"))


@query("group_median", f"""
SELECT encoding, round(median(roc_auc), 9) AS median FROM {R} GROUP BY encoding
UNION ALL SELECT 'large', round(median(roc_auc), 9) FROM {R} WHERE contains(model, 'large')""")
def group_median(t: Tables) -> DataFrame:
    r = results(t)
    per = ordering.group_quantiles(r, ["encoding"], "roc_auc", {"median": 0.5})
    some = ordering.group_quantiles(r.where(F.col("model").contains("large")), [], "roc_auc", {"median": 0.5})
    return rounded(per.unionByName(some.withColumn("encoding", F.lit("large"))), "median")


@query("group_multi_agg", f"""
SELECT encoding, n_train, round(median(roc_auc), 9) AS median, round(avg(roc_auc), 9) AS mean,
  round(quantile_cont(roc_auc, 0.25), 9) AS q25, round(quantile_cont(roc_auc, 0.75), 9) AS q75
FROM {R} GROUP BY ALL""")
def group_multi_agg(t: Tables) -> DataFrame:
    r, keys = results(t), ["encoding", "n_train"]
    q = ordering.group_quantiles(r, keys, "roc_auc", {"median": 0.5, "q25": 0.25, "q75": 0.75})
    out = q.join(r.groupBy(*keys).agg(F.avg("roc_auc").alias("mean")), keys)
    return rounded(out, "median", "mean", "q25", "q75")


@query("completeness_ratio", f"""
SELECT round(avg(CAST(n = 7 AS INT)), 9) AS ratio
FROM (SELECT count(roc_auc) AS n FROM {R} GROUP BY dataset, encoding, p_size)""")
def completeness_ratio(t: Tables) -> DataFrame:
    return rounded(tables.completeness_ratio(results(t), ["dataset", "encoding", "p_size"], "roc_auc"),
                   "ratio")


@query("having_group_size", f"""
SELECT dataset, encoding, p_size, features, n_train, roc_auc FROM (
  SELECT *, count(*) OVER (PARTITION BY dataset, encoding, p_size) AS n FROM {R}) WHERE n <> 7 AND n <> 14""")
def having_group_size(t: Tables) -> DataFrame:
    return tables.having_group_size(results(t), ["dataset", "encoding", "p_size"], [7, 14]).select(
        "dataset", "encoding", "p_size", "features", "n_train", "roc_auc")


_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
_PIVOT = ", ".join(f"max(roc_auc) FILTER (encoding = '{n}') AS \"{n}\"" for n in _TYPES)


@query("pivot", f"""
SELECT dataset, n_train, {_PIVOT} FROM (SELECT dataset, n_train, encoding, max(roc_auc) AS roc_auc FROM {R} GROUP BY ALL)
GROUP BY dataset, n_train""")
def pivot(t: Tables) -> DataFrame:
    best = results(t).groupBy("dataset", "n_train", "encoding").agg(F.max("roc_auc").alias("roc_auc"))
    return tables.pivot_unique(best, ["dataset", "n_train"], "encoding", "roc_auc", _TYPES)


@query("melt", """
SELECT o_orderkey, 'o_orderstatus' AS variable, o_orderstatus AS value FROM orders
UNION ALL SELECT o_orderkey, 'o_orderpriority', o_orderpriority FROM orders""")
def melt(t: Tables) -> DataFrame:
    return tables.melt(t.orders, ["o_orderkey"], ["o_orderstatus", "o_orderpriority"])


@query("distinct_values", """
SELECT DISTINCT name FROM (SELECT c_name AS name FROM customer UNION ALL SELECT s_name FROM supplier)""")
def distinct_values(t: Tables) -> DataFrame:
    return t.customer.selectExpr("c_name AS name").union(t.supplier.selectExpr("s_name AS name")).distinct()


@query("five_number_summary", """
SELECT event_type, min(value) AS low, round(quantile_cont(value, 0.25), 9) AS q1,
  round(median(value), 9) AS med, round(quantile_cont(value, 0.75), 9) AS q3, max(value) AS high
FROM events GROUP BY event_type""")
def five_number_summary(t: Tables) -> DataFrame:
    q = ordering.group_quantiles(t.events, ["event_type"], "value",
                                 {"low": 0.0, "q1": 0.25, "med": 0.5, "q3": 0.75, "high": 1.0})
    return rounded(q, "q1", "med", "q3")


@query("mean_stderr", f"""
SELECT p_size, encoding, round(avg(roc_auc), 9) AS mean,
  round(avg(roc_auc) - 0.5 * stddev_samp(roc_auc) / sqrt(count(roc_auc)), 9) AS low,
  round(avg(roc_auc) + 0.5 * stddev_samp(roc_auc) / sqrt(count(roc_auc)), 9) AS high
FROM {R} GROUP BY ALL""")
def mean_stderr(t: Tables) -> DataFrame:
    return rounded(tables.mean_stderr(results(t), ["p_size", "encoding"], "roc_auc"), "mean", "low", "high")


@query("ols_trend", """
SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope,
  round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept,
  round(regr_r2(l_extendedprice, l_quantity), 9) AS r2, CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS n
FROM lineitem GROUP BY l_returnflag
UNION ALL SELECT 'any', round(regr_slope(l_extendedprice, l_quantity), 4),
  round(regr_intercept(l_extendedprice, l_quantity), 3), round(regr_r2(l_extendedprice, l_quantity), 9),
  CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) FROM lineitem""")
def ols_trend(t: Tables) -> DataFrame:
    x, y = "l_quantity", "l_extendedprice"
    both = tables.ols_trend(t.lineitem, x, y, ["l_returnflag"]).unionByName(
        tables.ols_trend(t.lineitem, x, y).withColumn("l_returnflag", F.lit("any")))
    return rounded(rounded(rounded(both, "slope", digits=4), "intercept", digits=3), "r2")


# --------------------------------------------------------------------------- join quality

# Predicted matches: the supplier of the cheapest offer; known matches: the one most ordered.
_PAIRS = "SELECT DISTINCT l_partkey AS id_l, l_suppkey AS id_r FROM lineitem WHERE l_returnflag = '{}'"
_TRUTH = "SELECT l_partkey AS id_l, max(l_suppkey) AS id_r FROM lineitem GROUP BY l_partkey"
_PRED = ("SELECT l_partkey AS id_l, CASE WHEN max(l_quantity) > 48 THEN max(l_suppkey) "
         "WHEN max(l_quantity) < 40 THEN NULL ELSE min(l_suppkey) END AS id_r FROM lineitem GROUP BY l_partkey")


@query("join_quality", f"""
WITH b AS (SELECT p.id_r, g.id_r AS gt FROM ({_PRED}) p JOIN ({_TRUTH}) g USING (id_l) WHERE p.id_r IS NOT NULL),
m AS (SELECT sum(CAST(id_r = gt AS INT)) / (SELECT count(*) FROM ({_TRUTH})) AS recall,
             sum(CAST(id_r = gt AS INT)) / count(*) AS precision FROM b)
SELECT round(recall, 9) AS recall, round(precision, 9) AS precision,
       round(2 * recall * precision / (recall + precision), 9) AS f1 FROM m""")
def join_quality(t: Tables) -> DataFrame:
    q, s = F.max("l_quantity"), F.max("l_suppkey")
    by_part = t.lineitem.groupBy(F.col("l_partkey").alias("id_l"))
    pred = by_part.agg(F.when(q > 48, s).when(q >= 40, F.min("l_suppkey")).alias("id_r"))
    out = quality.join_quality(pred, by_part.agg(s.alias("id_r")))
    return rounded(out, *out.columns)


@query("pair_set_quality", f"""
WITH p AS ({_PAIRS.format('A')}), g AS ({_PAIRS.format('N')}),
tp AS (SELECT count(*) AS n FROM (SELECT * FROM p INTERSECT SELECT * FROM g)),
m AS (SELECT tp.n / (SELECT count(*) FROM p) AS precision, tp.n / (SELECT count(*) FROM g) AS recall FROM tp)
SELECT round(precision, 9) AS precision, round(recall, 9) AS recall,
       round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 9) AS f1 FROM m""")
def pair_set_quality(t: Tables) -> DataFrame:
    ids = [F.col("l_partkey").alias("id_l"), F.col("l_suppkey").alias("id_r")]
    out = quality.pair_set_quality(t.lineitem.where("l_returnflag = 'A'").select(*ids),
                                   t.lineitem.where("l_returnflag = 'N'").select(*ids))
    return rounded(out, *out.columns)


@query("set_intersect", f"{_PAIRS.format('A')} INTERSECT {_PAIRS.format('N')}")
def set_intersect(t: Tables) -> DataFrame:
    ids = [F.col("l_partkey").alias("id_l"), F.col("l_suppkey").alias("id_r")]
    return t.lineitem.where("l_returnflag = 'A'").select(*ids).intersect(
        t.lineitem.where("l_returnflag = 'N'").select(*ids))


@query("set_equality_check", """
WITH a AS (SELECT c_custkey AS k FROM customer), b AS (SELECT DISTINCT o_custkey AS k FROM orders)
SELECT (SELECT count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM b)) AS only_left,
       (SELECT count(*) FROM (SELECT k FROM b EXCEPT SELECT k FROM a)) AS only_right,
       (SELECT count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM b)) = 0 AND
       (SELECT count(*) FROM (SELECT k FROM b EXCEPT SELECT k FROM a)) = 0 AS equal""")
def set_equality_check(t: Tables) -> DataFrame:
    return tables.same_rows(t.customer.selectExpr("c_custkey AS k"),
                            t.orders.selectExpr("o_custkey AS k").distinct())


@query("best_threshold_per_dataset", f"""
WITH m AS (SELECT dataset, encoding, match_score, avg(roc_auc) AS f1 FROM {R} GROUP BY ALL)
SELECT dataset, encoding, round(f1, 9) AS f1, match_score FROM (
  SELECT *, row_number() OVER (PARTITION BY dataset, encoding ORDER BY round(f1, 9) DESC, match_score) AS i FROM m)
WHERE i = 1""")
def best_threshold_per_dataset(t: Tables) -> DataFrame:
    means = results(t).groupBy("dataset", "encoding", "match_score").agg(
        F.round(F.avg("roc_auc"), 9).alias("f1"))
    return rounded(quality.best_threshold(means, ["dataset", "encoding"]), "f1")


_SCORES = f"SELECT dataset, encoding, round(avg(roc_auc), 9) AS f1 FROM {R} GROUP BY ALL"


def _scores(t: Tables) -> DataFrame:
    return results(t).groupBy("dataset", "encoding").agg(F.round(F.avg("roc_auc"), 9).alias("f1"))


@query("friedman_average_ranks", f"""
WITH s AS ({_SCORES}),
r AS (SELECT *, rank() OVER (PARTITION BY dataset ORDER BY f1 DESC)
        + (count(*) OVER (PARTITION BY dataset, f1) - 1) / 2.0 AS rk FROM s),
m AS (SELECT encoding, avg(rk) AS mean_rank, count(*) AS n FROM r GROUP BY encoding),
c AS (SELECT 12.0 * max(n) / (count(*) * (count(*) + 1)) *
        (sum(mean_rank * mean_rank) - count(*) * (count(*) + 1) * (count(*) + 1) / 4) AS chi2 FROM m)
SELECT encoding, round(mean_rank, 9) AS mean_rank, n AS n_datasets, round(chi2, 9) AS chi2 FROM m, c""")
def friedman_average_ranks(t: Tables) -> DataFrame:
    return rounded(quality.friedman(_scores(t), "dataset", "encoding", "f1"), "mean_rank", "chi2")


_TAIL = """1.0 / sqrt(2 * pi()) * exp(-z * z / 2) * k * (0.319381530 + k * (-0.356563782 + k * (1.781477937
  + k * (-1.821255978 + k * 1.330274429))))"""


@query("critical_difference_groups", f"""
WITH s AS ({_SCORES}),
r AS (SELECT *, rank() OVER (PARTITION BY dataset ORDER BY f1 DESC)
        + (count(*) OVER (PARTITION BY dataset, f1) - 1) / 2.0 AS rk FROM s),
m AS (SELECT encoding, avg(rk)::DOUBLE AS mean_rank, count(*) AS n FROM r GROUP BY encoding),
c AS (SELECT 12.0 * max(n) / (count(*) * (count(*) + 1)) *
        (sum(mean_rank * mean_rand) - count(*) * (count(*) + 1) * (count(*) + 1) / 4) AS chi2 FROM (SELECT *, mean_rank AS mean_rand FROM m)),
d AS (SELECT x.encoding AS a, y.encoding AS b, round(x.f1 - y.f1, 12) AS diff FROM s x JOIN s y USING (dataset)
      WHERE x.encoding < y.encoding AND round(x.f1 - y.f1, 12) <> 0),
w AS (SELECT a, b, diff, rank() OVER (PARTITION BY a, b ORDER BY abs(diff)) + (count(*) OVER (PARTITION BY a, b, abs(diff)) - 1) / 2.0 AS q,
        count(*) OVER (PARTITION BY a, b, abs(diff)) AS t FROM d),
z AS (SELECT a, b, count(*)::DOUBLE AS n, coalesce(sum(q) FILTER (diff > 0), 0)::DOUBLE AS plus, sum(t * t - 1)::DOUBLE AS ties FROM w GROUP BY a, b),
p AS (SELECT a, b, abs((plus - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)) AS z FROM z),
v AS (SELECT a, b, least(1.0, 2 * ({_TAIL})) AS p FROM (SELECT *, 1.0 / (1 + 0.2316419 * z) AS k FROM p)),
h AS (SELECT a, b, max(least(1.0, p * left_)) OVER (ORDER BY p, a, b) AS adj FROM (
        SELECT *, count(*) OVER () - row_number() OVER (ORDER BY p, a, b) + 1 AS left_ FROM v)),
o AS (SELECT encoding, row_number() OVER (ORDER BY mean_rank, encoding) AS i FROM m),
different AS (SELECT least(x.i, y.i) AS i, greatest(x.i, y.i) AS j FROM h JOIN o x ON x.encoding = a JOIN o y ON y.encoding = b WHERE adj < 0.05),
reach AS (SELECT o.i, coalesce((SELECT min(j) - 1 FROM different d WHERE d.i >= o.i), (SELECT max(i) FROM o)) AS j FROM o),
runs AS (SELECT i, j, row_number() OVER (ORDER BY i) - 1 AS g FROM (
  SELECT i, j, lag(j) OVER (ORDER BY i) AS earlier FROM reach) WHERE j > i AND (earlier IS NULL OR earlier < j))
SELECT m.encoding, round(mean_rank, 9) AS mean_rank, n AS n_datasets, round(chi2, 9) AS chi2,
  coalesce((SELECT string_agg(g::VARCHAR, ',' ORDER BY g) FROM runs WHERE o.i BETWEEN runs.i AND runs.j), '') AS tied
FROM m JOIN o USING (encoding), c""")
def critical_difference_groups(t: Tables) -> DataFrame:
    out = quality.critical_difference_groups(_scores(t), "dataset", "encoding", "f1")
    return rounded(out, "mean_rank", "chi2").withColumn("tied", F.array_join("tied", ","))


# --------------------------------------------------------------------------- windows

@query("rank_avg_desc", """
SELECT o_orderkey, rank() OVER (PARTITION BY o_orderstatus ORDER BY round(o_totalprice, -3) DESC)
  + (count(*) OVER (PARTITION BY o_orderstatus, round(o_totalprice, -3)) - 1) / 2.0::DOUBLE AS rank FROM orders""")
def rank_avg_desc(t: Tables) -> DataFrame:
    df = t.orders.withColumn("price", F.round("o_totalprice", -3))
    return ordering.average_ranks(df, ["o_orderstatus"], "price").select("o_orderkey", "rank")


@query("mean_rank", f"""
WITH s AS (SELECT dataset, n_train, features, encoding, round(avg(roc_auc), 9) AS v FROM {R} GROUP BY ALL),
r AS (SELECT *, rank() OVER (PARTITION BY dataset, n_train, features ORDER BY v DESC)
        + (count(*) OVER (PARTITION BY dataset, n_train, features, v) - 1) / 2.0 AS rk FROM s)
SELECT encoding, n_train, features, round(avg(rk), 9) AS mean_rank FROM r GROUP BY ALL""")
def mean_rank(t: Tables) -> DataFrame:
    keys = ["dataset", "n_train", "features"]
    means = results(t).groupBy(*keys, "encoding").agg(F.round(F.avg("roc_auc"), 9).alias("v"))
    return rounded(ordering.average_ranks(means, keys, "v").groupBy("encoding", "n_train", "features").agg(
        F.avg("rank").alias("mean_rank")), "mean_rank")


@query("row_position", """
SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position FROM conversations""")
def row_position(t: Tables) -> DataFrame:
    return tables.row_position(t.conversations, ["conv_id"], "turn").select("conv_id", "turn", "position")


@query("global_row_position", """
SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS position FROM events""")
def global_row_position(t: Tables) -> DataFrame:
    return ordering.sorted_positions(t.events.select("event_id"), [], "event_id")


@query("global_max_normalise", """
SELECT l_orderkey, l_linenumber, round(l_extendedprice / (SELECT max(l_extendedprice) FROM lineitem), 9) AS share FROM lineitem""")
def global_max_normalise(t: Tables) -> DataFrame:
    return rounded(tables.global_max_normalise(t.lineitem, "l_extendedprice", "share"), "share").select(
        "l_orderkey", "l_linenumber", "share")


# --------------------------------------------------------------------------- order, top, sets

@query("order_by", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey")
def order_by(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey")


@query("last_row_per_group", """
SELECT o_custkey, o_orderkey, o_totalprice FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS i FROM orders) WHERE i = 1""")
def last_row_per_group(t: Tables) -> DataFrame:
    return tables.last_row_per_group(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"),
                                     ["o_custkey"], "o_totalprice")


@query("argmax_rows", """
SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity = (SELECT max(l_quantity) FROM lineitem)""")
def argmax_rows(t: Tables) -> DataFrame:
    return tables.argmax_rows(t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity"), "l_quantity")


@query("union_all", """
SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, NULL::DOUBLE AS price FROM customer
UNION ALL SELECT p_partkey, p_name, NULL, p_retailprice FROM part""")
def union_all(t: Tables) -> DataFrame:
    return tables.union_all(
        t.customer.selectExpr("c_custkey AS id", "c_name AS name", "c_mktsegment AS segment"),
        t.part.selectExpr("p_partkey AS id", "p_name AS name", "p_retailprice AS price"))


@query("explode_parallel", """
SELECT o_orderkey, l_linenumber AS fold, l_quantity AS accuracies, l_discount AS roc_auc
FROM lineitem JOIN orders ON o_orderkey = l_orderkey""")
def explode_parallel(t: Tables) -> DataFrame:
    lines = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_quantity", "l_discount")))
    # an order has at most seven lines
    records = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(lines.alias("s")).select(
        "o_orderkey", F.col("s.l_linenumber").alias("fold"), F.col("s.l_quantity").alias("accuracies"),
        F.col("s.l_discount").alias("roc_auc"))
    return tables.explode_parallel(records, ["fold", "accuracies", "roc_auc"]).join(
        t.orders.select("o_orderkey"), "o_orderkey")


@query("percent_gain", """
SELECT l_orderkey, l_linenumber, l_extendedprice - o_totalprice AS difference,
  round(100.0 * (l_extendedprice - o_totalprice) / o_totalprice, 9) AS gain
FROM lineitem JOIN orders ON o_orderkey = l_orderkey""")
def percent_gain_query(t: Tables) -> DataFrame:
    both = t.lineitem.join(t.orders.withColumnRenamed("o_orderkey", "l_orderkey"), "l_orderkey")
    return both.select(
        "l_orderkey", "l_linenumber", (F.col("l_extendedprice") - F.col("o_totalprice")).alias("difference"),
        F.round(percent_gain("l_extendedprice", "o_totalprice"), 9).alias("gain"))


# --------------------------------------------------------------------------- metrics

# Order lines as predictions: is the line returned, scored by its price.
_SCORED = ("SELECT l_linenumber AS fold, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, "
           "CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS pred, l_quantity AS score, "
           "l_extendedprice AS price, l_quantity * 1500 AS price_pred FROM lineitem")


def _scored(t: Tables) -> DataFrame:
    return t.lineitem.selectExpr(
        "l_linenumber AS fold", "CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y",
        "CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS pred", "l_quantity AS score",
        "l_extendedprice AS price", "l_quantity * 1500 AS price_pred")


@query("metric_accuracy", f"SELECT fold, round(avg(CAST(y = pred AS INT)), 9) AS accuracy FROM ({_SCORED}) GROUP BY fold")
def metric_accuracy(t: Tables) -> DataFrame:
    return rounded(accuracy(_scored(t), ["fold"], "y", "pred"), "accuracy")


@query("metric_balanced_accuracy", f"""
SELECT fold, round(avg(recall), 9) AS roc_auc_hard FROM (
  SELECT fold, y, avg(CAST(y = pred AS INT)) AS recall FROM ({_SCORED}) GROUP BY fold, y) GROUP BY fold""")
def metric_balanced_accuracy(t: Tables) -> DataFrame:
    return rounded(balanced_accuracy(_scored(t), ["fold"], "y", "pred"), "roc_auc_hard")


@query("metric_roc_auc", f"""
WITH r AS (SELECT fold, y, rank() OVER (PARTITION BY fold ORDER BY score)
             + (count(*) OVER (PARTITION BY fold, score) - 1) / 2.0 AS rk FROM ({_SCORED}))
SELECT fold, round((sum(rk) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)), 9) AS roc_auc
FROM r GROUP BY fold""")
def metric_roc_auc(t: Tables) -> DataFrame:
    return rounded(roc_auc(_scored(t), ["fold"], "y", "score"), "roc_auc")


@query("metric_roc_auc_ovr", """
WITH l AS (SELECT vec_id, label, unnest(range(10)) AS c, unnest(embedding[1:10]) AS s FROM embeddings),
r AS (SELECT c, CAST(label = c AS INT) AS y, rank() OVER (PARTITION BY c ORDER BY s)
        + (count(*) OVER (PARTITION BY c, s) - 1) / 2.0 AS rk FROM l),
a AS (SELECT c, (sum(rk) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)) AS auc FROM r GROUP BY c)
SELECT round(avg(auc), 9) AS roc_auc FROM a""")
def metric_roc_auc_ovr(t: Tables) -> DataFrame:
    # the first ten coordinates serve as class scores
    return rounded(roc_auc_ovr(t.embeddings, [], "label", "embedding", 10), "roc_auc")


@query("metric_neg_mse", f"SELECT fold, round(-avg((price - price_pred) * (price - price_pred)), 2) AS neg_mean_squared_error FROM ({_SCORED}) GROUP BY fold")
def metric_neg_mse(t: Tables) -> DataFrame:
    out = regression_scores(_scored(t), ["fold"], "price", "price_pred").drop("r2")
    return rounded(out, "neg_mean_squared_error", digits=2)


@query("metric_r2", f"""
SELECT fold, round(1 - sum((price - price_pred) * (price - price_pred)) / (var_pop(price) * count(*)), 9) AS r2
FROM ({_SCORED}) GROUP BY fold""")
def metric_r2(t: Tables) -> DataFrame:
    return rounded(regression_scores(_scored(t), ["fold"], "price", "price_pred").drop("neg_mean_squared_error"), "r2")


@query("fold_metrics_table", f"""
SELECT dataset, encoding, fold, round(avg(roc_auc), 9) AS roc_auc, max(match_score) AS accuracies
FROM {R} GROUP BY dataset, encoding, fold""")
def fold_metrics_table(t: Tables) -> DataFrame:
    per_fold = results(t).groupBy("dataset", "encoding", "fold").agg(
        F.round(F.avg("roc_auc"), 9).alias("roc_auc"), F.max("match_score").alias("accuracies"))
    # a configuration has at most seven folds
    listed = F.sort_array(F.collect_list(F.struct("fold", "roc_auc", "accuracies")))
    records = per_fold.groupBy("dataset", "encoding").agg(listed.alias("s")).select(
        "dataset", "encoding", F.col("s.fold").alias("fold"), F.col("s.roc_auc").alias("roc_auc"),
        F.col("s.accuracies").alias("accuracies"))
    return tables.explode_parallel(records, ["fold", "roc_auc", "accuracies"])
