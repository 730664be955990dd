"""Fuzzy joins and their quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tarnish.operators.auto_fuzzy import auto_fuzzy_join, ball_counts
from tarnish.operators.fuzzy import fuzzy_join, fuzzy_matches, sweep_thresholds
from tarnish.operators.quality import join_quality, pair_set_quality
from tarnish.plans.fixtures import typo
from tarnish.plans.registry import Tables, query
from tarnish.plans.text_queries import gram_rows

# --------------------------------------------------------------------------- oracle in SQL


def fuzzy_sql(main: str, aux: str, analyzer: str = "char_wb", lo: int = 2, hi: int = 4,
              text: bool = True, numbers: int = 0) -> str:
    """Brute force: every main key against every aux key. Yields ``m (mid, aid, score)``.

    ``main`` selects ``(mid, t, z1, ...)``, ``aux`` selects ``(aid, t, z1, ...)``; the lowest
    ``aid`` wins between equally near keys.
    """
    zs = [f"z{i + 1}" for i in range(numbers)]
    key = ", ".join((["t"] if text else []) + zs)
    parts = [f"main AS ({main})", f"aux AS ({aux})",
             f"mk AS (SELECT DISTINCT {key} FROM main)",
             f"ak AS (SELECT {key}, min(aid) AS aid FROM aux GROUP BY {key})"]
    gap = "0"
    if numbers:
        both = f"(SELECT {', '.join(zs)} FROM main UNION ALL SELECT {', '.join(zs)} FROM aux)"
        devs = ", ".join(f"stddev_pop({z}) AS s{z}" for z in zs)
        parts.append(f"dev AS (SELECT {devs} FROM {both})")
        gap = " + ".join(f"((x.{z} - y.{z}) / s{z}) ^ 2" for z in zs)
    if text:
        parts += [
            "texts AS (SELECT t, count(*) AS m FROM (SELECT t FROM main UNION ALL SELECT t FROM aux) GROUP BY t)",
            f"cnt AS (SELECT t, gram, count(*) AS c FROM ({gram_rows('texts', 't', 't', analyzer, lo, hi)}) GROUP BY ALL)",
            "df AS (SELECT gram, sum(m) AS df FROM cnt JOIN texts USING (t) GROUP BY gram)",
            "raw AS (SELECT t, gram, c * (ln((1.0 + (SELECT sum(m) FROM texts)) / (1.0 + df)) + 1.0) AS r FROM cnt JOIN df USING (gram))",
            "w AS (SELECT t, gram, r / sqrt(sum(r * r) OVER (PARTITION BY t)) AS w FROM raw)",
            "has AS (SELECT DISTINCT t FROM w)",
            "sims AS (SELECT x.t AS tx, y.t AS ty, round(least(1.0, sum(x.w * y.w)), 9) AS cos FROM w x JOIN w y USING (gram) "
            "WHERE x.t IN (SELECT t FROM main) AND y.t IN (SELECT t FROM aux) GROUP BY ALL)"]
        d2 = ("CASE WHEN cos IS NOT NULL THEN 2.0 - 2.0 * cos "
              "WHEN x.t IN (SELECT t FROM has) AND y.t IN (SELECT t FROM has) THEN 2.0 "
              "WHEN x.t IN (SELECT t FROM has) OR y.t IN (SELECT t FROM has) THEN 1.0 ELSE 0.0 END")
        source = "mk x CROSS JOIN ak y LEFT JOIN sims ON sims.tx = x.t AND sims.ty = y.t"
    else:
        d2, source = "0.0", "mk x CROSS JOIN ak y"
    source += " CROSS JOIN dev" if numbers else ""
    xs = ", ".join(f"x.{c}" for c in key.split(", "))
    dist = ("round(abs(x.z1 - y.z1) / sz1, 9)" if not text and numbers == 1
            else f"round(sqrt({gap}), 9)" if not text
            else f"round(sqrt(round(greatest({d2}, 0) + {gap}, 9)), 9)")
    # in one dimension the distance decides as it is, else rounded
    order = "abs(x.z1 - y.z1)" if not text and numbers == 1 else dist
    parts += [
        f"p AS (SELECT {xs}, y.aid, {dist} AS d, {order} AS o FROM {source})",
        f"b AS (SELECT {key}, aid, d FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY o, aid) AS i FROM p) WHERE i = 1)",
        f"m AS (SELECT mid, b.aid, CASE WHEN (SELECT max(d) FROM b) > 0 THEN 1.0 - b.d / (2.0 * (SELECT max(d) FROM b)) "
        f"ELSE 1.0 END AS score FROM main JOIN b USING ({key}))"]
    return "WITH " + ", ".join(parts)


def scored(df: DataFrame, *columns: str) -> DataFrame:
    """Chosen columns with the score rounded for comparison."""
    return df.select(*columns, F.round("matching_score", 6).alias("score"))


# --------------------------------------------------------------------------- strings

# Customer names against a copy with one character missing.
_NAMES = "SELECT c_custkey AS aid, c_name AS t FROM customer"
_TYPOS = f"SELECT c_custkey AS mid, {typo('c_name', 'c_custkey')} AS t FROM customer"


def _names(t: Tables) -> DataFrame:
    return t.customer.selectExpr("c_custkey AS id", "c_name AS title")


def _typos(t: Tables) -> DataFrame:
    return t.customer.selectExpr("c_custkey AS id", f"{typo('c_name', 'c_custkey')} AS title")


def _found(t: Tables, **search):
    return fuzzy_matches(_typos(t), _names(t), on="title", suffixes=("_l", "_r"), order_by="id", **search)


_STRING = fuzzy_sql(_TYPOS, _NAMES)


@query("fuzzy_join_string", f"{_STRING} SELECT mid AS id_l, aid AS id_r, round(score, 6) AS score FROM m")
def fuzzy_join_string(t: Tables) -> DataFrame:
    return scored(_found(t).apply(return_score=True), "id_l", "id_r")


_URLS = fuzzy_sql(f"SELECT page_id AS mid, {typo('url', 'page_id')} AS t FROM pages",
                  "SELECT page_id AS aid, url AS t FROM pages", "char", 2, 4)


@query("fuzzy_join_string_char", f"{_URLS} SELECT mid AS id_l, aid AS id_r, round(score, 6) AS score FROM m")
def fuzzy_join_string_char(t: Tables) -> DataFrame:
    left = t.pages.selectExpr("page_id AS id", f"{typo('url', 'page_id')} AS title")
    right = t.pages.selectExpr("page_id AS id", "url AS title")
    return scored(fuzzy_join(left, right, on="title", analyzer="char", suffixes=("_l", "_r"),
                             order_by="id", return_score=True), "id_l", "id_r")


_LONG = fuzzy_sql("SELECT item_id AS mid, text AS t FROM benchmark",
                  "SELECT doc_id AS aid, text AS t FROM documents", "word", 1, 2)


@query("fuzzy_join_string_word", f"{_LONG} SELECT mid AS item_id, aid AS doc_id, round(score, 6) AS score FROM m")
def fuzzy_join_string_word(t: Tables) -> DataFrame:
    found = fuzzy_join(t.benchmark, t.documents.select("doc_id", "text"), on="text", analyzer="word",
                       ngram_range=(1, 2), order_by="doc_id", return_score=True)
    return scored(found, "item_id", "doc_id")


_PARTS = fuzzy_sql(
    f"SELECT p_partkey AS mid, concat_ws('  ', p_brand, p_type, {typo('p_name', 'p_partkey')}) AS t FROM part",
    "SELECT p_partkey AS aid, concat_ws('  ', p_brand, p_type, p_name) AS t FROM part")


@query("fuzzy_join_multi_string", f"{_PARTS} SELECT mid AS id_l, aid AS id_r, round(score, 6) AS score FROM m")
def fuzzy_join_multi_string(t: Tables) -> DataFrame:
    left = t.part.selectExpr("p_partkey AS id", "p_brand", "p_type", f"{typo('p_name', 'p_partkey')} AS p_name")
    right = t.part.selectExpr("p_partkey AS id", "p_brand", "p_type", "p_name")
    return scored(fuzzy_join(left, right, on=["p_brand", "p_type", "p_name"], suffixes=("_l", "_r"),
                             order_by="id", return_score=True), "id_l", "id_r")


# --------------------------------------------------------------------------- numbers, times, vectors

@query("fuzzy_join_numeric", fuzzy_sql(
    "SELECT s_suppkey AS mid, s_acctbal AS z1 FROM supplier",
    "SELECT c_custkey AS aid, c_acctbal AS z1 FROM customer", text=False, numbers=1)
    + " SELECT mid AS s_suppkey, aid AS c_custkey, round(score, 6) AS score FROM m")
def fuzzy_join_numeric(t: Tables) -> DataFrame:
    found = fuzzy_join(t.supplier, t.customer, left_on="s_acctbal", right_on="c_acctbal",
                       order_by="c_custkey", return_score=True)
    return scored(found, "s_suppkey", "c_custkey")


@query("fuzzy_join_numeric_multi", fuzzy_sql(
    "SELECT s_suppkey AS mid, s_acctbal AS z1, s_nationkey::DOUBLE AS z2 FROM supplier",
    "SELECT c_custkey AS aid, c_acctbal AS z1, c_nationkey::DOUBLE AS z2 FROM customer", text=False, numbers=2)
    + " SELECT mid AS s_suppkey, aid AS c_custkey, round(score, 6) AS score FROM m")
def fuzzy_join_numeric_multi(t: Tables) -> DataFrame:
    found = fuzzy_join(t.supplier, t.customer, left_on=["s_acctbal", "s_nationkey"],
                       right_on=["c_acctbal", "c_nationkey"], order_by="c_custkey", return_score=True)
    return scored(found, "s_suppkey", "c_custkey")


@query("fuzzy_join_datetime", fuzzy_sql(
    "SELECT event_id AS mid, floor(epoch(ts))::DOUBLE AS z1 FROM events WHERE event_type = 'purchase'",
    "SELECT event_id AS aid, floor(epoch(ts))::DOUBLE AS z1 FROM events WHERE event_type = 'click'",
    text=False, numbers=1) + " SELECT mid AS id_l, aid AS id_r, round(score, 6) AS score FROM m")
def fuzzy_join_datetime(t: Tables) -> DataFrame:
    events = t.events.selectExpr("event_id AS id", "ts", "event_type")
    found = fuzzy_join(events.where("event_type = 'purchase'"), events.where("event_type = 'click'"),
                       on="ts", suffixes=("_l", "_r"), order_by="id", return_score=True)
    return scored(found, "id_l", "id_r")


_MIXED = fuzzy_sql(
    f"SELECT c_custkey AS mid, {typo('c_name', 'c_custkey')} AS t, c_acctbal AS z1, c_nationkey::DOUBLE AS z2 FROM customer",
    "SELECT c_custkey AS aid, c_name AS t, c_acctbal + 1 AS z1, c_nationkey::DOUBLE AS z2 FROM customer", numbers=2)


@query("fuzzy_join_mixed", f"{_MIXED} SELECT mid AS id_l, aid AS id_r, round(score, 6) AS score FROM m")
def fuzzy_join_mixed(t: Tables) -> DataFrame:
    left = t.customer.selectExpr("c_custkey AS id", f"{typo('c_name', 'c_custkey')} AS name",
                                 "c_acctbal AS balance", "c_nationkey AS nation")
    right = t.customer.selectExpr("c_custkey AS id", "c_name AS name", "c_acctbal + 1 AS balance",
                                  "c_nationkey AS nation")
    return scored(fuzzy_join(left, right, on=["name", "balance", "nation"], suffixes=("_l", "_r"),
                             order_by="id", return_score=True), "id_l", "id_r")


@query("fuzzy_join_vector", """
WITH p AS (SELECT x.vec_id AS mid, y.vec_id AS aid,
  round(list_distance(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 9) AS d
  FROM embeddings x JOIN embeddings y ON x.label < 5 AND y.label >= 5),
b AS (SELECT mid, aid, d FROM (SELECT *, row_number() OVER (PARTITION BY mid ORDER BY d, aid) AS i FROM p) WHERE i = 1)
SELECT mid AS id_l, aid AS id_r, round(1.0 - d / (2.0 * (SELECT max(d) FROM b)), 6) AS score FROM b""")
def fuzzy_join_vector(t: Tables) -> DataFrame:
    rows = t.embeddings.selectExpr("vec_id AS id", "label", "CAST(vec_id AS STRING) AS title", "embedding")
    found = fuzzy_join(rows.where("label < 5"), rows.where("label >= 5"), on="title",
                       main_vectors="embedding", aux_vectors="embedding", suffixes=("_l", "_r"),
                       order_by="id", return_score=True)
    return scored(found, "id_l", "id_r")


# --------------------------------------------------------------------------- options

@query("fuzzy_join_right", fuzzy_sql(
    "SELECT c_custkey AS mid, c_acctbal AS z1 FROM customer",
    "SELECT s_suppkey AS aid, s_acctbal AS z1 FROM supplier", text=False, numbers=1)
    + """ SELECT CASE WHEN score >= 0.9 THEN aid END AS s_suppkey, CASE WHEN score >= 0.9 THEN s_name END AS s_name,
  mid AS c_custkey, c_name FROM m JOIN supplier ON s_suppkey = aid JOIN customer ON c_custkey = mid""")
def fuzzy_join_right(t: Tables) -> DataFrame:
    found = fuzzy_join(t.supplier, t.customer, how="right", left_on="s_acctbal", right_on="c_acctbal",
                       order_by="s_suppkey", match_score=0.9)
    return found.select("s_suppkey", "s_name", "c_custkey", "c_name")


@query("fuzzy_join_threshold", f"""{_URLS}
SELECT mid AS id_l, CASE WHEN score >= 0.8 THEN aid END AS id_r FROM m""")
def fuzzy_join_threshold(t: Tables) -> DataFrame:
    return fuzzy_join(t.pages.selectExpr("page_id AS id", f"{typo('url', 'page_id')} AS title"),
                      t.pages.selectExpr("page_id AS id", "url AS title"), on="title", analyzer="char",
                      suffixes=("_l", "_r"), order_by="id", match_score=0.8).select("id_l", "id_r")


@query("fuzzy_join_drop_unmatched", f"{_URLS} SELECT mid AS id_l, aid AS id_r FROM m WHERE score >= 0.8")
def fuzzy_join_drop_unmatched(t: Tables) -> DataFrame:
    return fuzzy_join(t.pages.selectExpr("page_id AS id", f"{typo('url', 'page_id')} AS title"),
                      t.pages.selectExpr("page_id AS id", "url AS title"), on="title", analyzer="char",
                      suffixes=("_l", "_r"), order_by="id", match_score=0.8,
                      drop_unmatched=True).select("id_l", "id_r")


_SUPPLIERS = fuzzy_sql("SELECT s_suppkey AS mid, s_name AS t FROM supplier",
                       "SELECT c_custkey AS aid, c_name AS t FROM customer")


@query("fuzzy_join_score", f"{_SUPPLIERS} SELECT mid AS s_suppkey, round(score, 6) AS score FROM m")
def fuzzy_join_score(t: Tables) -> DataFrame:
    return scored(fuzzy_join(t.supplier, t.customer, left_on="s_name", right_on="c_name",
                             order_by="c_custkey", return_score=True), "s_suppkey")


@query("fuzzy_join_suffixes", fuzzy_sql(
    "SELECT s_suppkey AS mid, s_acctbal AS z1 FROM supplier",
    "SELECT c_custkey AS aid, c_acctbal AS z1 FROM customer", text=False, numbers=1)
    + """ SELECT s_suppkey AS id_main, s_acctbal AS balance_main, s_name, c_custkey AS id_aux, c_acctbal AS balance_aux, c_name
  FROM m JOIN supplier ON s_suppkey = mid JOIN customer ON c_custkey = aid""")
def fuzzy_join_suffixes(t: Tables) -> DataFrame:
    left = t.supplier.selectExpr("s_suppkey AS id", "s_acctbal AS balance", "s_name")
    right = t.customer.selectExpr("c_custkey AS id", "c_acctbal AS balance", "c_name")
    return fuzzy_join(left, right, on="balance", suffixes=("_main", "_aux"), order_by="id")


@query("fuzzy_join_sort", f"{_SUPPLIERS} SELECT s_name, aid AS c_custkey, round(score, 6) AS score FROM m JOIN supplier ON s_suppkey = mid ORDER BY s_name")
def fuzzy_join_sort(t: Tables) -> DataFrame:
    return scored(fuzzy_join(t.supplier, t.customer, left_on="s_name", right_on="c_name", sort=True,
                             order_by="c_custkey", return_score=True), "s_name", "c_custkey")


@query("nearest_one", """
WITH p AS (SELECT x.s_suppkey, y.c_custkey, abs(x.s_acctbal - y.c_acctbal) AS d FROM supplier x CROSS JOIN customer y)
SELECT s_suppkey, c_custkey, round(d, 9) AS d FROM (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY d, c_custkey) AS i FROM p) WHERE i = 1""")
def nearest_one(t: Tables) -> DataFrame:
    from tarnish.operators.nearest import nearest_numeric
    main = t.supplier.selectExpr("CAST(s_suppkey AS STRING) AS k", "s_acctbal AS z")
    aux = t.customer.selectExpr("CAST(c_custkey AS STRING) AS k", "c_custkey AS o", "c_acctbal AS z")
    return nearest_numeric(main, aux, F.lit(1.0)).selectExpr(
        "CAST(k AS BIGINT) AS s_suppkey", "CAST(ak AS BIGINT) AS c_custkey", "d")


# --------------------------------------------------------------------------- quality

_STEPS = [0.9, 0.8, 0.7, 0.6, 0.5]


@query("flagship_fuzzy_join_quality", _STRING + """,
s AS (SELECT unnest([0.9, 0.8, 0.7, 0.6, 0.5]::DOUBLE[]) AS match_score),
q AS (SELECT match_score, count(*) FILTER (aid = mid) AS ok, count(*) AS n FROM m, s WHERE score >= match_score GROUP BY match_score)
SELECT match_score, round(ok / (SELECT count(*) FROM customer), 9) AS recall, round(ok / n, 9) AS precision,
  round(2 * (ok / (SELECT count(*) FROM customer)) * (ok / n) / nullif(ok / (SELECT count(*) FROM customer) + ok / n, 0), 9) AS f1 FROM q""")
def flagship(t: Tables) -> DataFrame:
    sweep = sweep_thresholds(_found(t), _STEPS)
    truth = t.customer.selectExpr("c_custkey AS id_l", "c_custkey AS id_r")
    out = join_quality(sweep, truth, ["match_score"])
    return out.select("match_score", *[F.round(c, 9).alias(c) for c in ("recall", "precision", "f1")])


@query("fuzzy_join_pair_quality", _URLS + """,
pairs AS (SELECT DISTINCT mid, aid FROM m), v AS (SELECT count(*) FILTER (mid = aid) / count(*) AS precision,
  count(*) FILTER (mid = aid) / (SELECT count(*) FROM pages) AS recall FROM pairs)
SELECT round(precision, 9) AS precision, round(recall, 9) AS recall,
  round(2 * precision * recall / (precision + recall), 9) AS f1 FROM v""")
def fuzzy_join_pair_quality(t: Tables) -> DataFrame:
    found = fuzzy_join(t.pages.selectExpr("page_id AS id", f"{typo('url', 'page_id')} AS title"),
                       t.pages.selectExpr("page_id AS id", "url AS title"), on="title", analyzer="char",
                       suffixes=("_l", "_r"), order_by="id")
    out = pair_set_quality(found, t.pages.selectExpr("page_id AS id_l", "page_id AS id_r"))
    return out.select(*[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query("auto_fuzzy_join")
def auto_fuzzy_join_query(t: Tables) -> DataFrame:
    return auto_fuzzy_join(_names(t), _typos(t), "id", "title", precision_target=0.9)


# Frequencies over the distinct texts of either side, copies on the left counted as such; nearest
# left text of each right one, and the left rows within twice the distance of that.
_BALLS = f"""
WITH lefts AS (SELECT lower(c_name) AS t, count(*) AS m, min(c_custkey) AS o FROM customer GROUP BY 1),
rights AS (SELECT c_custkey AS id_r, lower({typo('c_name', 'c_custkey')}) AS t FROM customer),
rk AS (SELECT t, count(*) AS m FROM rights GROUP BY t),
every AS (SELECT t, max(m) AS m FROM (SELECT t, m FROM rk UNION ALL SELECT t, m FROM lefts) GROUP BY t),
texts AS (SELECT t, every.m + coalesce(lefts.m, 0) AS m FROM every LEFT JOIN lefts USING (t)),
cnt AS (SELECT t, gram, count(*) AS c FROM ({gram_rows('texts', 't', 't', 'char', 3, 3)}) GROUP BY ALL),
df AS (SELECT gram, sum(m) AS df FROM cnt JOIN texts USING (t) GROUP BY gram),
raw AS (SELECT t, gram, c * (ln((1.0 + (SELECT sum(m) FROM texts)) / (1.0 + df)) + 1.0) AS r FROM cnt JOIN df USING (gram)),
w AS (SELECT t, gram, r / sqrt(sum(r * r) OVER (PARTITION BY t)) AS w FROM raw),
sims AS (SELECT x.t AS a, y.t AS b, round(sqrt(round(greatest(2.0 - 2.0 * round(least(1.0, sum(x.w * y.w)), 9), 0), 9)), 9) AS d
  FROM w x JOIN w y USING (gram) WHERE y.t IN (SELECT t FROM lefts) GROUP BY ALL),
best AS (SELECT rk.t, lefts.t AS l, o, d FROM rk JOIN sims ON a = rk.t JOIN lefts ON b = lefts.t
  QUALIFY row_number() OVER (PARTITION BY rk.t ORDER BY d, o) = 1),
balls AS (SELECT best.t, sum(m) AS ball FROM best JOIN sims ON a = l AND sims.d <= round(2 * best.d, 9) JOIN lefts ON b = lefts.t GROUP BY best.t)
SELECT id_r, o AS id_l, round(d, 6) AS d, CASE WHEN round(2 * d, 9) >= round(sqrt(2), 9) THEN (SELECT sum(m) FROM lefts) ELSE ball END::BIGINT AS ball
FROM rights JOIN best USING (t) JOIN balls USING (t)"""


@query("auto_fuzzy_ball_counts", _BALLS)
def auto_fuzzy_ball_counts(t: Tables) -> DataFrame:
    return ball_counts(_names(t), _typos(t), "id", "title").select("id_r", "id_l", F.round("d", 6).alias("d"), "ball")
