"""Registered queries against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_points

SF = "/root/testdata/sf0.001"
CHECKED = ["drop_sparse_columns", "remove_missing_values", "fixed_size_split", "group_kfold", "group_multi_agg",
           "rank_avg_desc", "metric_roc_auc", "char_wb_ngrams", "word_ngrams", "profile_ngram_quantiles",
           "tfidf_vectorizer", "minhash_encode", "fuzzy_join_numeric", "fuzzy_join_string_char",
           "report_column_gain", "report_ensemble_gain", "label_encode", "validate_target", "ordinal_encode", "grid_cross_join",
           "pairing_rules", "critical_difference_groups", "quantile_to_normal", "power_transform", "preprocess_features",
           "encode_dispatch", "encode_high_cardinality", "table_vectorizer", "pca_reduce", "truncated_svd", "nearest_one",
           "scan_csv", "vector_cache", "filter_isin", "group_mean", "last_row_per_group", "join_quality",
           "fuzzy_join_mixed", "fuzzy_join_vector", "soft_clip_outliers"]


def test_oracles_belong_to_queries():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, name):
    from tools.verify import TABLES, rows_of
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry_points.queries()[name](spark, SF)
    cur = con.execute(entry_points.oracle_sql()[name])
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(
        [d[0] for d in cur.description], cur.fetchall())
