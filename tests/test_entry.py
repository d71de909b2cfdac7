"""The contract of __spark_entry__ and its queries on the smallest tables."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as contract
from loomtally.plans import experiments, registry

FOLDER = "/root/testdata/sf0.001"
QUICK = ("partition_stats", "exact_dedup", "select_reasons", "document_split", "group_split", "character_prefix", "unigram_baseline", "model_size_search", "near_dup_survivors", "top_tokens", "matrix_report", "exposure_unigram", "distinct_counts", "tree_hash", "folded_texts", "anchor_index", "encoded_roundtrip", "rolling_windows", "early_scan")


def test_entry_runs(spark):
    assert contract.entry(spark).count() > 0


def test_oracles_belong_to_queries():
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_its_sql(spark, name):
    queries, oracles = registry.QUERIES | experiments.QUERIES, registry.ORACLES | experiments.ORACLES
    got = queries[name](spark, FOLDER).toPandas()
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        con.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    want = con.sql(oracles[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)

    def cell(v):  # a nullable whole number may come as a float
        if pd.isna(v):
            return "~"
        return str(round(float(v), 5)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    plain = lambda d: sorted(tuple(map(cell, r)) for r in d[columns].itertuples(index=False))
    assert plain(got.astype(object)) == plain(want.astype(object))
