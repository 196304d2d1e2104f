"""Every registered query beside its SQL, on the smallest tables."""

import math
import os
import re

import duckdb
import pytest

import __spark_entry__ as entry
from chronoloom.plans import feature_queries, forecast_queries, step_queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
MODULES = (feature_queries, forecast_queries, step_queries)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL = {k: q for m in MODULES for k, q in m.ORACLE_SQL.items()}


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.5g}" if abs(v) > 1e-9 else "0"
    return str(v)


def table(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted([norm(r[i]) for i in order] for r in data)


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf_dir, db, name):
    df = QUERIES[name](spark, sf_dir)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    rel = db.sql(SQL[name])
    assert got == table(rel.columns, rel.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_has_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize(("name", "most", "scans"), [("f10_total_score", 6, 2), ("f11_final_reward", 6, 2), ("d01_d10_basic_statistics", 1, 1), ("d38_feature_table", 12, 8), ("g04_gae_advantage", 4, 2), ("a03_build_series_partial", 1, 1)])
def test_plans_stay_small(spark, sf_dir, name, most, scans):
    """Exchanges and scans before any is reused."""
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"(?:Broadcast|Shuffle)?Exchange ", plan)) <= most and plan.count("FileScan") <= scans
