"""Reports beside their SQL where a number lies on a tie of its text."""

import datetime

import duckdb
import numpy as np
import pytest

from chronoloom.plans import feature_queries as fq

#: Ratios of quantiles that are 1.29375, 1.54375 and 1.93785.
TIES = [
    [0.05, 0.81, 3.36, 5.14, 12.62, 15.37, 21.7, 25.08, 25.63, 26.74, 27.52, 27.81, 28.4],
    [1.07, 3.79, 9.47, 21.51, 22.58, 25.09, 29.09, 29.46],
    [0.6, 0.63, 0.7, 1.46, 1.69, 3.63, 4.28, 4.56, 4.7, 5.26, 5.58, 6.42, 6.54, 9.04, 9.06, 10.34, 11.58, 11.61, 11.63, 12.02, 13.64,
     13.72, 14.64, 15.15, 15.38, 16.24, 18.31, 18.52, 18.53, 19.78, 19.89, 21.09, 22.93, 23.21, 24.51, 24.69, 25.56, 26.16, 27.44, 28.9, 29.72, 29.96],
]


def events_of(spark, folder, series):
    start = datetime.datetime(2024, 1, 1)
    rows = [(1000 * u + i, start + datetime.timedelta(minutes=i), u, "view", float(v), "{}") for u, values in enumerate(series) for i, v in enumerate(values)]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string").write.parquet(f"{folder}/events.parquet")
    db = duckdb.connect()
    db.sql(f"create view events as select * from '{folder}/events.parquet/*.parquet'")
    return str(folder), db


@pytest.mark.parametrize("name", ["d11_basic_statistics_report"])
def test_report_on_ties_equals_sql(spark, tmp_path, name):
    folder, db = events_of(spark, tmp_path, TIES)
    got = sorted(tuple(r) for r in fq.QUERIES[name](spark, folder).collect())
    assert got == sorted(db.sql(fq.ORACLE_SQL[name]).fetchall())


def stepped():
    """Levels that change, noise, a short series and an even one, of two decimals; means of segments on ties too."""
    rng = np.random.default_rng(8)
    level = lambda *at, n=20: np.round(np.repeat(at, n) + rng.normal(0, 0.3, n * len(at)), 2)
    many = [level(*rng.integers(0, 40, rng.integers(2, 9)), n=int(rng.integers(6, 21))) for _ in range(30)]
    tie = np.round(level(0.0, 9.0, n=40) * 0.1, 2)
    return [*many, level(3.0, 9.0, 4.0), tie, level(1.0, n=61), np.ones(12), level(2.0, n=9), level(5.0, 50.0, n=8)]


def test_dynamics_report_has_change_points_as_its_sql(spark, tmp_path):
    folder, db = events_of(spark, tmp_path, [x.tolist() for x in stepped()])
    got = dict(tuple(r) for r in fq.QUERIES["d20_dynamics_report"](spark, folder).collect())
    assert got == dict(db.sql(fq.ORACLE_SQL["d20_dynamics_report"]).fetchall())
    assert "Changepoint Count: 2.0" in got["30"] and sum("Changepoint Count: 0.0" not in r for r in got.values()) > 20
    assert all(len(r.split("\n")) == 9 for r in got.values())
