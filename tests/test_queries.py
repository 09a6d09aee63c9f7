"""Every registered query of the reference's operators against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

from tracewell.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def shown(v):
    if v is None or v is pd.NaT or v is pd.NA:
        return "NULL"
    if hasattr(v, "item") and not isinstance(v, pd.Timestamp):
        v = v.item()
    if isinstance(v, float):
        return "NULL" if math.isnan(v) else repr(round(v, 9)).rstrip("0").rstrip(".")
    return str(v)


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(tuple(map(shown, r)) for r in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_duckdb(spark, duck, name):
    got = registry.queries()[name](spark, SF).toPandas()
    assert rows(got) == rows(duck.execute(registry.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    df = registry.queries()[name](spark, SF)
    assert df.count() >= 0 and df.columns


SKETCHED = [("q2_service_metrics_stored", "q2_service_metrics", ["window_start"]), ("q3_top_endpoints_stored", "q3_top_endpoints", ["http_route", "http_method"]), ("q8_error_rate_stored", "q8_error_rate_by_service", ["service_id"])]


@pytest.mark.parametrize(("stored", "exact", "keys"), SKETCHED)
def test_stored_sketches_are_near_the_exact_result(spark, stored, exact, keys):
    """Counters are equal; a sketched quantile lies between the exact ones of its rank give or take three hundredths."""
    a = registry.queries()[stored](spark, SF).toPandas().set_index(keys)
    b = registry.queries()[exact](spark, SF).toPandas().set_index(keys)
    assert sorted(map(str, a.index)) == sorted(map(str, b.index)) and len(a)
    b = b.loc[a.index]
    for c in a.columns:
        if not c.endswith("_us") or c in ("min_us", "max_us"):
            assert (a[c].to_numpy() == b[c].to_numpy()).all(), c
        elif len(a) < 50:  # groups of thousands of spans
            assert ((a[c] - b[c]).abs() <= 0.06 * b[c]).all(), c


def test_top_k_of_roots_is_pushed(spark):
    plan = registry.queries()["q5_slow_roots"](spark, SF)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan and "PushedFilters" in plan
