"""Every registered query equals its DuckDB oracle on the smallest driver tables."""

import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as E
from souk.plans import oracle, registry
from souk.sources.tables import DRIVER_TABLES

SF = "/root/testdata/sf0.001"
NAMES = sorted(registry.queries())


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float) and math.isnan(v):
        return None
    if hasattr(v, "item"):
        v = v.item()
    return v


def _rows(df):
    cols = sorted(df.columns)
    rows = [tuple(_norm(v) for v in r) for r in df[cols].itertuples(index=False, name=None)]
    return sorted(rows, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for t in DRIVER_TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def test_every_query_has_an_oracle():
    assert set(oracle.QUERIES) == set(NAMES) <= set(E.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck, name):
    got = E.queries()[name](spark, SF).toPandas()
    want = duck.sql(E.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    assert _rows(got) == _rows(want)


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["year", "month_name", "total_orders", "total_revenue", "mom_revenue_growth_pct",
                          "yoy_revenue_growth_pct", "seasonality_tag"]


RANKED = ["customer_pareto", "customer_running_revenue", "purchase_latency", "churn_risk_count",
          "review_surrogate_keys", "review_identity_keys"]
SELECTED = ["rfm_segments", "slow_dispatch_sellers", "seller_pareto", "customer_360"]


@pytest.mark.parametrize("name", RANKED)
def test_ranked_queries_match_oracle_with_many_ranges(spark, duck, name, monkeypatch):
    import souk.operators.ranks as ranks

    plain = ranks.bucketize
    monkeypatch.setattr(ranks, "bucketize", lambda df, order, buckets=None: plain(df, order, buckets or 50))
    got = E.queries()[name](spark, SF).toPandas()
    want = duck.sql(E.oracle_sql()[name]).df()
    assert _rows(got) == _rows(want)


@pytest.mark.parametrize("name", SELECTED)
def test_selected_tiles_match_oracle_with_few_cells(spark, duck, name, monkeypatch):
    import souk.operators.selection as selection

    monkeypatch.setattr(selection, "CELLS", 5)
    got = E.queries()[name](spark, SF).toPandas()
    want = duck.sql(E.oracle_sql()[name]).df()
    assert _rows(got) == _rows(want)
