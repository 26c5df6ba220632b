"""Every query against the SQL that gives the same rows, on the smallest tables."""

import math

import duckdb
import pandas as pd
import pytest

from lodegrid.catalogue import ORACLE, QUERIES, flagship

SF = "/root/testdata/sf0.001"
TABLES = ("nation", "supplier", "part", "lineitem", "events")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def cell(v):
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and math.isnan(v):
        return "NULL"
    if isinstance(v, float):
        return str(int(v)) if v == int(v) and abs(v) < 1e15 else repr(round(v, 9))
    return str(v)


def table(df):
    return sorted(tuple(cell(v) for v in row) for row in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, duck, name):
    ours, theirs = QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLE[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert table(ours) == table(theirs)


def test_flagship(spark):
    rows = flagship(spark, SF).collect()
    assert rows and all((r.value is None) == (r.hours == 0) for r in rows)


def test_flagship_over_years_follows_the_events(spark, tmp_path):
    duckdb.sql(f"""COPY (SELECT ts::TIMESTAMP AS ts, user_id::BIGINT AS user_id, value::DOUBLE AS value FROM (VALUES
      ('2004-02-28 03:10:00', 1, 2.5), ('2004-02-28 03:50:00', 1, 4.0), ('2004-02-28 04:00:00', 1, NULL), ('2004-02-28 10:00:00', 1, 7.25),
      ('2004-02-28 20:30:00', 1, 9.0), ('2009-12-31 23:59:59', 2, 1.0), ('2010-01-01 00:00:00', 2, 3.0), ('2010-01-02 00:00:00', 3, NULL),
      ('2023-06-30 22:15:00', 1, 5.0), ('2023-07-01 02:15:00', 2, 6.0), (NULL, 4, 1.0), ('2010-01-02 00:00:00', NULL, 1.0)) v(ts, user_id, value)) TO '{tmp_path}/events.parquet' (FORMAT parquet)""")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet') WHERE ts IS NOT NULL AND user_id IS NOT NULL")
    made = flagship(spark, str(tmp_path))
    assert "unboundedfollowing" not in made._jdf.queryExecution().toString().lower(), "three stations of 170 000 hours each, squared"
    assert table(made.toPandas()) == table(con.execute(ORACLE["hourly_fill_daily_mean"]).df())


def test_bounds_reach_the_scan(spark):
    plan = QUERIES["scan_bounds"](spark, SF)._jdf.queryExecution().toString()
    pushed = plan.split("PushedFilters:")[-1]
    assert "l_shipdate,1996-03-01" in pushed and "cast(l_shipdate" not in plan
    assert "l_tax" not in pushed


def test_no_products_in_joins(spark):
    for name in ("nearest_uniform", "nearest_2d_points", "bilinear_2d", "linear_1d", "convolve_2d_mean3", "expand_time", "composite_tile", "doy_window3_mean"):
        physical = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in physical, name


def test_empty_groups_over_all_rows(spark, duck):
    n, kept = duck.execute("SELECT count(*), count(DISTINCT l_suppkey) * 8 FROM lineitem").fetchone()
    assert n > kept, "a cap of eight rows a station would show"
    got = {r.station: r.value for r in QUERIES["reduce_sum_empty"](spark, SF).collect()}
    assert sum(got.values()) == pytest.approx(duck.execute("SELECT sum(l_quantity / 25) FROM lineitem WHERE l_suppkey % 2 = 0").fetchone()[0], abs=0.01)
    products = [r.value for q in ("reduce_prod_empty", "group_month_prod") for r in QUERIES[q](spark, SF).collect()]
    assert all(0.5 < v < 2 for v in products) and len(set(products)) > 12
