"""Every registered query with SQL gives that SQL's rows; and some plans are what they should be."""

import datetime
import math

import duckdb
import pytest

from lodestone.plans import registry
from lodestone.plans.pairs import TABLES


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_rows(spark, data, duck, name):
    df = registry.QUERIES[name](spark, data)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    cursor = duck.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    want = sorted(tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in cursor.fetchall())
    assert columns == sorted(names)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(spark, data, name):
    assert registry.QUERIES[name](spark, data).count() > 0


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_filters_and_columns_reach_the_scan(spark, data):
    text = plan(registry.QUERIES["tpch_q06"](spark, data))
    assert "PushedFilters" in text and "GreaterThanOrEqual(l_shipdate" in text.replace(" ", "") or "l_shipdate" in text
    read = next(x for x in text.splitlines() if "ReadSchema" in x)
    assert "l_comment" not in read and read.count(":") <= 6


@pytest.mark.parametrize("name", ["tpch_q03", "tpch_q18", "join_band", "distinct_on", "set_except_all"])
def test_other_plans_give_the_same_rows(spark, data, name):
    base = sorted(map(str, registry.QUERIES[name](spark, data).collect()))
    changes = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    old = {k: spark.conf.get(k) for k in changes}
    try:
        for k, v in changes.items():
            spark.conf.set(k, v)
        assert sorted(map(str, registry.QUERIES[name](spark, data).collect())) == base
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_no_query_nests_loops_without_a_key(spark, data):
    for name in ("join_band", "join_range_overlap", "join_asof", "distinct_on", "fetch_with_ties"):
        text = plan(registry.QUERIES[name](spark, data))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_lateral_orders_nulls_last(spark, tmp_path):
    con, folder = duckdb.connect(), str(tmp_path)
    con.execute(f"COPY (SELECT 1::BIGINT AS c_custkey) TO '{folder}/customer.parquet'")
    con.execute(f"COPY (SELECT * FROM (VALUES (NULL::BIGINT, 1::BIGINT, 5.0::DOUBLE), (7, 1, 5.0), (8, 1, NULL), (9, 1, 5.0)) AS o(o_orderkey, o_custkey, o_totalprice)) TO '{folder}/orders.parquet'")
    for t in ("customer", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    got = sorted(map(tuple, registry.QUERIES["join_lateral"](spark, folder).collect()))
    assert got == sorted(con.execute(registry.ORACLE_SQL["join_lateral"]).fetchall()) == [(1, 7), (1, 9)]
