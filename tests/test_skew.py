"""A third of everything on one key, and no broadcast to hide behind: answers stay the same."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_points

FOLDER = Path("/root/testdata/sf0.001")
QUERIES = (
    "dedup_preferred",
    "dedup_window",
    "q04_sustained",
    "q06_top_debut",
    "q07_percentiles",
    "q08_topn_per_group",
    "q09_most_improved",
    "q10_consistency",
    "q12_cost_per_unit",
    "q14_peak_index",
    "q15_avail",
    "availability_by_position_and_age",
    "expected_amount",
    "longest_streak",
    "resolve_list",
)

pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no test tables")

#: one order with a third of the lines, one customer with a third of the orders, one name for a
#: third of the customers, one part name for a third of the parts
SKEW = {
    "lineitem": "select * replace (if(l_linenumber % 3 = 0, 1, l_orderkey) as l_orderkey) from t",
    "orders": "select * replace (if(o_orderkey % 3 = 0, 2, o_custkey) as o_custkey) from t",
    "customer": "select * replace (if(c_custkey % 3 = 0, 'Customer#same7', c_name) as c_name) from t",
    "part": "select * replace (if(p_partkey % 3 = 0, 'red widget', p_name) as p_name) from t",
    "nation": "select * from t",
}


@pytest.fixture(scope="module")
def skewed(tmp_path_factory):
    folder = tmp_path_factory.mktemp("skewed")
    con = duckdb.connect()
    for table, sql in SKEW.items():
        source = sql.replace(" from t", f" from '{FOLDER}/{table}.parquet'")
        con.execute(f"copy ({source}) to '{folder}/{table}.parquet' (format parquet)")
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    yield str(folder), con
    con.close()


CASES = [("merge", name) for name in QUERIES]
CASES += [("default", name) for name in ("q07_percentiles", "q15_avail")]


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


@pytest.mark.parametrize(("joins", "name"), CASES)
def test_matches_sql_under_skew(spark, skewed, request, joins, name):
    if joins == "merge":
        request.getfixturevalue("no_broadcast")
    folder, duck = skewed
    df = entry_points.queries()[name](spark, folder)
    expected = duck.sql(entry_points.oracle_sql()[name])
    columns = sorted(df.columns)
    order = [expected.columns.index(c) for c in columns]
    got = sorted(repr(tuple(row[c] for c in columns)) for row in df.collect())
    assert got == sorted(repr(tuple(row[i] for i in order)) for row in expected.fetchall())
