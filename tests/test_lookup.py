"""The career lookup against SQL over all customers."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_points

FOLDER = Path("/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no test tables")


def test_careers_of_all_customers(spark):
    con = duckdb.connect()
    for file in FOLDER.glob("*.parquet"):
        con.execute(f"create view {file.stem} as select * from '{file}'")
    sql = entry_points.oracle_sql()["career_lookup"]
    assert "% 10" not in sql
    expected = con.sql(sql)
    df = entry_points.queries()["career_lookup"](spark, str(FOLDER))
    columns = sorted(df.columns)
    order = [expected.columns.index(c) for c in columns]
    want = sorted(repr(tuple(row[i] for i in order)) for row in expected.fetchall())
    con.close()
    assert sorted(repr(tuple(row[c] for c in columns)) for row in df.collect()) == want
    assert len({w.split("Customer#")[1][:9] for w in want}) > 20
