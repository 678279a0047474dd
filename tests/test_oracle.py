"""Every query against its SQL on DuckDB, over whole tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_points
from periodica.plans.oracle import ORACLES
from periodica.plans.registry import QUERIES

FOLDER = Path("/root/testdata/sf0.001")
SPARK_TO_DUCK = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
}

pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in FOLDER.glob("*.parquet"):
        con.execute(f"create view {file.stem} as select * from '{file}'")
    yield con
    con.close()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    df = entry_points.queries()[name](spark, str(FOLDER))
    expected = duck.sql(entry_points.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(expected.columns)
    types = dict(zip(expected.columns, map(str, expected.types), strict=True))
    assert {c: SPARK_TO_DUCK[t] for c, t in df.dtypes} == types
    got = sorted(repr(tuple(row[c] for c in columns)) for row in df.collect())
    order = [expected.columns.index(c) for c in columns]
    want = sorted(repr(tuple(row[i] for i in order)) for row in expected.fetchall())
    assert got == want
    assert got


def test_only_matching_blocks_go_without_sql():
    assert set(QUERIES) - set(ORACLES) == {"resolve_fuzzy_ratio"}


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
