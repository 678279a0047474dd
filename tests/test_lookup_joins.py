"""Joins of names are merge joins: no side that grows with the data goes through the driver."""

from __future__ import annotations

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from periodica.operators import names
from periodica.sources.staging import staged

FOLDER = Path("/root/testdata/sf0.001")


def broadcast_keys(df) -> list[str]:
    """What the plan's broadcast joins join on."""
    text = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"Broadcast(?:Hash|NestedLoop)Join (.*)", text)


def test_neighbourhoods_are_not_broadcast(spark):
    known = spark.range(3000).selectExpr("format_string('part%05d', id) as norm_key")
    known = staged(known.selectExpr("norm_key", "norm_key as name"), "names-known")
    typed = known.select(F.concat("norm_key", F.lit("x")).alias("typed_key"))
    for edits in (1, 2):
        joined = broadcast_keys(names.near_join(staged(typed, "names-open"), known, edits))
        # but for the list of lengths
        assert len(joined) == 1 and "length" in joined[0]
    text = names.far_join(typed, known, "ratio", 0.6)._jdf.queryExecution().executedPlan().toString()
    # names meet their groups last
    assert [kind for kind in re.findall(r"(\w+)Join \[", text)][:2] == ["SortMerge"] * 2


@pytest.mark.skipif(not FOLDER.exists(), reason="no test tables")
@pytest.mark.parametrize("query", ["career_lookup", "percentile_lookup"])
def test_lookups_broadcast_bounded_tables_only(spark, query):
    joined = broadcast_keys(entry_points.queries()[query](spark, str(FOLDER)))
    for keys in joined:
        assert re.match(r"\[(c_nationkey|__piece)", keys), keys
