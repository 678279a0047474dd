"""Runs against a plain loop, fits against a library's least squares, grouping sets by hand."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from periodica.operators import fit, runs, value
from periodica.plans.registry import QUERIES


def by_loop(events):
    out = {}
    for name, _, reached in sorted(events, key=lambda e: (e[0], e[1], e[2])):
        n, best, now = out.get(name, (0, 0, 0))
        now = now + 1 if reached else 0
        out[name] = (n + 1, max(best, now), now)
    return out


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("share", [0.05, 0.5, 0.97, 1.0])
def test_runs_across_batches_and_ranges(spark, small_batches, share):
    """A third of the events are one entity's, with ties, over several ranges and many batches."""
    draw = random.Random(int(share * 100))
    events = [
        ("hot" if draw.random() < 0.35 else f"e{draw.randrange(40)}", draw.randrange(900), draw.random() < share)
        for _ in range(2000)
    ]
    df = spark.createDataFrame(events, "who string, at int, hit boolean").repartition(6)
    found = runs.longest_runs(df, "who", ["at"], F.col("hit"))
    got = {r["who"]: (r["events"], r["longest_run"], r["current_run"]) for r in found.collect()}
    assert got == by_loop(events)


def test_a_hot_entity_is_read_by_several_tasks(spark, small_batches):
    df = spark.range(4000).selectExpr("'one' as who", "id as at", "id % 1000 != 0 as hit")
    places = ["who", "at"]
    parts = df.repartitionByRange(*places).groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) > 1 and max(p["count"] for p in parts) < 2500
    assert runs.longest_runs(df, "who", ["at"], F.col("hit")).first()["longest_run"] == 999


def test_runs_of_odd_rows(spark):
    df = spark.createDataFrame(
        [
            ("a", None, True, 2),
            ("a", 1, True, 3),
            ("a", 2, None, 1),
            ("a", 3, True, 0),
            ("a", 4, True, 1),
            (None, 1, True, 9),
            ("b", 1, False, 5),
            ("", 1, True, 1_000_000_000_000),
        ],
        "who string, at int, hit boolean, n bigint",
    )
    found = runs.longest_runs(df, "who", ["at"], F.col("hit"), "n").collect()
    assert sorted(map(tuple, found)) == [
        ("", 10**12, 10**12, 10**12),
        ("a", 7, 5, 1),
        ("b", 5, 0, 0),
    ]
    empty = runs.longest_runs(df.where("false"), "who", ["at"], F.col("hit"), "n")
    assert empty.columns == ["who", "events", "longest_run", "current_run"]
    assert empty.collect() == []


def test_fit_equals_least_squares(spark):
    draw = np.random.default_rng(5)
    x = np.round(draw.normal(20, 6, 600), 2)
    z = draw.integers(19, 40, 600)
    w = np.round(draw.normal(0, 50, 600), 2)
    y = np.round(3 + 1.7 * x - 0.4 * z + 0.01 * w + draw.normal(0, 2, 600), 2)
    group = draw.integers(0, 3, 600)
    table = [tuple(float(v) for v in row[:4]) + (int(row[4]),) for row in zip(x, z, w, y, group, strict=True)]
    df = spark.createDataFrame(table, "x double, z double, w double, y double, g int")
    found = {r["g"]: r for r in fit.least_squares(df, "y", ["x", "z", "w"], "g").collect()}
    for g in range(3):
        mine = group == g
        matrix = np.column_stack([np.ones(mine.sum()), x[mine], z[mine], w[mine]])
        want, rest, *_ = np.linalg.lstsq(matrix, y[mine], rcond=None)
        np.testing.assert_allclose([found[g]["intercept"], *found[g]["coefficients"]], want, rtol=1e-6)
        assert found[g]["fit_rows"] == mine.sum()
        assert found[g]["spread"] == pytest.approx((rest[0] / (mine.sum() - 4)) ** 0.5, rel=1e-6)


def test_fit_of_odd_columns(spark):
    rows = [(float(i), 2.0 * i, 7.0, 5.0 + 3 * i, 1) for i in range(8)]
    rows += [(None, 1.0, 7.0, 1.0, 1), (float("inf"), 1.0, 7.0, 1.0, 1), (1.0, 1.0, 7.0, float("nan"), 1)]
    rows += [(float(i), 0.0, 0.0, float(i), 2) for i in range(4)]
    rows += [(float(i), 0.0, 0.0, 4.0, None) for i in range(6)]
    df = spark.createDataFrame(rows, "x double, twice double, same double, y double, g int")
    found = {r["g"]: r for r in fit.least_squares(df, "y", ["x", "twice", "same"], "g").collect()}
    # repeated and constant predictors add nothing; four rows are too few for four unknowns
    assert set(found) == {1, None}
    assert found[1]["coefficients"] == [pytest.approx(3.0), 0.0, 0.0]
    assert found[1]["intercept"] == pytest.approx(5.0)
    assert found[1]["spread"] == 0.0 and found[1]["fit_rows"] == 8
    assert found[None]["coefficients"] == [0.0, 0.0, 0.0] and found[None]["intercept"] == 4.0
    assert fit.least_squares(df.where("false"), "y", ["x"], "g").collect() == []


STATS = (
    "Player string, Season int, Tm string, Pos string, Age int, G double, PTS double, "
    "AST double, TRB double, STL double, BLK double, TOV double"
)
MONEY = "playerName string, seasonStartYear int, salary string"


def test_availability_by_position_and_age(spark):
    stats = spark.createDataFrame(
        [
            ("a", 2021, "X", "C-F", 21, 41.0, *[0.0] * 6),
            ("b", 2021, "X", "C", 24, 82.0, *[0.0] * 6),
            ("c", 2021, "X", None, 31, 20.5, *[0.0] * 6),
            ("d", 2021, "X", "G", 21, 1.0, *[0.0] * 6),
        ],
        STATS,
    )
    money = spark.createDataFrame(
        [("a", 2021, "$9"), ("b", 2021, "$9"), ("c", 2021, "$9"), ("d", 2021, "$1")], MONEY
    )
    found = value.availability_by(stats, money, floor=0.3)
    assert sorted(map(tuple, found.select("grouped_by", "position", "age_from", "num_players", "avg_availability").collect()), key=repr) == sorted(
        [
            ("position and age", "C", 20, 2, 0.75),
            ("position and age", None, 30, 1, 0.25),
            ("position", "C", None, 2, 0.75),
            ("position", None, None, 1, 0.25),
            ("age", None, 20, 2, 0.75),
            ("age", None, 30, 1, 0.25),
            ("all", None, None, 3, 0.583),
        ],
        key=repr,
    )
    assert value.availability_by(stats.where("false"), money).collect() == []


def test_priced_off_the_fit(spark):
    stats = [(f"p{i}", 2021, "X", "C", 20 + i % 7, 40.0, 40.0 * i, *[0.0] * 5) for i in range(40)]
    paid = [(f"p{i}", 2021, f"${(2 + i + (25 if i == 20 else 0)) * 1_000_000:,}") for i in range(40)]
    stats += [("alone", 2019, "X", "C", 20, 40.0, 40.0, *[0.0] * 5)]
    paid += [("alone", 2019, "$5,000,000")]
    found = value.expected_amount(
        spark.createDataFrame(stats, STATS), spark.createDataFrame(paid, MONEY)
    ).collect()
    assert {r["Player"] for r in found if r["priced"] == "above"} == {"p20"}
    assert {r["priced"] for r in found if r["Player"] not in ("p20", "alone")} == {"as expected"}
    alone = next(r for r in found if r["Player"] == "alone")
    assert alone["expected_millions"] is None and alone["priced"] is None
    assert len(found) == 41


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(plan):
    return len(re.findall(r"(?<![A-Za-z])Exchange ", plan))


def test_grouping_sets_share_an_exchange(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        folder = "/root/testdata/sf0.001"
        trend = shuffles(plan_of(QUERIES["q15_avail"](spark, folder)))
        by = plan_of(QUERIES["availability_by_position_and_age"](spark, folder))
        # the trend groups by the period it was joined on, these groups need an exchange of their own
        assert shuffles(by) <= trend + 1 and by.count("Expand") == 1
        priced = plan_of(QUERIES["expected_amount"](spark, folder))
        assert "ReusedExchange" in priced and priced.count("lineitem.parquet") == 1
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
