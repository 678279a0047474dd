"""Tables that are replaced in two steps, staged results, and the layout by season."""

from __future__ import annotations

import re
from pathlib import Path

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from periodica.operators import keys, trends
from periodica.plans.presets import ORDERS as P
from periodica.sources import load, seasons, staging
from periodica.sources.star import Star

FOLDER = "/root/testdata/sf0.001"

needs_tables = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


def values(df):
    return sorted(r[0] for r in df.collect())


@pytest.mark.parametrize("by", [None, "part"])
def test_a_lost_write_leaves_the_old_table(spark, tmp_path, by):
    path = str(tmp_path / "t")
    rows = spark.range(10).withColumn("part", F.col("id") % 2)
    load.write_table(rows, path, by)
    old = load.current_version(spark, path)
    broken = rows.withColumn("id", F.expr("if(id = 7, raise_error('lost'), id)"))
    with pytest.raises(PySparkException):
        load.write_table(broken, path, by)
    assert load.current_version(spark, path) == old
    assert values(load.read_table(spark, path)) == list(range(10))
    # what the lost job left goes with the next write
    load.write_table(spark.range(3).withColumn("part", F.lit(0)), path, by)
    assert values(load.read_table(spark, path)) == [0, 1, 2]
    left = {p.name for p in Path(path).iterdir() if p.name.startswith("v-")}
    assert left == {old, load.current_version(spark, path)}


def test_a_table_is_replaced_from_itself(spark, tmp_path):
    path = str(tmp_path / "t")
    load.write_table(spark.range(5).toDF("x"), path)
    for _ in range(3):
        now = load.read_table(spark, path)
        load.write_table(now.unionByName(now), path)
    assert load.read_table(spark, path).count() == 40
    assert len([p for p in Path(path).iterdir() if p.name.startswith("v-")]) == 2


def test_a_reader_keeps_its_version(spark, tmp_path):
    path = str(tmp_path / "t")
    load.write_table(spark.range(5), path)
    before = load.read_table(spark, path)
    load.write_table(spark.range(2), path)
    assert before.count() == 5
    assert load.read_table(spark, path).count() == 2


def test_no_table(spark, tmp_path):
    assert load.current_version(spark, str(tmp_path)) is None
    with pytest.raises(ValueError, match="no table"):
        load.read_table(spark, str(tmp_path))


def test_staged_results_go_when_they_are_discarded(spark):
    staging.discard(spark)
    kept = staging.staged(spark.range(7), "numbers")
    (file, *_) = kept.inputFiles()
    folder = Path(re.sub("^file:/*", "/", file)).parent
    assert kept.count() == 7 and folder.exists()
    assert staging.discard(spark) == 1
    assert not folder.exists()
    assert staging.discard(spark) == 0


def test_possible_keys(spark):
    rows = spark.range(5000).selectExpr("id * 7 as k").union(spark.sql("select cast(null as long)"))
    asked = spark.range(0, 5000, 10).selectExpr("id * 7 as k")
    got = values(keys.possibly_in(rows, "k", asked))
    assert set(values(asked)) <= set(got) and len(got) < 520
    # with hardly any bits all rows pass, and none is lost
    assert keys.possibly_in(rows, "k", asked, bits=8).count() == 5000
    assert keys.possibly_in(rows, "k", asked.where("k < 0")).count() == 0
    text = rows.selectExpr("cast(k as string) as k")
    assert keys.possibly_in(text, "k", text.limit(3)).count() >= 3


@pytest.fixture(scope="module")
def laid_out(spark):
    star = seasons.season_star(spark, FOLDER, buckets=4)
    yield star
    seasons.drop_layout(spark, star.facts)


@pytest.fixture
def plain_plans(spark):
    """Plans as they are, without adaptive execution, broadcasts and filters made at run time."""
    settings = {
        "spark.sql.adaptive.enabled": "false",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.optimizer.runtime.bloomFilter.enabled": "false",
    }
    old = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@needs_tables
def test_line_items_are_not_shuffled(laid_out, plain_plans):
    orders = laid_out.orders((P.season, P.season)).withColumnRenamed("o_orderkey", "l_orderkey")
    joined = laid_out.order_totals((P.season, P.season)).join(orders, "l_orderkey")
    assert "Exchange" not in plan(joined)
    assert "SortMergeJoin" in plan(joined)
    # one season's folders are read, of several
    assert len({re.search(r"Season=(\d+)", f)[1] for f in laid_out.order_totals(None).inputFiles()}) > 3
    filters = re.findall(r"PartitionFilters: \[[^\n]*?\]", plan(joined))
    assert len(filters) == 2 and all(f"<= {P.season}" in f for f in filters)
    assert joined.count() > 0


@needs_tables
@pytest.mark.parametrize("period", [None, (P.season, P.season), (P.previous_season, P.season)])
def test_layout_has_the_same_rows(spark, laid_out, period):
    plain = Star(spark, FOLDER)
    for make in ("player_stats", "player_games", "salaries"):
        a, b = getattr(plain, make)(period), getattr(laid_out, make)(period)
        assert a.columns == b.columns
        assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0


@needs_tables
def test_players_are_filtered_before_line_items_are_totalled(spark, plain_plans):
    star = Star(spark, FOLDER)
    chosen = star.table("customer").where("c_custkey % 7 = 0").selectExpr("c_name as Player")
    some = star.player_stats(players=chosen.unionByName(chosen))
    text = plan(some)
    # below the totals of line items stands the join with the bitmap
    assert text.index("partial_count(1)") < text.index("BroadcastHashJoin [__piece")
    assert len(re.findall(r"(?<!Reused)(?<!Broadcast)Exchange (?:hash|range|single)", text)) <= 20
    everyone = star.player_stats().join(chosen, "Player", "left_semi").select(some.columns)
    assert everyone.exceptAll(some).count() == some.exceptAll(everyone).count() == 0
    assert star.player_stats(players=chosen.limit(0)).count() == 0


@needs_tables
def test_a_season_of_games_reads_line_items_once(spark, plain_plans):
    games = Star(spark, FOLDER).player_games((P.season, P.season))
    layout = trends.DetailLayout(weight="games")
    df = trends.consistency(
        trends.totals(games, detail_layout=layout), games, P.season, 1, 0, detail_layout=layout
    )
    text = plan(df)
    found = re.findall(r"(?<!Reused)(?<!Broadcast)Exchange (?:hash|range|single)", text)
    assert text.count("ReusedExchange") >= 1
    assert len(re.findall(r"FileScan parquet [^\n]*l_quantity", text)) == 1
    assert len(found) <= 12


def test_a_hot_order_is_a_few_rows_of_the_layout(spark, tmp_path):
    """A third of all line items in one order: its rows in the layout are its quantities."""
    for name in ("customer", "nation"):
        spark.read.parquet(f"{FOLDER}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    orders = spark.read.parquet(f"{FOLDER}/orders.parquet").limit(50)
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    hot = orders.first()["o_orderkey"]
    lines = spark.read.parquet(f"{FOLDER}/lineitem.parquet")
    one = lines.limit(1).withColumn("l_orderkey", F.lit(hot).cast(lines.schema["l_orderkey"].dataType))
    many = one.crossJoin(spark.range(3000)).withColumn("l_quantity", (F.col("id") % 50 + 1).cast("double"))
    many = many.select(*[F.col(c).cast(lines.schema[c].dataType) for c in lines.columns])
    lines.unionByName(many).write.parquet(f"{tmp_path}/lineitem.parquet")
    star = seasons.season_star(spark, str(tmp_path), buckets=3)
    rows = star.counted_lines(None).where(F.col("l_orderkey") == hot)
    own = lines.where(F.col("l_orderkey") == hot).count()
    assert rows.count() <= 50 + own
    assert rows.agg(F.sum("games")).first()[0] == 3000 + own
    plain = Star(spark, str(tmp_path)).player_stats()
    got = star.player_stats()
    assert plain.exceptAll(got).count() == got.exceptAll(plain).count() == 0
    seasons.drop_layout(spark, star.facts)
