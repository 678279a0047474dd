"""Facts laid out by season: written once, then read without a shuffle of line items.

Orders and line items are partitioned by season and, inside a season, bucketed and sorted by the
order key, in the same number of buckets. A query of some seasons reads their folders only, totals
line items per order where they lie, and joins them with the orders bucket by bucket.

Line items are stored counted: one row per order and quantity, with what has to be summed up. A row
of an order then stands for any number of line items, so an order with a third of them all is a few
dozen rows, and no bucket grows with it. Both totals and games come from these rows.

A season belongs to an order's date, so line items are joined with their orders once, when the
layout is written. Line items without an order and orders without a date are in no season.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from periodica.operators.keys import possibly_in
from periodica.sources.staging import fresh_folder
from periodica.sources.star import Star


class SeasonStar(Star):
    """The star tables with orders and line items read from the layout in ``facts``."""

    def __init__(self, spark: SparkSession, folder: str, facts: dict[str, str]):
        super().__init__(spark, folder)
        self.facts = facts

    def _of_seasons(self, name: str, seasons: tuple[int, int] | None) -> DataFrame:
        rows = self.spark.table(self.facts[name])
        return rows if seasons is None else rows.filter(F.col("Season").between(*seasons))

    def orders(self, seasons: tuple[int, int] | None) -> DataFrame:
        return self._of_seasons("orders", seasons)

    def counted_lines(
        self, seasons: tuple[int, int] | None, among: DataFrame | None = None
    ) -> DataFrame:
        rows = self._of_seasons("lines", seasons).drop("Season")
        return rows if among is None else possibly_in(rows, "l_orderkey", among)

    def order_totals(
        self, seasons: tuple[int, int] | None, among: DataFrame | None = None
    ) -> DataFrame:
        return (
            self.counted_lines(seasons, among)
            .groupBy("l_orderkey")
            .agg(
                F.expr("sum(games) as G"),
                F.expr("sum(l_quantity * games) as PTS"),
                F.expr("sum(AST) as AST"),
                F.expr("sum(l_quantity * returned) as TRB"),
                *[F.expr(f"sum({c}) as {c}") for c in ("STL", "BLK", "TOV")],
            )
        )


def write_layout(
    star: Star, buckets: int | None = None, folder: str | None = None
) -> dict[str, str]:
    """Lay out the facts of ``star`` below ``folder``; names of the tables ``orders`` and ``lines``.

    The names are those of the session's catalog, which knows the buckets. ``buckets`` defaults to
    the number of shuffle partitions, so that each task of the last shuffle writes one bucket.
    """
    spark = star.spark
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = folder or fresh_folder(spark, "seasons")
    orders = star.orders(None).filter("Season is not null and o_orderkey is not null")
    lines = star.counted_lines(None).join(
        orders.selectExpr("o_orderkey as l_orderkey", "Season"), "l_orderkey"
    )
    return {
        "orders": _bucketed(orders, "o_orderkey", buckets, f"{folder}/orders"),
        "lines": _bucketed(lines, "l_orderkey", buckets, f"{folder}/lines"),
    }


def _bucketed(rows: DataFrame, key: str, buckets: int, path: str) -> str:
    name = f"periodica_{uuid.uuid4().hex}"
    (
        rows.repartition(buckets, key)
        .write.partitionBy("Season")
        .bucketBy(buckets, key)
        .sortBy(key)
        .option("path", path)
        .saveAsTable(name)
    )
    return name


def season_star(spark: SparkSession, folder: str, buckets: int | None = None) -> SeasonStar:
    """The star tables below ``folder``, their facts laid out anew."""
    return SeasonStar(spark, folder, write_layout(Star(spark, folder), buckets))


def drop_layout(spark: SparkSession, facts: dict[str, str]) -> None:
    """Take the tables out of the catalog; their files are where ``write_layout`` put them."""
    for name in facts.values():
        spark.sql(f"drop table if exists {name}")

