"""Logical tables derived from a star schema of orders.

Entity = customer, period = order year, group = order priority, event = line item. A customer with
several priorities in a year also gets a combined row.

Order of work, chosen so that no hot key ever reaches a join or a window as raw rows:

1. line items are totalled per order (partial totals on the map side), one row per order key;
2. orders join those totals one to one and are totalled per customer, year and priority, so a
   customer with a third of all orders is down to a few dozen rows;
3. only then come the names: customer (and nation) join on the customer key, and rows of one name
   are totalled, again on the map side first, so that a name shared by many customers is no hot key
   either. From here on a player, season and team has one row;
4. one shuffle by ``cluster_by`` brings a player's rows (of a season) together. The combined rows,
   the removal of double-counted rows and any window over those keys reuse that partitioning. What
   meets in one task is bounded by the number of teams (times seasons), not by the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from periodica.layout import STATS
from periodica.operators.keys import possibly_in
from periodica.sources.schemas import STAR
from periodica.sources.staging import staged

_SUMS = ("G", "PTS", "AST", "TRB", "STL", "BLK", "TOV")


class Star:
    """The star tables below one folder, read with declared schemas."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(STAR[name]).parquet(f"{self.folder}/{name}.parquet")

    def orders(self, seasons: tuple[int, int] | None) -> DataFrame:
        """Orders with their year; ``seasons`` is an inclusive range put on the date itself."""
        orders = self.table("orders")
        if seasons is not None:
            first, last = seasons
            orders = orders.filter(
                f"o_orderdate >= timestamp_ntz'{first}-01-01'"
                f" and o_orderdate < timestamp_ntz'{last + 1}-01-01'"
            )
        return orders.selectExpr("*", "year(o_orderdate) as Season")

    def counted_lines(
        self, seasons: tuple[int, int] | None, among: DataFrame | None = None
    ) -> DataFrame:
        """Line items counted: one row per order and quantity, with their number and what totals
        are made of. ``among`` holds the order keys that matter, if not all do. Line items have no
        season of their own here, so those of all seasons are counted."""
        return (
            self._lines(among)
            .groupBy("l_orderkey", "l_quantity")
            .agg(
                F.expr("count(1) as games"),
                F.expr("sum(l_linenumber) as AST"),
                F.expr("count_if(l_returnflag = 'R') as returned"),
                F.expr("count_if(l_returnflag = 'A') as STL"),
                F.expr("count_if(l_linestatus = 'F') as BLK"),
                F.expr("count_if(l_returnflag = 'N') as TOV"),
            )
        )

    def order_totals(
        self, seasons: tuple[int, int] | None, among: DataFrame | None = None
    ) -> DataFrame:
        """Line items totalled, one row per order."""
        return (
            self._lines(among)
            .groupBy("l_orderkey")
            .agg(
                F.expr("count(1) as G"),
                F.expr("sum(l_quantity) as PTS"),
                F.expr("sum(l_linenumber) as AST"),
                F.expr("sum(case when l_returnflag = 'R' then l_quantity else 0 end) as TRB"),
                F.expr("count_if(l_returnflag = 'A') as STL"),
                F.expr("count_if(l_linestatus = 'F') as BLK"),
                F.expr("count_if(l_returnflag = 'N') as TOV"),
            )
        )

    def _lines(self, among: DataFrame | None) -> DataFrame:
        lines = self.table("lineitem")
        return lines if among is None else possibly_in(lines, "l_orderkey", among)

    def player_stats(
        self,
        seasons: tuple[int, int] | None = None,
        cluster_by: Sequence[str] = ("Player", "Season"),
        players: DataFrame | None = None,
    ) -> DataFrame:
        """One row per player, season and team, and a combined row where there are several.

        ``players`` (a column ``Player``) keeps only these, from the line items on: their customers
        and their orders are staged, and a bitmap of the order keys stands before the totals. Staged
        rows are joined by merging, as their files are far smaller than they are.
        """
        orders = self.orders(seasons).selectExpr(
            "o_orderkey as l_orderkey", "o_custkey as c_custkey", "Season", "o_orderpriority as Tm"
        )
        customers, among = self._customers(), None
        if players is not None:
            wanted = players.select(F.col("Player").alias("c_name")).distinct()
            wanted = wanted.hint("merge")
            customers = staged(customers.join(wanted, "c_name", "left_semi"), "customers-of-names")
            wanted = customers.select("c_custkey").hint("merge")
            orders = staged(orders.join(wanted, "c_custkey", "left_semi"), "orders-of-names")
            among = orders.select("l_orderkey")
            customers, orders = customers.hint("merge"), orders.hint("merge")
        per_order = self.order_totals(seasons, among)
        sums = [F.expr(f"sum({c}) as {c}") for c in _SUMS]
        per_customer = (
            per_order.join(orders, "l_orderkey").groupBy("c_custkey", "Season", "Tm").agg(*sums)
        )
        named = per_customer.join(customers, "c_custkey").selectExpr(
            "c_name as Player",
            "Season",
            "Tm",
            "if(c_custkey % 3 = 0, concat(c_mktsegment, '-', n_name), c_mktsegment) as Pos",
            "cast(19 + (c_custkey + Season) % 25 as int) as Age",
            *_SUMS,
        )
        stints = named.groupBy("Player", "Season", "Tm").agg(
            F.expr("max(Pos) as Pos"),
            F.expr("max(Age) as Age"),
            *[F.expr(f"cast(sum({c}) as bigint) as {c}") for c in _SUMS],
        )
        return _with_combined_rows(stints.repartition(*cluster_by))

    def player_boxscores(self, seasons: tuple[int, int] | None = None) -> DataFrame:
        """One row per player and game."""
        return self._games(self.table("lineitem"), seasons).selectExpr(
            "c_name as PLAYER_NAME", "Team", "Season", "l_quantity as PTS"
        )

    def player_boxscores_counted(self, seasons: tuple[int, int] | None = None) -> DataFrame:
        """Games as (player, team, season, points, how many): the same games, already counted per
        order before the join, so that one huge order cannot skew it."""
        per_order = self.counted_lines(seasons).select("l_orderkey", "l_quantity", "games")
        return self._games(per_order, seasons).selectExpr(
            "c_name as PLAYER_NAME", "Team", "Season", "l_quantity as PTS", "games"
        )

    def game_log(self, seasons: tuple[int, int] | None = None) -> DataFrame:
        """Games in their order: player, season, points, and the place as date, order and line.

        Equal line items of an order are counted before the join (``games``)."""
        per_line = (
            self.table("lineitem")
            .groupBy("l_orderkey", "l_linenumber", "l_quantity")
            .agg(F.expr("count(1) as games"))
        )
        orders = self.orders(seasons).selectExpr(
            "o_orderkey as l_orderkey", "o_custkey as c_custkey", "Season", "o_orderdate"
        )
        names = self.table("customer").select("c_custkey", "c_name")
        return per_line.join(orders, "l_orderkey").join(names, "c_custkey").selectExpr(
            "c_name as PLAYER_NAME",
            "Season",
            "o_orderdate as played",
            "l_orderkey as game",
            "l_linenumber as part",
            "l_quantity as PTS",
            "games",
        )

    def player_games(
        self, seasons: tuple[int, int] | None = None, cluster_by: Sequence[str] = ("PLAYER_NAME", "Team")
    ) -> DataFrame:
        """How often a player had which points for a team in a season: one row per player, season,
        team and points, a player's and team's rows together. The line items are read once; totals
        are sums of these rows (``trends.totals``) on the same exchange."""
        counted = self.player_boxscores_counted(seasons)
        rows = counted.groupBy("PLAYER_NAME", "Season", "Team", "PTS").agg(
            F.expr("sum(games) as games")
        )
        return rows.repartition(*cluster_by)

    def _games(self, lines: DataFrame, seasons: tuple[int, int] | None) -> DataFrame:
        orders = self.orders(seasons).selectExpr(
            "o_orderkey as l_orderkey", "o_custkey as c_custkey", "Season", "o_orderpriority as Team"
        )
        return lines.join(orders, "l_orderkey").join(self._customers(), "c_custkey")

    def salaries(self, seasons: tuple[int, int] | None = None) -> DataFrame:
        """Text money per player and season, with exact duplicates for names ending in 7."""
        per_customer = (
            self.orders(seasons)
            .groupBy(F.expr("o_custkey as c_custkey"), "Season")
            .agg(F.expr("max(o_totalprice) as top"))
        )
        per_name = (
            per_customer.join(self.table("customer"), "c_custkey")
            .groupBy(F.expr("c_name as playerName"), F.expr("Season as seasonStartYear"))
            .agg(F.expr("cast(floor(max(top)) as bigint) as amount"))
        )
        return per_name.selectExpr(
            "playerName",
            "seasonStartYear",
            "concat('$', format_number(amount, 0)) as salary",
            "concat('$', format_number(amount * (100 + 3 * (2001 - seasonStartYear)) div 100, 0))"
            " as inflationAdjSalary",
            "explode(if(endswith(playerName, '7'), array(1, 2), array(1))) as copy",
        ).drop("copy")

    def payroll(self) -> DataFrame:
        """Money per team and season, as text."""
        return (
            self.orders(None)
            .groupBy(F.expr("o_orderpriority as team"), F.expr("Season as seasonStartYear"))
            .agg(F.expr("sum(cast(floor(o_totalprice) as bigint)) as amount"))
            .selectExpr(
                "team", "seasonStartYear", "concat('$', format_number(amount, 0)) as payroll"
            )
        )

    def logical(self) -> dict[str, DataFrame]:
        return {
            "player_stats": self.player_stats(),
            "player_boxscores": self.player_boxscores(),
            "salaries": self.salaries(),
            "payroll": self.payroll(),
        }

    def _customers(self) -> DataFrame:
        nation = self.table("nation").selectExpr("n_nationkey as c_nationkey", "n_name")
        return self.table("customer").join(nation, "c_nationkey")


def _with_combined_rows(stints: DataFrame) -> DataFrame:
    """Add one row with the sums of an entity-period's groups, if there are several.

    Each row counts once for its group and once for the whole; one aggregation over rows that are
    already together finishes both kinds, so nothing is read or shuffled a second time.
    """
    doubled = stints.selectExpr("*", "explode(array(false, true)) as combined")
    totals = doubled.groupBy(
        *STATS.key, "combined", F.expr("if(combined, null, Tm) as team")
    ).agg(
        F.expr("count(1) as teams"),
        F.expr("max(Pos) as Pos"),
        F.expr("max(Age) as Age"),
        *[F.expr(f"sum({c}) as {c}") for c in _SUMS],
    )
    return totals.filter("not combined or teams > 1").selectExpr(
        *STATS.key, f"if(combined, '{STATS.combined}', team) as Tm", "Pos", "Age", *_SUMS
    )
