"""Every operator as a query over the star tables of one folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from periodica.functions import (
    amount_label,
    entity_period_label,
    last_word,
    over_flag,
    parse_money,
    primary_token,
    ratio_label,
    signed_label,
)
from periodica.layout import DetailLayout
from periodica.operators import clean, names, ranking, runs, trends, value
from periodica.plans.presets import ORDERS as P
from periodica.sources import load
from periodica.sources.schemas import LOGICAL
from periodica.sources.seasons import season_star
from periodica.sources.staging import staged
from periodica.sources.star import Star

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}

_BY_PLAYER = ("Player",)
_COUNTED = DetailLayout(weight="games")


def _query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _named(name: str) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn

    return register


def _season(first: int, last: int | None = None) -> tuple[int, int]:
    return first, first if last is None else last


# --- cleaning -------------------------------------------------------------------------------


@_query
def dedup_preferred(spark: SparkSession, sf: str) -> DataFrame:
    return clean.clean_stats(Star(spark, sf).player_stats(), method="anti_join")


@_query
def dedup_window(spark: SparkSession, sf: str) -> DataFrame:
    return clean.clean_stats(Star(spark, sf).player_stats(), method="window")


@_query
def parse_money_distinct(spark: SparkSession, sf: str) -> DataFrame:
    return clean.clean_money(Star(spark, sf).salaries(), P.money)


@_query
def composite_score(spark: SparkSession, sf: str) -> DataFrame:
    return value.composite_score(Star(spark, sf).player_stats(), P.any_sample)


@_named("primary_token")
def _primary_token(spark: SparkSession, sf: str) -> DataFrame:
    stats = Star(spark, sf).player_stats()
    return stats.select("Player", "Season", "Tm", "Pos", primary_token("Pos").alias("position"))


# --- rates ----------------------------------------------------------------------------------


@_query
def q01_top_totals(spark: SparkSession, sf: str) -> DataFrame:
    return trends.top_totals(Star(spark, sf).player_stats())


@_query
def q01_labels(spark: SparkSession, sf: str) -> DataFrame:
    top = trends.top_totals(Star(spark, sf).player_stats())
    return top.withColumn("label", entity_period_label("Player", "Season"))


@_query
def q02_dual_threshold(spark: SparkSession, sf: str) -> DataFrame:
    rows = trends.dual_threshold(Star(spark, sf).player_stats(), P.dual_floors, P.half_sample)
    return rows.withColumn("Label", entity_period_label("Player", "Season", "\n"))


@_query
def q02_dual_threshold_raw(spark: SparkSession, sf: str) -> DataFrame:
    rows = trends.dual_threshold(
        Star(spark, sf).player_stats(), P.dual_floors, P.half_sample, round_before=False
    )
    return rows.select("Player", "Season", "Tm", *[_shown(c) for c in P.dual_floors])


@_query
def q03_period_trend(spark: SparkSession, sf: str) -> DataFrame:
    rows = trends.period_trend(Star(spark, sf).player_stats(), P.any_sample)
    return rows.withColumns({c: _shown(c) for c in ("avg_PPG", "avg_GP")})


@_query
def q04_sustained(spark: SparkSession, sf: str) -> DataFrame:
    stats = Star(spark, sf).player_stats(cluster_by=_BY_PLAYER)
    return trends.sustained(stats, P.sustained_rate, P.sustained_periods, P.any_sample)


@_query
def q04_sustained_top(spark: SparkSession, sf: str) -> DataFrame:
    stats = Star(spark, sf).player_stats(cluster_by=_BY_PLAYER)
    return trends.sustained(stats, P.sustained_rate, P.sustained_periods, P.any_sample, limit=20)


def _tiers(spark: SparkSession, sf: str) -> DataFrame:
    stats = Star(spark, sf).player_stats(_season(P.season))
    return trends.tier_distribution(stats, P.tiers, P.lowest_tier, P.season, P.any_sample)


@_query
def q05_tiers(spark: SparkSession, sf: str) -> DataFrame:
    return _tiers(spark, sf)


@_query
def q05_share(spark: SparkSession, sf: str) -> DataFrame:
    return trends.with_share(_tiers(spark, sf), "num_players")


@_query
def q06_top_debut(spark: SparkSession, sf: str) -> DataFrame:
    stats = Star(spark, sf).player_stats(cluster_by=_BY_PLAYER)
    return trends.top_debut(stats, P.small_sample, P.debut_from)


def _profile(spark: SparkSession, sf: str) -> DataFrame:
    stats = Star(spark, sf).player_stats(_season(P.season))
    return trends.percentile_profile(stats, P.season, P.small_sample)


@_query
def q07_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    return _profile(spark, sf)


@_query
def percentile_long(spark: SparkSession, sf: str) -> DataFrame:
    return trends.percentile_series(_profile(spark, sf))


@_query
def q08_topn_per_group(spark: SparkSession, sf: str) -> DataFrame:
    stats = Star(spark, sf).player_stats(_season(P.season))
    return trends.leaders_by_group(stats, P.season, 3, P.any_sample)


@_query
def q09_most_improved(spark: SparkSession, sf: str) -> DataFrame:
    seasons = _season(P.previous_season, P.season)
    stats = Star(spark, sf).player_stats(seasons, _BY_PLAYER)
    rows = trends.period_delta(stats, P.previous_season, P.season, P.small_sample)
    return rows.withColumn("label", signed_label("improvement"))


def _consistency(star: Star) -> DataFrame:
    games = star.player_games(_season(P.season))
    return trends.consistency(
        trends.totals(games, detail_layout=_COUNTED),
        games,
        P.season,
        P.consistency_sample,
        P.consistency_rate,
        detail_layout=_COUNTED,
    )


@_query
def q10_consistency(spark: SparkSession, sf: str) -> DataFrame:
    return _consistency(Star(spark, sf))


@_query
def career(spark: SparkSession, sf: str) -> DataFrame:
    return trends.career_progression(Star(spark, sf).player_stats(), min_units=P.any_sample)


# --- money ----------------------------------------------------------------------------------


def _value(spark: SparkSession, sf: str, rates: Query = value.value_per_cost, **options) -> DataFrame:
    star, season = Star(spark, sf), _season(P.money_season)
    return rates(
        star.player_stats(season),
        star.salaries(season),
        P.money_season,
        P.half_sample,
        money_layout=P.money,
        **options,
    )


def _cost(spark: SparkSession, sf: str, costs: Query = value.cost_per_unit) -> DataFrame:
    star, season = Star(spark, sf), _season(P.money_season)
    return costs(
        star.player_stats(season),
        star.salaries(season),
        P.money_season,
        P.half_sample,
        P.floor_amount,
        money_layout=P.money,
    )


@_query
def q11_value_per_cost(spark: SparkSession, sf: str) -> DataFrame:
    return _value(spark, sf, k=15)


@_query
def q11_value_per_cost_all(spark: SparkSession, sf: str) -> DataFrame:
    return _value(spark, sf, k=None)


@_query
def q12_cost_per_unit(spark: SparkSession, sf: str) -> DataFrame:
    return _cost(spark, sf)


@_query
def label_extremes(spark: SparkSession, sf: str) -> DataFrame:
    costs = _cost(spark, sf, value.ranked_costs)
    return ranking.extremes(
        costs, "cost_per_unit", 10, 5, ["Player", "Tm"], best_is_high=False
    )


@_query
def label_extremes_value(spark: SparkSession, sf: str) -> DataFrame:
    ties = ["Player", "Tm", "salary_millions"]
    rates = _value(spark, sf, value.value_rates)
    return ranking.extremes(rates, "ppg_per_million", 10, 5, ties)


@_query
def q13_share_premium(spark: SparkSession, sf: str) -> DataFrame:
    star, season = Star(spark, sf), _season(P.money_season)
    rows = value.share_premium(
        star.player_stats(season),
        star.salaries(season),
        "Pos",
        P.money_season,
        P.half_sample,
        P.floor_amount,
        money_layout=P.money,
    )
    return rows.withColumn("overpaid", over_flag("position_premium")).withColumn(
        "label", ratio_label("position_premium", "num_players")
    )


def _curve(spark: SparkSession, sf: str) -> DataFrame:
    star = Star(spark, sf)
    return value.peak_index(
        star.player_stats(),
        star.salaries(),
        "Age",
        P.lowest_age,
        P.highest_age,
        P.small_sample,
        P.floor_amount,
        money_layout=P.money,
    )


@_query
def q14_peak_index(spark: SparkSession, sf: str) -> DataFrame:
    return _curve(spark, sf)


@_query
def q14_peaks(spark: SparkSession, sf: str) -> DataFrame:
    return value.peaks(_curve(spark, sf))


def _idle(spark, sf, money_layout, k=None, whole_units=None) -> DataFrame:
    star = Star(spark, sf)
    return value.idle_cost(
        star.player_stats(),
        star.salaries(),
        P.season_length,
        P.high_amount,
        k,
        whole_units,
        money_layout=money_layout,
    )


@_query
def q15_idle_cost(spark: SparkSession, sf: str) -> DataFrame:
    return _idle(spark, sf, P.money)


@_query
def q15_top(spark: SparkSession, sf: str) -> DataFrame:
    return (
        _idle(spark, sf, P.money, k=10)
        .withColumn("label", entity_period_label("Player", "Season", "\n"))
        .withColumn("last_name", last_word("Player"))
        .withColumn("bubble", F.col("salary_wasted_m") * 20)
        .withColumn("text", amount_label("salary_wasted_m", "G", "Games"))
    )


@_query
def q15b_idle_cost(spark: SparkSession, sf: str) -> DataFrame:
    return _idle(spark, sf, P.adjusted_money, whole_units="Games")


@_query
def q15b_top(spark: SparkSession, sf: str) -> DataFrame:
    top = _idle(spark, sf, P.adjusted_money, k=10, whole_units="Games")
    return top.withColumn("text", amount_label("salary_wasted_m", "Games"))


def _availability(spark, sf, money_layout) -> DataFrame:
    star = Star(spark, sf)
    return value.availability_trend(
        star.player_stats(), star.salaries(), P.season_length, money_layout=money_layout
    )


@_query
def q15_avail(spark: SparkSession, sf: str) -> DataFrame:
    return _availability(spark, sf, P.money)


@_query
def q15b_avail(spark: SparkSession, sf: str) -> DataFrame:
    return _availability(spark, sf, P.adjusted_money)


@_query
def availability_by_position_and_age(spark: SparkSession, sf: str) -> DataFrame:
    star = Star(spark, sf)
    return value.availability_by(
        star.player_stats(),
        star.salaries(),
        season_length=P.season_length,
        money_layout=P.money,
    )


@_query
def expected_amount(spark: SparkSession, sf: str) -> DataFrame:
    star = Star(spark, sf)
    return value.expected_amount(
        star.player_stats(),
        star.salaries(),
        P.small_sample,
        P.floor_amount,
        P.significant,
        money_layout=P.money,
    )


# --- runs -----------------------------------------------------------------------------------


@_query
def longest_streak(spark: SparkSession, sf: str) -> DataFrame:
    """Longest and current run of games with so many points, of every player."""
    games = Star(spark, sf).game_log()
    reached = F.col("PTS") >= P.streak_floor
    return runs.longest_runs(games, "PLAYER_NAME", ["played", "game", "part", "PTS"], reached, "games")


# --- names ----------------------------------------------------------------------------------


def _typo(name: str) -> Column:
    """The name without its third character."""
    return F.concat(F.substring(name, 1, 2), F.substring(F.col(name), F.lit(4), F.length(name)))


def _part_names(star: Star) -> DataFrame:
    return names.name_dimension(star.table("part"), "p_name")


@_query
def name_dim(spark: SparkSession, sf: str) -> DataFrame:
    return names.name_dimension(Star(spark, sf).player_stats(), "Player")


@_query
def resolve_exact(spark: SparkSession, sf: str) -> DataFrame:
    star = Star(spark, sf)
    raw = star.table("part").select("p_partkey", F.upper("p_name").alias("raw"))
    return names.resolve(raw, "raw", _part_names(star), method=None)


@_query
def resolve_list(spark: SparkSession, sf: str) -> DataFrame:
    star = Star(spark, sf)
    typed = F.concat(F.lit(" "), F.upper("p_name"), F.lit(" , "), _typo("p_name"))
    lists = star.table("part").select("p_partkey", typed.alias("typed_list"))
    entries = names.split_list(lists, "typed_list")
    return _scored(names.resolve(entries, "raw", _part_names(star), method="edit"))


def _resolve_typos(spark: SparkSession, sf: str, method: str) -> DataFrame:
    star = Star(spark, sf)
    raw = star.table("part").select("p_partkey", _typo("p_name").alias("raw"))
    return _scored(names.resolve(raw, "raw", _part_names(star), method))


@_query
def resolve_fuzzy(spark: SparkSession, sf: str) -> DataFrame:
    return _resolve_typos(spark, sf, "edit")


@_query
def resolve_fuzzy_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return _resolve_typos(spark, sf, "ratio")


def _accented(column: str) -> Column:
    """The name with accents that normalising strips again."""
    return F.translate(column, "aeou", "áèôü")


@_query
def resolve_accented(spark: SparkSession, sf: str) -> DataFrame:
    """Names typed with accents against names known with and without: they collide when
    normalised, and the one that sorts last stands for them."""
    part = Star(spark, sf).table("part")
    spelled = F.when(F.col("p_partkey") % 2 == 0, _accented("p_name")).otherwise(F.col("p_name"))
    known = names.name_dimension(part.select(spelled.alias("name")), "name")
    raw = part.select("p_partkey", F.upper(_accented("p_name")).alias("raw"))
    return names.resolve(raw, "raw", known, method="ratio")


@_query
def resolve_ratio_slip(spark: SparkSession, sf: str) -> DataFrame:
    """One letter too many at the end: all letters of the name match in one block, so SQL can say
    what the similarity is."""
    star = Star(spark, sf)
    raw = star.table("part").select("p_partkey", F.concat("p_name", F.lit("~")).alias("raw"))
    return _scored(names.resolve(raw, "raw", _part_names(star), method="ratio"))


def _customer_slip() -> Column:
    """Customer names as typed: every third exactly, every third with one letter too many at the
    end, the others unknown."""
    key = F.col("c_custkey") % 3
    return (
        F.when(key == 0, F.upper("c_name"))
        .when(key == 1, F.concat("c_name", F.lit("~")))
        .otherwise(F.lit("zzzz"))
    )


@_query
def percentile_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Profiles of names as typed in a separated list, each with how it was resolved.

    A name without a match, or whose match has no profile, stays with its status.
    """
    star = Star(spark, sf)
    typed = F.concat(_customer_slip(), F.lit(" ,  "), F.upper("c_name"))
    lists = star.table("customer").select("c_custkey", typed.alias("typed_list"))
    entries = names.split_list(lists, "typed_list").select("c_custkey", "position", "raw")
    first = [F.desc("pts_percentile"), F.asc("Tm")]
    profile = staged(names.first_rows(_profile(spark, sf), "Player", first), "profiles")
    known = names.name_dimension(star.table("customer"), "c_name")
    found = _scored(names.resolve(entries, "raw", known, method="edit", cutoff=0.9))
    return found.join(profile.hint("merge"), F.col("match") == F.col("Player"), "left")


@_query
def career_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Careers of all customers whose name was typed well enough."""
    star = Star(spark, sf)
    raw = star.table("customer").select(_customer_slip().alias("raw"))
    known = names.name_dimension(star.table("customer"), "c_name")
    found = names.resolve(raw, "raw", known, method="edit", cutoff=0.9).where("match is not null")
    chosen = staged(found.select(F.col("match").alias("Player")).distinct(), "names-chosen")
    return trends.career_progression(star.player_stats(players=chosen))


@_query
def bad_money(spark: SparkSession, sf: str) -> DataFrame:
    """Money text that is no amount, and what leading digits make of all of it."""
    money = Star(spark, sf).salaries()
    broken = F.when(F.col("playerName").endswith("3"), F.concat("salary", F.lit(".50")))
    broken = broken.when(F.col("playerName").endswith("5"), F.lit("n/a")).otherwise(F.col("salary"))
    money = money.withColumn("salary", broken)
    lenient = F.sum(parse_money("salary", lenient=True)).alias("lenient_total")
    return money.agg(*clean.bad_money_counts(P.money), lenient)


def _scored(resolved: DataFrame) -> DataFrame:
    return resolved.withColumn("score", _shown("score"))


def _shown(column: str) -> Column:
    return F.round(F.col(column).cast("decimal(28,10)"), 6).cast("double").alias(column)


# --- facts laid out by season ---------------------------------------------------------------


@_query
def layout_leaders(spark: SparkSession, sf: str) -> DataFrame:
    """The leaders of a season, its line items read from the layout without a shuffle."""
    stats = season_star(spark, sf).player_stats(_season(P.season))
    return trends.leaders_by_group(stats, P.season, 3, P.any_sample)


@_query
def layout_consistency(spark: SparkSession, sf: str) -> DataFrame:
    return _consistency(season_star(spark, sf))


@_query
def layout_career(spark: SparkSession, sf: str) -> DataFrame:
    """All seasons from the layout."""
    return trends.career_progression(season_star(spark, sf).player_stats(), min_units=P.any_sample)


# --- loading --------------------------------------------------------------------------------


@_query
def table_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Profiles of the logical tables as plain SQL reads them, by the names the catalog lists."""
    tables = Star(spark, sf).logical()
    load.register_views({f"logical_{name}": df for name, df in tables.items()})
    listed = [n for n in load.list_tables(spark) if n.startswith("logical_")]
    return load.profile({n.removeprefix("logical_"): spark.sql(f"select * from {n}") for n in listed})


@_query
def load_tables(spark: SparkSession, sf: str) -> DataFrame:
    """The logical tables out to CSV, with an export artifact, and loaded back to Parquet."""
    folder = load.shared_folder(spark)
    files = {}
    for name, df in Star(spark, sf).logical().items():
        files[name] = f"{folder}/csv/{name}"
        exported = df.withColumn("Unnamed: 0", F.monotonically_increasing_id())
        exported.write.option("header", True).csv(files[name])
    loaded = load.load_tables(
        spark, files, f"{folder}/tables", LOGICAL, {"player_stats": "Season"}
    )
    points = F.sum("PTS").cast("bigint")
    totals = {
        "player_stats": points,
        "player_boxscores": points,
        "salaries": F.sum(F.length("salary") + F.length("inflationAdjSalary")),
        "payroll": F.sum(F.length("payroll")),
    }
    checks = [
        df.agg(totals[n].alias("checksum")).withColumn("checked", F.lit(n))
        for n, df in loaded.items()
    ]
    checked = checks[0].unionByName(checks[1]).unionByName(checks[2]).unionByName(checks[3])
    return (
        load.profile(loaded)
        .join(checked, F.col("table_name") == F.col("checked"))
        .drop("checked")
    )
