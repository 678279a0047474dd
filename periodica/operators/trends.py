"""Questions about rates: totals, thresholds, trends, tiers, debuts, changes, consistency."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from periodica.functions import rate, round_half_up, tier
from periodica.layout import DETAIL, STATS, DetailLayout, StatLayout
from periodica.operators.clean import clean_stats
from periodica.operators.ranking import top_k, top_n_per_group, with_positions

#: per-unit rates of a career or percentile profile: name -> column of totals
PROFILE_RATES = {"PPG": "PTS", "APG": "AST", "RPG": "TRB", "SPG": "STL", "BPG": "BLK"}
#: the rates' names in percentile columns
PROFILE_NAMES = {"PPG": "pts", "APG": "ast", "RPG": "reb", "SPG": "stl", "BPG": "blk"}


def _rounded_rates(rates: Mapping[str, str], units: str, digits: int) -> list:
    return [round_half_up(rate(c, units), digits).alias(n) for n, c in rates.items()]


def _with_rate(df: DataFrame, layout: StatLayout, digits: int) -> DataFrame:
    return df.withColumn("PPG", round_half_up(rate(layout.total, layout.units), digits))


def top_totals(stats: DataFrame, k: int = 10, layout: StatLayout = STATS) -> DataFrame:
    """Largest single-period totals; combined and group rows both count."""
    rows = stats.select(*layout.key, layout.group, layout.total)
    return top_k(rows, layout.total, k, [*layout.key, layout.group])


def dual_threshold(
    stats: DataFrame,
    floors: Mapping[str, tuple[str, float]],
    min_units: float = 41,
    k: int | None = 30,
    round_before: bool = True,
    layout: StatLayout = STATS,
) -> DataFrame:
    """Rows that reach every floor at once; ``floors`` maps rate name to (totals, floor).

    With ``round_before`` the rates are compared as displayed, to one decimal.
    """
    rated = stats.filter(F.col(layout.units) >= min_units)
    for name, (column, floor) in floors.items():
        value = rate(column, layout.units)
        value = round_half_up(value, 1) if round_before else value
        rated = rated.withColumn(name, value).filter(F.col(name) >= floor)
    names = list(floors)
    rows = rated.select(*layout.key, layout.group, *names)
    return top_k(rows, names[0], k, [*layout.key, layout.group])


def period_trend(
    stats: DataFrame, min_units: float = 1, layout: StatLayout = STATS, method: str = "window",
) -> DataFrame:
    """Per period: mean rate, how many entities, mean units."""
    rated = _with_rate(clean_stats(stats, layout, method), layout, 2).filter(
        F.col(layout.units) >= min_units
    )
    return (
        rated.groupBy(layout.period)
        .agg(
            F.avg("PPG").alias("avg_PPG"),
            F.count(F.lit(1)).alias("player_count"),
            F.avg(layout.units).alias("avg_GP"),
        )
        .orderBy(layout.period)
    )


def sustained(
    stats: DataFrame,
    min_rate: float = 20,
    min_periods: int = 5,
    min_units: float = 1,
    limit: int | None = None,
    layout: StatLayout = STATS,
    method: str = "window",
) -> DataFrame:
    """Entities at or above a rate in enough periods, and their mean in those."""
    reached = _with_rate(clean_stats(stats, layout, method), layout, 2).filter(
        (F.col(layout.units) >= min_units) & (F.col("PPG") >= min_rate)
    )
    kept = (
        reached.groupBy(layout.entity)
        .agg(
            F.count(layout.period).alias("seasons_above"),
            round_half_up(F.avg("PPG"), 1).alias("avg_ppg_in_those_seasons"),
        )
        .filter(F.col("seasons_above") >= min_periods)
    )
    return top_k(kept, "seasons_above", limit, [layout.entity])


def tier_distribution(
    stats: DataFrame,
    tiers: Sequence[tuple[float, str]],
    otherwise: str,
    period: int,
    min_units: float = 1,
    layout: StatLayout = STATS,
    method: str = "window",
) -> DataFrame:
    """Entities per tier of the unrounded rate, best tier first."""
    one = stats.filter(F.col(layout.period) == period)
    rated = (
        clean_stats(one, layout, method)
        .filter(F.col(layout.units) >= min_units)
        .withColumn("PPG", rate(layout.total, layout.units))
        .withColumn("scoring_tier", tier("PPG", tiers, otherwise))
    )
    return (
        rated.groupBy("scoring_tier")
        .agg(F.count(F.lit(1)).alias("num_players"), F.min("PPG").alias("lowest"))
        .orderBy(F.desc("lowest"))
        .drop("lowest")
    )


def with_share(counted: DataFrame, count: str, name: str = "share_pct") -> DataFrame:
    """Percent of the column's total; the input is one row per group already."""
    total = F.sum(count).over(Window.partitionBy())
    return counted.withColumn(name, round_half_up(F.try_divide(F.col(count) * 100.0, total), 1))


def top_debut(
    stats: DataFrame,
    min_units: float = 20,
    from_period: int = 1953,
    layout: StatLayout = STATS,
    method: str = "window",
) -> DataFrame:
    """Best rate(s) among the entities in their first period, for each period.

    The first period comes from all rows. A debut under ``min_units`` disqualifies, it does not
    move the debut on. Both windows run on one shuffle if the input is partitioned by entity.
    """
    career = Window.partitionBy(layout.entity)
    known = stats.filter(F.col(layout.entity).isNotNull())
    debut = clean_stats(
        known.withColumn("__first", F.min(layout.period).over(career)), layout, method
    ).filter((F.col(layout.period) == F.col("__first")) & (F.col(layout.units) >= min_units))
    rated = (
        _with_rate(debut, layout, 2)
        .filter(F.col(layout.period) >= from_period)
        .select(*layout.key, layout.group, layout.units, "PPG")
    )
    best = top_n_per_group(rated, layout.period, "PPG", 1, "__rank")
    return best.drop("__rank").orderBy(layout.period, layout.entity)


def period_rates(
    stats: DataFrame,
    period: int,
    min_units: float = 20,
    rates: Mapping[str, str] = PROFILE_RATES,
    layout: StatLayout = STATS,
    method: str = "window",
) -> DataFrame:
    """Rates of one period, rounded to one decimal."""
    one = stats.filter(F.col(layout.period) == period)
    return (
        clean_stats(one, layout, method)
        .filter(F.col(layout.units) >= min_units)
        .select(
            layout.entity, layout.group, layout.units, *_rounded_rates(rates, layout.units, 1)
        )
    )


def percentile_profile(
    stats: DataFrame,
    period: int,
    min_units: float = 20,
    rates: Mapping[str, str] = PROFILE_RATES,
    names: Mapping[str, str] = PROFILE_NAMES,
    layout: StatLayout = STATS,
    method: str = "window",
) -> DataFrame:
    """Rates of one period and their percentiles among all rows, over the rounded rates."""
    league = period_rates(stats, period, min_units, rates, layout, method)
    percentiles = {f"{names[n]}_percentile": (n, "percent_rank") for n in rates}
    ranked = with_positions(league, percentiles, digits=1)
    for name in percentiles:
        ranked = ranked.withColumn(name, round_half_up(F.col(name) * 100, 1))
    return ranked.orderBy(F.desc(next(iter(percentiles))), layout.entity, layout.group)


def percentile_series(
    profile: DataFrame, names: Sequence[str] = tuple(PROFILE_NAMES.values()),
    layout: StatLayout = STATS,
) -> DataFrame:
    """Long form of a profile: one row per entity and metric."""
    columns = [F.col(f"{n}_percentile").alias(n.upper()) for n in names]
    return profile.select(layout.entity, layout.group, *columns).unpivot(
        [layout.entity, layout.group], [n.upper() for n in names], "metric", "percentile"
    )


def leaders_by_group(
    stats: DataFrame, period: int, n: int = 3, min_units: float = 1, layout: StatLayout = STATS
) -> DataFrame:
    """The ``n`` highest totals of each group in a period, with the group's own total.

    The group total is a grouped sum joined back, not a window sum, which would bring all rows of
    a group into one task. The ranking sees only what its group limit lets through.
    """
    rows = stats.filter(
        (F.col(layout.period) == period)
        & (F.col(layout.units) >= min_units)
        & (F.col(layout.group) != layout.combined)
    ).select(layout.entity, layout.group, layout.units, layout.total)
    totals = rows.groupBy(F.col(layout.group).alias("__group")).agg(
        F.sum(layout.total).alias("team_total_pts")
    )
    ranked = top_n_per_group(rows, layout.group, layout.total, n, "team_ranking")
    return (
        ranked.join(totals, F.col(layout.group) == F.col("__group"))
        .select(
            layout.group,
            "team_total_pts",
            "team_ranking",
            layout.entity,
            layout.total,
            layout.units,
        )
        .orderBy(F.desc("team_total_pts"), layout.group, "team_ranking", layout.entity)
    )


def period_delta(
    stats: DataFrame,
    before: int,
    after: int,
    min_units: float = 20,
    k: int | None = 15,
    layout: StatLayout = STATS,
    method: str = "window",
) -> DataFrame:
    """Largest rise of the rounded rate between two periods, for entities with both.

    A join of one exchange with itself: both sides read the rows of both periods, and a shift of the
    period in the join condition, not a filter that would be pushed below the exchange, tells which
    rows pair. An entity with many rows in both periods is no more than the join's own pairs.
    """
    if before == after:
        raise ValueError("two different periods are needed")
    earlier, later = f"PPG_{before}", f"PPG_{after}"
    both = stats.filter(F.col(layout.period).isin(before, after))
    rated = (
        clean_stats(both, layout, method)
        .filter(F.col(layout.units) >= min_units)
        .filter(F.col(layout.entity).isNotNull())
        .select(
            layout.entity,
            layout.period,
            layout.group,
            round_half_up(rate(layout.total, layout.units), 1).alias("__rate"),
        )
    )
    # hashing by all columns keeps all of them, and so the exchange is the same, for both uses
    rated = rated.repartition(*rated.columns)

    def key(period: Column) -> Column:
        """One value, so that nothing about the period alone is inferred and pushed down."""
        return F.struct(F.col(layout.entity).alias("entity"), period.alias("period"))

    when = F.col(layout.period)
    first = rated.select(key(when + (after - before)).alias("__first"), F.col("__rate").alias(earlier))
    second = rated.withColumnRenamed("__rate", later).withColumn("__second", key(when + 0))
    pairs = second.join(first, F.col("__second") == F.col("__first"))
    changed = pairs.select(
        layout.entity,
        layout.group,
        earlier,
        later,
        round_half_up(F.col(later) - F.col(earlier), 1).alias("improvement"),
    )
    return top_k(changed, "improvement", k, [layout.entity, layout.group])


def totals(
    detail: DataFrame, layout: StatLayout = STATS, detail_layout: DetailLayout = DETAIL
) -> DataFrame:
    """Units and totals per entity, period and group of counted events, as a stats table.

    Without combined rows, and with no other columns.
    """
    d = detail_layout
    weight = F.col(d.weight) if d.weight else F.lit(1)
    return detail.groupBy(d.entity, d.period, d.group).agg(
        F.sum(weight).alias(layout.units), F.sum(F.col(d.value) * weight).alias(layout.total)
    ).select(
        F.col(d.entity).alias(layout.entity),
        F.col(d.period).alias(layout.period),
        F.col(d.group).alias(layout.group),
        layout.units,
        layout.total,
    )


def consistency(
    stats: DataFrame,
    detail: DataFrame,
    period: int,
    min_units: float = 40,
    min_rate: float = 15,
    k: int | None = 15,
    layout: StatLayout = STATS,
    detail_layout: DetailLayout = DETAIL,
) -> DataFrame:
    """Smallest root-mean-square distance of single events from the rounded period rate.

    The centre is the *rounded* rate of the totals table, so this is no standard deviation. Events
    are first counted per distinct value, which leaves little to join or to shuffle even if one
    entity holds a third of them.
    """
    d = detail_layout
    averages = (
        stats.filter(
            (F.col(layout.period) == period)
            & (F.col(layout.units) >= min_units)
            & (F.col(layout.group) != layout.combined)
        )
        .select(
            F.col(layout.entity).alias("__entity"),
            F.col(layout.group).alias("__group"),
            F.col(layout.units).alias("games_played"),
            round_half_up(rate(layout.total, layout.units), 1).alias("avg_ppg"),
        )
        .filter(F.col("avg_ppg") >= min_rate)
    )
    weight = F.col(d.weight) if d.weight else F.lit(1)
    values = (
        detail.filter(F.col(d.period) == period)
        .groupBy(d.entity, d.group, d.value)
        .agg(F.sum(weight).alias("times"))
    )
    gap = F.col(d.value) - F.col("avg_ppg")
    times = F.when(F.col(d.value).isNotNull(), F.col("times"))
    spread = F.sqrt(F.try_divide(F.sum(times * gap * gap), F.sum(times).cast("double")))
    same = (F.col(d.entity) == F.col("__entity")) & (F.col(d.group) == F.col("__group"))
    scored = (
        values.join(averages, same)
        .groupBy(d.entity, d.group, "games_played", "avg_ppg")
        .agg(round_half_up(spread, 1).alias("std_dev"))
    )
    return top_k(scored, "std_dev", k, [d.entity, d.group], ascending=True)


def career_progression(
    stats: DataFrame,
    names: DataFrame | None = None,
    min_units: float = 1,
    rates: Mapping[str, str] = PROFILE_RATES,
    layout: StatLayout = STATS,
    method: str = "window",
) -> DataFrame:
    """Units and rates of every entity in every period, or only of the given ``names``."""
    if names is not None:
        stats = stats.join(names.select(layout.entity).distinct(), layout.entity, "left_semi")
    return (
        clean_stats(stats, layout, method)
        .filter(F.col(layout.units) >= min_units)
        .select(*layout.key, layout.units, *_rounded_rates(rates, layout.units, 1))
        .orderBy(*layout.key)
    )
