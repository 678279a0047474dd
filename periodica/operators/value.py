"""Rates against money: value, cost, premiums, curves by age, the price of absence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from periodica.functions import (
    composite,
    positive_lag,
    primary_token,
    rate,
    round_half_up,
)
from periodica.layout import MONEY, STATS, MoneyLayout, StatLayout
from periodica.operators.clean import clean_money, clean_stats
from periodica.operators.fit import least_squares, predicted
from periodica.operators.ranking import (
    percent_rank_floor,
    sums_from_percent_rank,
    top_k,
    with_positions,
)

#: terms of the production score
SCORE_PLUS = ("PTS", "TRB", "AST", "STL", "BLK")
SCORE_MINUS = ("TOV",)


def production(layout: StatLayout = STATS) -> Column:
    """Composite score per unit, unrounded."""
    return composite(SCORE_PLUS, SCORE_MINUS, layout.units)


def composite_score(
    stats: DataFrame,
    min_units: float = 1,
    digits: int = 2,
    layout: StatLayout = STATS,
    method: str = "window",
) -> DataFrame:
    """The production score of every entity and period."""
    return (
        clean_stats(stats, layout, method)
        .filter(F.col(layout.units) >= min_units)
        .select(
            *layout.key,
            layout.group,
            layout.units,
            round_half_up(production(layout), digits).alias("prod_per_game"),
        )
    )


def _paid(
    stats: DataFrame,
    money: DataFrame,
    min_units: float | None,
    min_amount: float | None,
    period: int | None,
    layout: StatLayout,
    money_layout: MoneyLayout,
    lenient: bool,
    method: str,
) -> DataFrame:
    """Deduplicated rows next to their money, joined on entity and period.

    Filters on the join keys, units and amount come first, so both sides are as small as can be
    when they are shuffled.
    """
    if period is not None:
        stats = stats.filter(F.col(layout.period) == period)
    rows = clean_stats(stats, layout, method)
    if min_units is not None:
        rows = rows.filter(F.col(layout.units) >= min_units)
    amounts = clean_money(money, money_layout, period, lenient)
    if min_amount is not None:
        amounts = amounts.filter(F.col("salary_int") > min_amount)
    same = (F.col(layout.entity) == F.col(money_layout.entity)) & (
        F.col(layout.period) == F.col(money_layout.period)
    )
    return rows.join(amounts, same).withColumn("__money", _units_of_money(money_layout))


def _units_of_money(layout: MoneyLayout) -> Column:
    return F.col("salary_int") / F.lit(layout.unit)


def value_per_cost(
    stats: DataFrame,
    money: DataFrame,
    period: int = 2021,
    min_units: float = 41,
    k: int | None = 15,
    layout: StatLayout = STATS,
    money_layout: MoneyLayout = MONEY,
    lenient: bool = False,
    method: str = "window",
) -> DataFrame:
    """Rate per unit of money, of unrounded values: the best ``k``, or all, sorted."""
    rows = value_rates(stats, money, period, min_units, layout, money_layout, lenient, method)
    return top_k(rows, "ppg_per_million", k, [layout.entity, layout.group, "salary_millions"])


def value_rates(
    stats: DataFrame,
    money: DataFrame,
    period: int = 2021,
    min_units: float = 41,
    layout: StatLayout = STATS,
    money_layout: MoneyLayout = MONEY,
    lenient: bool = False,
    method: str = "window",
) -> DataFrame:
    """Rate per unit of money, in no order."""
    paid = _paid(stats, money, min_units, None, period, layout, money_layout, lenient, method)
    per_unit = rate(layout.total, layout.units)
    return paid.select(
        layout.entity,
        layout.group,
        layout.units,
        round_half_up(per_unit, 1).alias("PPG"),
        round_half_up("__money", 2).alias("salary_millions"),
        round_half_up(F.try_divide(per_unit, F.col("__money")), 2).alias("ppg_per_million"),
    )


def unit_costs(
    stats: DataFrame,
    money: DataFrame,
    period: int = 2021,
    min_units: float = 41,
    min_amount: float = 1_000_000,
    layout: StatLayout = STATS,
    money_layout: MoneyLayout = MONEY,
    lenient: bool = False,
    method: str = "window",
) -> DataFrame:
    """Money per rounded production score."""
    paid = _paid(
        stats, money, min_units, min_amount, period, layout, money_layout, lenient, method
    )
    return (
        paid.withColumn("prod_per_game", round_half_up(production(layout), 2))
        .filter(F.col("prod_per_game") > 0)
        .select(
            layout.entity,
            layout.group,
            layout.units,
            "prod_per_game",
            round_half_up("__money", 2).alias("salary_millions"),
            round_half_up(F.col("__money") / F.col("prod_per_game"), 2).alias("cost_per_unit"),
        )
    )


def cost_per_unit(
    stats: DataFrame,
    money: DataFrame,
    period: int = 2021,
    min_units: float = 41,
    min_amount: float = 1_000_000,
    layout: StatLayout = STATS,
    money_layout: MoneyLayout = MONEY,
    lenient: bool = False,
    method: str = "window",
) -> DataFrame:
    """Money per rounded production score, ranked from both ends, sorted."""
    ranked = ranked_costs(
        stats, money, period, min_units, min_amount, layout, money_layout, lenient, method
    )
    return ranked.orderBy("cost_per_unit", layout.entity, layout.group)


def ranked_costs(
    stats: DataFrame,
    money: DataFrame,
    period: int = 2021,
    min_units: float = 41,
    min_amount: float = 1_000_000,
    layout: StatLayout = STATS,
    money_layout: MoneyLayout = MONEY,
    lenient: bool = False,
    method: str = "window",
) -> DataFrame:
    """The same in no order."""
    priced = unit_costs(
        stats, money, period, min_units, min_amount, layout, money_layout, lenient, method
    )
    return with_positions(
        priced,
        {
            "underpaid_rank": ("cost_per_unit", "rank"),
            "overpaid_rank": ("cost_per_unit", "desc_rank"),
        },
        digits=2,
    )


def share_premium(
    stats: DataFrame,
    money: DataFrame,
    label: str = "Pos",
    period: int = 2021,
    min_units: float = 41,
    min_amount: float = 1_000_000,
    layout: StatLayout = STATS,
    money_layout: MoneyLayout = MONEY,
    lenient: bool = False,
    method: str = "window",
) -> DataFrame:
    """Per primary label: its share of mean money over its share of mean production.

    The totals run over one row per label.
    """
    paid = _paid(stats, money, min_units, min_amount, period, layout, money_layout, lenient, method)
    means = (
        paid.withColumn("__prod", production(layout))
        .filter(F.col("__prod") > 0)
        .groupBy(primary_token(label).alias("position"))
        .agg(
            F.count(F.lit(1)).alias("num_players"),
            F.avg("__prod").alias("mean_prod"),
            F.avg("__money").alias("mean_money"),
        )
    )
    everything = Window.partitionBy()
    money_share = F.col("mean_money") / F.sum("mean_money").over(everything)
    prod_share = F.col("mean_prod") / F.sum("mean_prod").over(everything)
    return means.select(
        "position",
        "num_players",
        round_half_up("mean_prod", 2).alias("avg_prod"),
        round_half_up("mean_money", 2).alias("avg_salary_millions"),
        round_half_up(F.try_divide(money_share, prod_share), 2).alias("position_premium"),
    ).orderBy(F.desc("position_premium"), "position")


def peak_index(
    stats: DataFrame,
    money: DataFrame,
    by: str = "Age",
    lowest: int = 19,
    highest: int = 38,
    min_units: float = 20,
    min_amount: float = 1_000_000,
    layout: StatLayout = STATS,
    money_layout: MoneyLayout = MONEY,
    lenient: bool = False,
    method: str = "window",
) -> DataFrame:
    """Mean production and money by age, each also as percent of its own peak.

    The age range applies before the peak is taken; the peak runs over one row per age.
    """
    paid = _paid(stats, money, min_units, min_amount, None, layout, money_layout, lenient, method)
    means = (
        paid.withColumn("__prod", production(layout))
        .filter((F.col("__prod") > 0) & F.col(by).between(lowest, highest))
        .groupBy(by)
        .agg(
            F.count(F.lit(1)).alias("num_players"),
            F.avg("__prod").alias("mean_prod"),
            F.avg("__money").alias("mean_money"),
        )
    )
    everything = Window.partitionBy()

    def index(column: str) -> Column:
        return round_half_up(F.try_divide(F.col(column), F.max(column).over(everything)) * 100, 1)

    return means.select(
        by,
        "num_players",
        round_half_up("mean_prod", 2).alias("avg_prod"),
        round_half_up("mean_money", 2).alias("avg_salary_millions"),
        index("mean_prod").alias("prod_index"),
        index("mean_money").alias("salary_index"),
    ).orderBy(by)


def peaks(curve: DataFrame, by: str = "Age") -> DataFrame:
    """Where each index peaks (the lowest age on ties) and how far money trails production."""

    def first_peak(index: str) -> Column:
        return (-F.max(F.struct(F.col(index), (-F.col(by)).alias("n")))["n"]).cast("int")

    found = curve.agg(
        first_peak("prod_index").alias("peak_prod_age"),
        first_peak("salary_index").alias("peak_salary_age"),
    )
    lag = positive_lag(F.col("peak_salary_age"), F.col("peak_prod_age"))
    return found.withColumn("salary_lag", lag)


def idle_cost(
    stats: DataFrame,
    money: DataFrame,
    season_length: int = 82,
    min_amount: float = 5_000_000,
    k: int | None = None,
    whole_units: str | None = None,
    layout: StatLayout = STATS,
    money_layout: MoneyLayout = MONEY,
    lenient: bool = False,
    method: str = "window",
) -> DataFrame:
    """Money paid for units missed: amount x (1 - units / season length).

    ``whole_units`` names an integer units column to give instead of the units rounded to one
    decimal.
    """
    short = F.col(layout.units) < season_length
    paid = _paid(stats, money, None, min_amount, None, layout, money_layout, lenient, method).filter(short)
    units = F.col(layout.units).cast("double")
    shown = (
        F.col(layout.units).cast("int").alias(whole_units)
        if whole_units
        else round_half_up(layout.units, 1).alias(layout.units)
    )
    missed = F.lit(1.0) - units / F.lit(float(season_length))
    rows = paid.select(
        *layout.key,
        shown,
        round_half_up(units / F.lit(float(season_length)), 3).alias("availability_rate"),
        round_half_up("__money", 2).alias("salary_millions"),
        round_half_up(F.try_divide(F.col("__money"), units), 3).alias("cost_per_game_m"),
        round_half_up(F.col("__money") * missed, 2).alias("salary_wasted_m"),
    )
    return top_k(rows, "salary_wasted_m", k, [*layout.key, "salary_millions"])


def _well_paid(
    stats: DataFrame,
    money: DataFrame,
    season_length: int,
    floor: float,
    layout: StatLayout,
    money_layout: MoneyLayout,
    lenient: bool,
    method: str,
    *others: str,
) -> tuple[DataFrame, Column]:
    """Amounts next to ``__share``, the part of the season played, and ``others`` of the stats; and
    the condition that a row was both played and among the better paid of its period.

    "Better paid" is a percent rank inside the period. It is found from value counts and applied
    as one cut per period, so no period's rows have to be sorted in one task. The amounts are
    shuffled by entity and period once, for the counts and for the join: outer joins and conditions
    inside the aggregation leave both uses without a filter of their own, and every amount counts
    for the ranks, also one without an entity.
    """
    amounts = clean_money(money, money_layout, lenient=lenient)
    amounts = amounts.repartition(money_layout.entity, money_layout.period)
    cuts = percent_rank_floor(amounts, "salary_int", money_layout.period, floor).select(
        F.struct(F.col(money_layout.period).alias("period")).alias("__period"), "cut"
    )
    played = clean_stats(stats.dropna(subset=layout.key), layout, method).select(
        *layout.key,
        (F.col(layout.units).cast("double") / float(season_length)).alias("__share"),
        *others,
    )
    same = (F.col(layout.entity) == F.col(money_layout.entity)) & (
        F.col(layout.period) == F.col(money_layout.period)
    )
    # a struct is never NULL, so this join adds no filter of its own to the counts' side either
    in_period = F.struct(F.col(money_layout.period).alias("period")) == F.col("__period")
    paid = amounts.join(played, same, "left").join(cuts, in_period, "left")
    return paid, F.col(layout.period).isNotNull() & (F.col("salary_int") >= F.col("cut"))


def availability_trend(
    stats: DataFrame,
    money: DataFrame,
    season_length: int = 82,
    floor: float = 0.5,
    layout: StatLayout = STATS,
    money_layout: MoneyLayout = MONEY,
    lenient: bool = False,
    method: str = "window",
) -> DataFrame:
    """Per period: how many of the better paid there are and their mean availability.

    "Better paid" is a percent rank among all amounts of the period. The stats of an entity and
    period are summed up where they are, next to each of its amounts, and those per distinct amount
    with the number of rows that its rank is counted from. So every table is read once, and no row
    meets a cut: the join's rows give the ranks and the sums alike.
    """
    amounts = clean_money(money, money_layout, lenient=lenient)
    share = F.col(layout.units).cast("double") / float(season_length)
    played = (
        clean_stats(stats.dropna(subset=layout.key), layout, method)
        .groupBy(*layout.key)
        .agg(
            F.count(F.lit(1)).alias("__rows"),
            F.count(share).alias("__known"),
            F.sum(share).alias("__share"),
        )
    )
    same = (F.col(layout.entity) == F.col(money_layout.entity)) & (
        F.col(layout.period) == F.col(money_layout.period)
    )
    paid = amounts.join(played, same, "left").withColumn("__when", F.col(money_layout.period))
    sums = {"num_players": "coalesce(__rows, 0L)", "known": "coalesce(__known, 0L)", "share": "__share"}
    found = sums_from_percent_rank(paid, "salary_int", "__when", floor, sums, "1L")
    return (
        found.filter(F.col("num_players") > 0)
        .select(
            F.col("__when").alias(layout.period),
            "num_players",
            round_half_up(F.try_divide("share", "known"), 3).alias("avg_availability"),
        )
        .orderBy(layout.period)
    )


def availability_by(
    stats: DataFrame,
    money: DataFrame,
    label: str = "Pos",
    age: str = "Age",
    years: int = 5,
    season_length: int = 82,
    floor: float = 0.5,
    layout: StatLayout = STATS,
    money_layout: MoneyLayout = MONEY,
    lenient: bool = False,
    method: str = "window",
) -> DataFrame:
    """Availability of the better paid by position and group of ``years`` of age, by either alone,
    and of all: one aggregation over grouping sets, so one exchange of partial results.

    ``grouped_by`` tells which of them a row is, as a NULL may also be a missing position or age.
    """
    paid, counted = _well_paid(
        stats, money, season_length, floor, layout, money_layout, lenient, method, label, age
    )
    position, age_from = F.col("position"), F.col("age_from")
    rows = paid.select(
        primary_token(label).alias("position"),
        (F.floor(F.col(age) / years) * years).cast("int").alias("age_from"),
        F.when(counted, F.col("__share")).alias("__share"),
        counted.alias("__counted"),
    )
    sets = [[position, age_from], [position], [age_from], []]
    by = (
        F.when((F.grouping("position") == 0) & (F.grouping("age_from") == 0), "position and age")
        .when(F.grouping("position") == 0, "position")
        .when(F.grouping("age_from") == 0, "age")
        .otherwise("all")
    )
    grouped = rows.groupingSets(sets, position, age_from).agg(
        by.alias("grouped_by"),
        F.count_if(F.col("__counted")).alias("num_players"),
        round_half_up(F.avg("__share"), 3).alias("avg_availability"),
    )
    # rows that don't count have groups, too
    return grouped.where("num_players > 0").orderBy("grouped_by", "position", "age_from")


def expected_amount(
    stats: DataFrame,
    money: DataFrame,
    min_units: float = 20,
    min_amount: float = 1_000_000,
    significant: float = 2.0,
    age: str = "Age",
    layout: StatLayout = STATS,
    money_layout: MoneyLayout = MONEY,
    lenient: bool = False,
    method: str = "window",
) -> DataFrame:
    """What production and age let expect as the amount of a period, and who is priced off it.

    Each period has a least squares fit of the amount (in the layout's unit) on the production score
    and age. ``off_by`` is the residual in standard deviations of the period's residuals, ``priced``
    is ``above`` or ``below`` from ``significant`` of them on, else ``as expected``. All are NULL
    where the period has too few rows for a fit, or a row lacks score or age.

    The rows are shuffled once, by all their columns, so that the sums and the comparison read the
    same exchange and a period with most of the rows is spread.
    """
    paid = _paid(
        stats, money, min_units, min_amount, None, layout, money_layout, lenient, method
    ).select(
        *layout.key,
        layout.group,
        F.col(age).alias("age"),
        round_half_up(production(layout), 2).alias("prod_per_game"),
        round_half_up("__money", 2).alias("salary_millions"),
    )
    rows = paid.repartition(*paid.columns)
    predictors = ["prod_per_game", "age"]
    model = least_squares(rows, "salary_millions", predictors, layout.period)
    model = model.withColumnRenamed(layout.period, "__period")
    residual = F.col("salary_millions") - predicted(predictors)
    off_by = round_half_up(F.try_divide(residual, F.col("spread")), 2)
    return (
        rows.join(model, F.col(layout.period) == F.col("__period"), "left")
        .select(
            *paid.columns,
            round_half_up(predicted(predictors), 2).alias("expected_millions"),
            round_half_up(residual, 2).alias("residual_millions"),
            off_by.alias("off_by"),
        )
        .withColumn(
            "priced",
            F.when(F.col("off_by") >= significant, "above")
            .when(F.col("off_by") <= -significant, "below")
            .when(F.col("off_by").isNotNull(), "as expected"),
        )
    )
