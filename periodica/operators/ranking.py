"""Top-k, top-n per group, and ranks over whole columns without a one-task window.

A rank over an unpartitioned window sends every row to one task. Here equal rows are first counted
together, then the rows per distinct value (both combined on the map side, so a value held by a
third of the rows costs one counter per task), and only those counts are put in order, in two
levels:

* values become whole numbers of their smallest steps, and 2^22 steps are a bucket;
* a running count inside each bucket sees at most 2^22 distinct values;
* a running total over the buckets gives each its offset; up to 2^44 steps between the smallest
  and the largest value that is again at most 2^22 rows. Beyond that range the answers stay right,
  and this window grows by a row per bucket that has rows.

``rows below = bucket offset + running count`` then answers rank, descending rank and percent rank
alike, and joins back on the value: all columns at once, in long form, so that several columns cost
one join. No side is forced to be broadcast: the runtime size decides.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from periodica.operators.keys import free_names

BUCKET_STEPS = 1 << 22
#: places of NULLs, infinities and NaN; all other values lie between
_NULL, _LOW, _HIGH, _NAN = (f"cast({x} as decimal(38,0))" for x in ("-1e37", "-9e36", "9e36", "1e37"))


def top_k(df: DataFrame, by: str, k: int | None, ties: Sequence[str], ascending=False) -> DataFrame:
    """First ``k`` rows by ``by`` (all rows, sorted, if ``k`` is None); NULLs come last
    descending and first ascending. ``ties`` makes the cut repeatable."""
    order = F.asc_nulls_first(by) if ascending else F.desc_nulls_last(by)
    ranked = df.orderBy(order, *ties)
    return ranked if k is None else ranked.limit(k)


def top_n_per_group(
    df: DataFrame, group: str, by: str, n: int, rank_name: str = "rank"
) -> DataFrame:
    """Rows ranked ``n`` or better inside their group, ties included.

    The rank filter becomes a group limit before the shuffle, so a hot group sends only its best
    rows from each task.
    """
    ranking = Window.partitionBy(group).orderBy(F.desc_nulls_last(by))
    return df.withColumn(rank_name, F.rank().over(ranking)).filter(F.col(rank_name) <= n)


def extremes(
    df: DataFrame, by: str, best: int, worst: int, ties: Sequence[str], best_is_high: bool = True
) -> DataFrame:
    """The ``best`` first and ``worst`` last rows together, each once.

    Both ends are cut in one pass over the rows: a row stands once for either end, and the rank
    inside an end becomes a group limit before the shuffle, so each task sends a few rows. NULLs are
    in no end but, if high is best and there are too few others, at the end of the best.
    """
    end, row = F.col("__end"), "__row.`{}`".format
    ends = df.select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row"),
        F.explode(F.array(F.lit("best"), F.lit("worst"))).alias("__end"),
    )
    falling = end == ("best" if best_is_high else "worst")
    order = [
        F.desc_nulls_last(F.when(falling, F.col(row(by)))),
        F.asc_nulls_last(F.when(~falling, F.col(row(by)))),
        *[row(tie) for tie in ties],
    ]
    place = F.row_number().over(Window.partitionBy("__end").orderBy(*order))
    there = F.col(row(by)).isNotNull()
    if best_is_high:
        there = there | (end == "best")
    return (
        ends.withColumn("__place", place)
        .where(F.col("__place") <= max(best, worst))
        .where(F.col("__place") <= F.when(end == "best", best).otherwise(worst))
        .where(there)
        .select("__row.*")
        .distinct()
    )


def _steps(df: DataFrame, column: str, digits: int) -> str:
    """The value as a whole number of its smallest steps, as a decimal of up to 36 digits.

    A value that has more than ``digits`` decimals ends the query: ranks must not merge values.
    """
    grid = f"cast(`{column}` as decimal(38,{digits}))"
    steps = f"cast({grid} * {10**digits} as decimal(38,0))"
    kind = df.schema[column].dataType
    fault = f"raise_error('{column} has a value with more than {digits} decimals')"
    if not isinstance(kind, T.FractionalType) or isinstance(kind, T.DecimalType):
        fits = f"{grid} = `{column}`"
        return f"case when `{column}` is null then {_NULL} when {fits} then {steps} else {fault} end"
    value = f"cast(`{column}` as double)"
    return (
        f"case when `{column}` is null then {_NULL} when isnan({value}) then {_NAN}"
        f" when {value} = double('-Infinity') then {_LOW}"
        f" when {value} = double('Infinity') then {_HIGH}"
        f" when cast({grid} as double) = {value} then {steps} else {fault} end"
    )


def _long_form(df: DataFrame, columns: Sequence[str], digits: int, *others: str) -> DataFrame:
    """``others`` and, per column, its name as ``metric`` and its value as ``step``."""
    steps = ", ".join(f"'{c}', {_steps(df, c, digits)}" for c in columns)
    return df.selectExpr(*others, f"stack({len(columns)}, {steps}) as (metric, step)")


def value_positions(
    long: DataFrame, times: str = "1", within: Sequence[str] = (), **amounts: str
) -> DataFrame:
    """Per (``within``, metric, step): rows with it, rows below it, rows in all.

    ``times`` says how many rows a row of ``long`` stands for. NULLs sort below everything.
    ``amounts`` are expressions to be summed up next to the rows, under their names.
    """
    sums = {"same": times, **amounts}
    part = ", ".join([*within, "metric"])
    counts = (
        long.groupBy(*within, "metric", "step")
        .agg(*[F.expr(f"sum({amount}) as {name}") for name, amount in sums.items()])
        .selectExpr(
            f"struct({part}, floor(step / {BUCKET_STEPS}) as bucket) as in_bucket", "step", *sums
        )
    )
    so_far = "rows between unbounded preceding and 1 preceding"
    all_rows = "rows between unbounded preceding and unbounded following"
    in_bucket = "over (partition by in_bucket order by step"
    inside = counts.selectExpr(
        "*",
        f"coalesce(sum(same) {in_bucket} {so_far}), 0) as inside",
        f"sum(same) {in_bucket} {all_rows}) as held",
        f"max(step) {in_bucket} {all_rows}) = step as last",
    )
    place = ", ".join(f"in_bucket.{c} as {c}" for c in [*within, "metric"])
    over_buckets = "over (partition by whole order by bucket"
    totals = inside.filter("last").selectExpr(
        "in_bucket as whole_bucket", f"struct({place}) as whole", "in_bucket.bucket", "held"
    )
    offsets = totals.selectExpr(
        "whole_bucket",
        f"coalesce(sum(held) {over_buckets} {so_far}), 0) as offset",
        f"sum(held) {over_buckets} {all_rows}) as in_all",
    )
    return inside.join(offsets, F.expr("in_bucket = whole_bucket")).selectExpr(
        f"struct({place}, step) as at", *sums, "inside + offset as below", "in_all"
    )


def _percent_rank(place: str) -> str:
    return f"case when {place}in_all = 1 then 0.0D else {place}below / ({place}in_all - 1) end"


def _measure(measure: str, place: str) -> str:
    if measure == "rank":
        return f"{place}below + 1"
    if measure == "desc_rank":
        return f"{place}in_all - {place}below - {place}same + 1"
    if measure == "percent_rank":
        return _percent_rank(place)
    raise ValueError(f"unknown measure: {measure}")


def with_positions(
    df: DataFrame,
    outputs: Mapping[str, tuple[str, str]],
    digits: int,
    within: Sequence[str] = (),
) -> DataFrame:
    """Add rank columns over the whole frame, or per ``within``.

    ``outputs`` maps a new column to (column, measure), with measure ``rank``, ``desc_rank`` or
    ``percent_rank``. ``digits`` is the number of decimals the columns are known to have, values
    with more end the query. The rows are shuffled once, as distinct rows with their number, and
    both the counting and the lookup start from there.
    """
    columns = list(dict.fromkeys(column for column, _ in outputs.values()))
    names = [f"`{c}`" for c in df.columns]
    times, whole, places, copy = free_names(df, "times", "row", "place", "copy")
    rows = df.groupBy(*names).agg(F.count(F.lit(1)).alias(times))
    counted = _long_form(rows, columns, digits, *within, times)
    positions = value_positions(counted, times, within)
    rows = _long_form(rows, columns, digits, f"struct({', '.join(names)}) as {whole}", times)
    at = ", ".join([*[f"{whole}.`{w}` as {w}" for w in within], "metric", "step"])
    found = rows.join(positions, F.expr(f"struct({at}) = at"))
    if len(columns) > 1:
        of_column = [
            F.expr(f"max(if(metric = '{c}', struct(same, below, in_all), null)) as {places}{i}")
            for i, c in enumerate(columns)
        ]
        found = found.groupBy(whole, times).agg(*of_column)
    else:
        found = found.selectExpr(whole, times, f"struct(same, below, in_all) as {places}0")
    measured = [
        f"{_measure(measure, f'{places}{columns.index(column)}.')} as {name}"
        for name, (column, measure) in outputs.items()
    ]
    copies = f"explode(sequence(1L, {times})) as {copy}"
    found = found.selectExpr(*[f"{whole}.{c} as {c}" for c in names], *measured, copies)
    return found.drop(copy)


def sums_from_percent_rank(
    df: DataFrame, value: str, within: str, floor: float, sums: Mapping[str, str], times: str
) -> DataFrame:
    """Per ``within`` the ``sums`` (names and expressions) over rows whose percent rank by the whole
    number ``value`` reaches ``floor``; a row of ``df`` stands for ``times`` rows.

    The amounts are summed per distinct value first, next to the counts that tell its rank, so the
    rows themselves are never joined with a cut. NULL values rank lowest and are not summed up.
    """
    columns = [f"{expr} as {name}" for name, expr in sums.items()]
    long = _long_form(df, [value], 0, within, f"{times} as times", *columns)
    positions = value_positions(long, "times", [within], **{name: name for name in sums})
    return (
        positions.where(f"{_percent_rank('')} >= {floor} and at.step > {_NULL}")
        .groupBy(F.expr(f"at.{within} as {within}"))
        .agg(*[F.sum(name).alias(name) for name in sums])
    )


def percent_rank_floor(
    df: DataFrame, value: str, within: str, floor: float, digits: int = 0
) -> DataFrame:
    """Smallest value per ``within`` whose percent rank reaches ``floor``, as a decimal.

    Percent rank grows with the value, so keeping the rows at or above this cut equals filtering
    on the rank, without attaching it to every row. One row per ``within``.
    """
    positions = value_positions(_long_form(df, [value], digits, within), within=[within])
    return (
        positions.filter(f"{_percent_rank('')} >= {floor} and at.step > {_NULL}")
        .groupBy(F.expr(f"at.{within} as {within}"))
        .agg(F.expr(f"cast(min(at.step) / {10**digits} as decimal(38,{digits})) as cut"))
    )
