"""Removing double-counted rows and turning money text into numbers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from periodica.functions import parse_money
from periodica.layout import MONEY, STATS, MoneyLayout, StatLayout
from periodica.operators.keys import free_names


def prefer_rows(
    df: DataFrame, keys: Sequence[str], preferred: Column, method: str = "window"
) -> DataFrame:
    """Per key keep only the preferred rows where there are any, else every row.

    Rows are picked, never summed, so two preferred rows of one key both stay. A row with a NULL
    key matches nothing and is always kept.

    ``window``    one pass and one shuffle on ``keys``, none if the input is already partitioned
                  on them. A key's rows meet in one task, so it is meant for a table whose grain
                  bounds them (one row per entity, period and group). Rows with a NULL key, which
                  no grain bounds, are spread over windows of their own.
    ``anti_join`` the keys that have a preferred row, counted on the map side first, against the
                  rows. Works for any number of rows per key: the key side shrinks before it is
                  shuffled and an oversized partition of the rows can be split. Both sides read one
                  exchange of the rows: no condition on a column stands below it.
    """
    preferred = F.coalesce(preferred, F.lit(False))
    null_key = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    at, keep = free_names(df, "at", "keep")
    if method == "window":
        spread = F.when(null_key, F.xxhash64(*df.columns)).otherwise(F.lit(0))
        rows = df.withColumn(at, spread)
        has_preferred = F.max(preferred).over(Window.partitionBy(*keys, at))
        marked = rows.withColumn(keep, preferred | ~has_preferred | null_key)
        return marked.filter(F.col(keep)).drop(at, keep)
    if method == "anti_join":
        rows = df.repartition(*df.columns)
        key = [F.col(k) for k in keys]
        covered = (
            rows.groupBy(F.struct(*key, F.lit(0).cast("bigint").alias("apart")).alias(at))
            .agg(F.max(preferred & ~null_key).alias(keep))
            .where(F.col(keep))
        )
        spread = F.when(null_key, F.xxhash64(*df.columns)).otherwise(F.lit(0).cast("bigint"))
        found = rows.join(covered, F.struct(*key, spread.alias("apart")) == F.col(at), "left")
        return found.where(preferred | F.col(keep).isNull()).drop(at, keep)
    raise ValueError(f"unknown method: {method}")


def clean_stats(
    stats: DataFrame, layout: StatLayout = STATS, method: str = "window"
) -> DataFrame:
    """One source of truth per entity and period: the combined row if present."""
    combined = F.col(layout.group) == layout.combined
    return prefer_rows(stats, layout.key, combined, method)


def clean_money(
    money: DataFrame,
    layout: MoneyLayout = MONEY,
    period: int | None = None,
    lenient: bool = False,
) -> DataFrame:
    """Typed amounts without exact duplicates, as columns entity, period, ``salary_int``.

    Duplicates go after the parse, so ``$1,000`` and ``$1000`` merge. Two different amounts for
    one entity and period both stay.
    """
    if period is not None:
        money = money.filter(F.col(layout.period) == period)
    typed = money.select(
        layout.entity, layout.period, parse_money(layout.amount, lenient).alias("salary_int")
    )
    return typed.distinct()


def bad_money_counts(layout: MoneyLayout = MONEY) -> list[Column]:
    """Aggregates: ``rows``, and ``bad_rows`` that hold text that is no amount."""
    bad = parse_money(layout.amount).isNull()
    return [F.count(F.lit(1)).alias("rows"), F.count_if(bad).alias("bad_rows")]


def count_bad_money(money: DataFrame, layout: MoneyLayout = MONEY) -> DataFrame:
    """How many rows hold text that is no amount, next to the number of rows."""
    return money.agg(*bad_money_counts(layout))
