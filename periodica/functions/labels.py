"""Display columns: what a chart or a report prints next to a number."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def entity_period_label(entity: str, period: str, sep: str = " ") -> Column:
    """``Name (2021)``; ``sep="\\n"`` puts the period on its own line."""
    return F.concat(F.col(entity), F.lit(f"{sep}("), F.col(period).cast("string"), F.lit(")"))


def last_word(name: Column | str) -> Column:
    """Text after the last blank."""
    return F.substring_index(name, " ", -1)


def over_flag(ratio: str, limit: float = 1.0) -> Column:
    return F.col(ratio) > F.lit(limit)


def positive_lag(later: Column, earlier: Column) -> Column:
    """How much ``later`` comes after ``earlier``; NULL if it does not."""
    return F.when(later > earlier, later - earlier)


def signed_label(value: str) -> Column:
    """A plus sign in front, whatever the value."""
    return F.concat(F.lit("+"), F.col(value).cast("string"))


def one_decimal(amount: Column) -> Column:
    """Text with one decimal of an amount (not negative) that has at most two.

    A second decimal of 5 goes the way of the binary number behind it, and to the even digit only
    if that is a true half, as C and Python format it. ``20 x amount`` is compared with the halfway
    point as ``16 x + 4 x``, each of which is exact.
    """
    cents = F.round(amount * 100).cast("bigint")
    half = (cents / F.lit(5)) - amount * 16
    tenths = F.floor(cents / F.lit(10))
    up = (amount * 4 > half) | ((amount * 4 == half) & (tenths % 2 == 1))
    chosen = F.when(up, tenths + 1).otherwise(tenths) / F.lit(10.0)
    return F.format_string("%.1f", F.when(cents % 10 == 5, chosen).otherwise(amount))


def amount_label(amount: str, units: str, word: str = " Games") -> Column:
    """``$12.3M  (20 Games)``."""
    return F.concat(
        F.lit("$"),
        one_decimal(F.col(amount)),
        F.lit("M  ("),
        F.col(units).cast("string"),
        F.lit(f"{word})"),
    )


def ratio_label(ratio: str, count: str) -> Column:
    """``1.07`` above ``(n=42)``."""
    return F.format_string("%.2f\n(n=%d)", F.col(ratio), F.col(count))
