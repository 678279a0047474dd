"""Rates, rounding, composite scores and tiers. All of it stays in the JVM."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def round_half_up(x: Column | str, digits: int) -> Column:
    """Round halves away from zero.

    Going through a decimal first drops the last-bit noise of a double, so the result does not
    depend on the order in which a sum was built up across tasks. Beyond 28 digits before the point
    a double has no digits after it: such a value, an infinity and NaN stay as they are.
    """
    exact = F.round(_col(x).try_cast("decimal(38,10)"), digits).cast("double")
    return F.coalesce(exact, _col(x).cast("double"))


def rate(total: Column | str, units: Column | str) -> Column:
    """True division; NULL when there are no units (no error under ANSI mode)."""
    return F.try_divide(_col(total).cast("double"), _col(units).cast("double"))


def combine_terms(plus: Sequence[str], minus: Sequence[str] = ()) -> Column:
    """Sum of ``plus`` less ``minus``; NULL as soon as one term is missing."""
    head = reduce(lambda a, b: a + b, [F.col(c) for c in plus])
    return reduce(lambda a, b: a - F.col(b), minus, head)


def composite(plus: Sequence[str], minus: Sequence[str], per: str) -> Column:
    """Contribution per unit."""
    return rate(combine_terms(plus, minus), per)


def tier(value: Column | str, tiers: Sequence[tuple[float, str]], otherwise: str) -> Column:
    """Label of the first floor that is reached; NULL values fall to ``otherwise``."""
    value = _col(value)
    first, *rest = tiers
    chain = reduce(
        lambda acc, step: acc.when(value >= F.lit(step[0]), F.lit(step[1])),
        rest,
        F.when(value >= F.lit(first[0]), F.lit(first[1])),
    )
    return chain.otherwise(F.lit(otherwise))
