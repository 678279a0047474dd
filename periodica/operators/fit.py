"""Least squares per group, from sums alone.

A linear fit needs no rows: the sums of the columns and of their products decide it. They are added
up where the rows are, a handful of numbers per group and task, and solved in the row that each
group has left. Values are whole numbers of their smallest steps, so the sums are exact and do not
depend on how the rows were spread.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: share of its own variation that a predictor must add to those before it
_NEW = 1e-9


def least_squares(
    rows: DataFrame, target: str, predictors: Sequence[str], within: str, digits: int = 2
) -> DataFrame:
    """Per ``within`` ``fit_rows``, ``intercept``, ``coefficients`` (an array in the order of
    ``predictors``) and ``spread``, the standard deviation of the residuals.

    Columns count to ``digits`` decimals. Rows with a NULL or an infinity in the target or a
    predictor are left out. A predictor that is constant, or a combination of those before it, has
    the coefficient 0. Groups with no more rows than unknowns have no row.
    """
    p = len(predictors)
    grid = [
        F.expr(f"try_cast(round(try_cast(`{c}` as decimal(38,10)), {digits}) * {10**digits} as decimal(18,0))")
        for c in (*predictors, target)
    ]
    steps = rows.select(F.col(within), *[g.alias(f"v{i}") for i, g in enumerate(grid)]).dropna(
        subset=[f"v{i}" for i in range(p + 1)]
    )
    pairs = [(i, j) for i in range(p + 1) for j in range(i, p + 1)]
    sums = steps.groupBy(within).agg(
        F.count(F.lit(1)).alias("fit_rows"),
        *[F.sum(f"v{i}").cast("double").alias(f"s{i}") for i in range(p + 1)],
        *[F.sum(F.expr(f"v{i} * v{j}")).cast("double").alias(f"q{i}_{j}") for i, j in pairs],
    )
    # n times the sums of products about the means
    about = sums.where(F.col("fit_rows") > p + 1).select(
        within,
        "fit_rows",
        *[f"s{i}" for i in range(p + 1)],
        *[F.expr(f"fit_rows * q{i}_{j} - s{i} * s{j}").alias(f"c{i}_{j}") for i, j in pairs],
    )
    solved = _solve(about, p)
    scale = float(10**digits)
    explained = _total(F.col(f"b{i}") * F.col(f"c{i}_{p}") for i in range(p))
    left = F.col(f"c{p}_{p}") - explained
    left = F.when(left > F.col(f"c{p}_{p}") * _NEW, left).otherwise(0.0)
    centre = F.col(f"s{p}") - _total(F.col(f"b{i}") * F.col(f"s{i}") for i in range(p))
    return solved.select(
        within,
        "fit_rows",
        (centre / F.col("fit_rows") / scale).alias("intercept"),
        F.array(*[F.col(f"b{i}") for i in range(p)]).alias("coefficients"),
        (F.sqrt(left / F.col("fit_rows") / (F.col("fit_rows") - (p + 1))) / scale).alias("spread"),
    )


def _total(terms) -> Column:
    return sum(terms, F.lit(0.0))


def _solve(about: DataFrame, p: int) -> DataFrame:
    """Adds ``b0`` to ``b{p-1}``: the predictors are eliminated one after the other."""

    def m(i: int, j: int) -> str:
        return f"m{i}_{j}"

    start = {m(i, j): F.col(f"c{min(i, j)}_{max(i, j)}") for i in range(p) for j in range(p + 1)}
    rows = about.withColumns(start)
    for i in range(p):
        pivot = F.col(m(i, i))
        # nothing new in it: left out of the others
        rows = rows.withColumn(f"by{i}", F.when(pivot > F.col(f"c{i}_{i}") * _NEW, F.lit(1.0) / pivot).otherwise(0.0))
        rows = rows.withColumns(
            {
                m(j, k): F.col(m(j, k)) - F.col(m(j, i)) * F.col(f"by{i}") * F.col(m(i, k))
                for j in range(p)
                if j != i
                for k in range(p + 1)
            }
        )
    return rows.withColumns({f"b{i}": F.col(m(i, p)) * F.col(f"by{i}") for i in range(p)})


def predicted(predictors: Sequence[str]) -> Column:
    """The fitted value of a row that has the columns of ``least_squares`` next to it."""
    terms = [F.col(c).cast("double") * F.col("coefficients")[i] for i, c in enumerate(predictors)]
    return F.col("intercept") + _total(terms)
