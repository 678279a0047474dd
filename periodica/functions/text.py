"""Money text, compound labels and names."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def parse_money(text: Column | str, lenient: bool = False) -> Column:
    """``"$4,250,000"`` to 4250000.

    Text that is no whole number gives NULL. With ``lenient`` its leading digits count instead
    (none at all give 0), as a plain integer cast does in some SQL databases.
    """
    text = F.col(text) if isinstance(text, str) else text
    bare = F.translate(text, "$,", "")
    if not lenient:
        return bare.try_cast("bigint")
    digits = F.regexp_extract(bare, r"^\s*([+-]?[0-9]+)", 1)
    return F.when(digits == "", F.when(bare.isNotNull(), F.lit(0).cast("bigint"))).otherwise(
        digits.try_cast("bigint")
    )


def primary_token(label: Column | str, sep: str = "-") -> Column:
    """First part of a compound label: ``SF-PF`` to ``SF``, ``C`` to ``C``."""
    return F.substring_index(label, sep, 1)


def normalize_name(name: Column | str) -> Column:
    """Strip accents and everything else outside ASCII, then lower-case."""

    # Defined here, the function travels to the executors by value: they need no copy of this
    # package.
    @F.pandas_udf(T.StringType())
    def normalized(names: pd.Series) -> pd.Series:
        plain = names.str.normalize("NFKD").str.encode("ascii", "ignore").str.decode("ascii")
        return plain.str.lower()

    return normalized(name)


def sequence_ratio(candidate: Column | str, query: Column | str) -> Column:
    """Matching-block similarity of the standard library for pairs of names."""

    @F.pandas_udf(T.DoubleType())
    def ratio(candidates: pd.Series, queries: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        pairs = zip(candidates, queries, strict=True)
        return pd.Series([SequenceMatcher(None, c, q).ratio() for c, q in pairs], dtype="float64")

    return ratio(candidate, query)
