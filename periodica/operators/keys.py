"""Rows whose key may be among given keys, told by a bitmap of bounded size before any shuffle;
and names for helper columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: bits of the map, 16 MB at most: rows of other keys pass with the share of bits that are set
KEY_BITS = 1 << 27


def free_names(df: DataFrame, *names: str) -> list[str]:
    """``names`` with as many underscores before them as it takes for ``df`` to have none of them."""
    taken = {c.lower() for c in df.columns}
    prefix = "__"
    while any(prefix + name.lower() in taken for name in names):
        prefix += "_"
    return [prefix + name for name in names]


def possibly_in(rows: DataFrame, column: str, keys: DataFrame, bits: int = KEY_BITS) -> DataFrame:
    """``rows`` whose ``column`` is in ``keys`` (its only column), and some of the others.

    The keys' hashes set bits of a map, which is built in pieces of 4 KB and broadcast; ``bits``
    bounds it whatever the number of keys. With far more keys than bits all rows pass, with fewer
    nearly none that has no key. An exact join has to follow. Rows with a NULL go.
    """
    (name,) = keys.columns

    def place(key: str):
        return F.pmod(F.xxhash64(F.col(key)), F.lit(bits))

    pieces = (
        keys.filter(F.col(name).isNotNull())
        .groupBy(F.bitmap_bucket_number(place(name)).alias("__piece"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(place(name))).alias("__bits"))
    )
    at = F.bitmap_bit_position(place(column))
    byte = F.substring("__bits", (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))
    byte = F.conv(F.hex(byte), 16, 10).cast("long")
    is_set = F.pmod(F.floor(byte / F.pow(F.lit(2), F.pmod(at, F.lit(8)))), F.lit(2)) == 1
    return (
        rows.filter(F.col(column).isNotNull())
        .withColumn("__piece", F.bitmap_bucket_number(place(column)))
        .join(F.broadcast(pieces), "__piece")
        .filter(is_set)
        .drop("__piece", "__bits")
    )
