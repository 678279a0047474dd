"""Exact deduplication by content-defined chunk recipes, with DataFrame functions only.

A text is cut where its own content says so: after at least ``least`` characters at the next line
end, or after a full stop or before one of a few letters, at ``most`` characters at the latest.
Equal texts are cut alike. Every chunk gets a 64-bit hash, and each distinct chunk moves once, to
be verified: hashes that stand for several texts are found, and their texts are numbered. Hash and
number identify a chunk, so equal identifiers mean equal chunks. Documents are then compared by
their ordered lists of identifiers, some bytes for thousands of characters.

Texts count as equal after lower-casing A to Z only; a NULL counts as empty. Of equal texts the row
with the largest id stays; a NULL id is the smallest, and of rows equal in id and text one stays.
Copies are counted before the shuffle, so a large group of copies is a few rows to sum up. An
empty table gives an empty result; further columns are kept by ``distinct`` and ignored otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from periodica.llm.common import lower_ascii, stored

#: characters of a chunk
LEAST, MOST = 1024, 8192


def normalised(text: str) -> Column:
    return lower_ascii(F.coalesce(F.col(text), F.lit("")))


def chunks(text: Column, least: int = LEAST, most: int = MOST) -> Column:
    """The chunks of a text in order; together they are the text."""
    end = r"(?:\n|[.] |(?<=[aeinrst]) (?=[a-m])|\z)"
    pattern = rf"(?s).{{{least},{most}}}?{end}|.{{1,{most}}}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _hash(part: Column, bits: int) -> Column:
    return F.xxhash64(part) if bits == 64 else F.pmod(F.xxhash64(part), F.lit(1 << bits))


def recipes(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least: int = LEAST,
    most: int = MOST,
    hash_bits: int = 64,
) -> DataFrame:
    """Per row ``id``, ``row`` (a number), ``digest`` (SHA-256 of the normalised text) and its
    recipe: ``hashes`` in order, and ``numbers``, places and numbers of the chunks whose hash
    stands for several texts, as good as always empty (stored)."""
    part = chunks(normalised(text_col), least, most)
    cut = docs.select(
        F.col(id_col).alias("id"),
        F.monotonically_increasing_id().alias("row"),
        F.sha2(normalised(text_col), 256).alias("digest"),
        F.transform(part, lambda p: _hash(p, hash_bits)).alias("hashes"),
    )
    kept = stored(cut, "dedup-recipes")
    parts = docs.select(F.explode(part).alias("part"))
    parts = parts.select(_hash(F.col("part"), hash_bits).alias("hash"), "part").distinct()
    shared = stored(
        parts.groupBy("hash").count().where("count > 1").select("hash"), "dedup-collisions"
    )
    none = F.array().cast("array<struct<place:int,number:int>>")
    if shared.isEmpty():
        return kept.withColumn("numbers", none)
    numbered = parts.join(shared, "hash").select(
        "hash",
        "part",
        F.row_number().over(Window.partitionBy("hash").orderBy("part")).alias("number"),
    )
    texts = docs.select(
        F.col(id_col).alias("id"),
        F.sha2(normalised(text_col), 256).alias("digest"),
        F.posexplode(part).alias("place", "part"),
    ).distinct()
    per_text = (
        texts.join(numbered, "part")
        .groupBy("id", "digest")
        .agg(F.sort_array(F.collect_list(F.struct("place", "number"))).alias("_numbers"))
        .select(F.col("id").alias("_id"), F.col("digest").alias("_digest"), "_numbers")
    )
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest"))
    return (
        kept.join(per_text, same, "left")
        .withColumn("numbers", F.coalesce("_numbers", none))
        .drop("_id", "_digest", "_numbers")
    )


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **cut) -> DataFrame:
    """One row per document: its id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``."""
    recipe = ["hashes", "numbers"]
    rows = recipes(docs, id_col, text_col, **cut)
    groups = rows.groupBy(*recipe).agg(
        F.max(F.struct("id", "row")).alias("top"), F.count("*").alias("group_size")
    )
    return rows.join(groups, recipe).select(
        F.col("id").alias(id_col),
        F.col("top.id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("top.row")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def distinct(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **cut) -> DataFrame:
    """The rows of ``docs`` that stay.

    Of rows equal in id and normalised text the largest by all columns stays.
    """
    names = [f"`{c}`" for c in docs.columns]
    staying = copies(docs, id_col, text_col, **cut).where("kept")
    staying = staying.select(F.col(id_col).alias("_id"), F.col("text_sha256").alias("_digest"))
    rows = docs.select(
        F.struct(*names).alias("_row"),
        F.col(id_col).alias("_doc"),
        F.sha2(normalised(text_col), 256).alias("_text"),
    )
    same = F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_digest"))
    found = rows.join(staying, same, "left_semi")
    repeated = stored(
        rows.groupBy("_doc", "_text").count().where("count > 1").drop("count"), "dedup-repeated"
    )
    if repeated.isEmpty():
        return found.select("_row.*")
    again = repeated.select(F.col("_doc").alias("_id"), F.col("_text").alias("_digest"))
    once = found.join(again, same, "left_anti")
    several = found.join(again, same, "left_semi")
    several = several.groupBy("_doc", "_text").agg(F.max("_row").alias("_row"))
    return once.select("_row.*").unionByName(several.select("_row.*"))
