"""The corpus pipeline: stages over the documents of a folder, each written and read again.

Documents of low quality go, of equal texts one stays, of each group of near copies one stays,
sources are mixed to target weights, and the mix is encoded and decoded again. Every stage works on all that the one
before it kept; all but the last return the columns of the documents. NULL texts count as empty,
further columns pass through, and an empty table stays empty, see the operators.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from periodica.llm import bpe, dedup, jaccard, mixing, quality
from periodica.llm.common import held_out, stored, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: near copies share at least 80 % of their runs of five words
NEAR = jaccard.Join(width=5, percent=80)

VOCABULARY = "byte_bpe_50k.tiktoken"


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose lines the field labels good; learnt from labels outside the held-out rows.

    Without any such label nothing is judged, and all documents stay.
    """
    field = quality.learn(docs, table(spark, sf_dir, "labels"), ~held_out("doc_id"))
    return quality.keep(docs, field)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays."""
    return dedup.distinct(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest id stays."""
    return jaccard.representatives(docs, NEAR)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources in target proportions; documents repeat as often as they are taken."""
    return mixing.draw(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per row its id, the number of its tokens, their ids and a digest of the decoded bytes."""
    ranks = bpe.read_ranks(public_tokenizers.path(VOCABULARY))
    encoded = bpe.encode(docs, ranks, public_tokenizers.PATTERN)
    # ids of rows repeat after the mix, so the tokens go through decoding with their row, once
    return bpe.decode(encoded, ranks, with_ids=True).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        "ids",
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES: list[tuple[str, Stage]] = [
    ("quality", good_quality),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mix", mix),
    ("tokens", tokens),
]

#: SQL can express neither the field nor the encoding; tests hold run() against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
