from __future__ import annotations

import pytest
from pyspark.sql import types as T

FOLDER = "/root/testdata/sf0.001"

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        # names that operators use inside
        *[
            T.StructField(name, T.StringType())
            for name in (
                *("id", "size", "row", "node", "part", "label", "score", "copies", "_row"),
                *("_scored_text", "component", "n", "level", "target", "ids", "spans", "digest"),
                *("key", "rank", "able", "weight", "tokens", "pieces", "sequence_id", "keys"),
            )
        ],
    ]
)


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text, lang, source), with further columns of clashing names."""

    def make(rows):
        extra = tuple("x" for _ in DOCS.fields[4:])
        return spark.createDataFrame([(*r, *([None] * (4 - len(r))), *extra) for r in rows], DOCS)

    return make


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r["doc_id"]: r["text"] for r in documents.select("doc_id", "text").collect()}
