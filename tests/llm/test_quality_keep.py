"""Keeping good documents sends their texts to Python, and nothing else, and brings scores back."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from periodica.llm import quality
from periodica.llm.common import held_out


@pytest.fixture(scope="module")
def field(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    return quality.learn(docs, labels, ~held_out("doc_id"))


def test_rows_stay_out_of_python(spark, field):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = docs.selectExpr("*", "interval 1 month as age", "doc_id as _scored", "doc_id as scored")
    kept = quality.keep(odd, field)
    assert kept.schema == odd.schema
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and plan.count("ArrowEvalPython") == 1
    want = {r["doc_id"] for r in quality.score(docs, field).collect() if r["score"] >= quality.CUT}
    found = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert set(found) == want and len(found) == len(want) and 0 < len(want) < docs.count()


def test_texts_are_taken_out_bit_by_bit(field, monkeypatch):
    texts = ["A line of words.\nAnother one.", None, "", "x" * 50, "é ü\n" * 30]
    whole = quality.score_texts(texts, field)
    monkeypatch.setattr(quality, "TAKEN", 40)
    assert np.array_equal(quality._scored(pa.array(texts), field), whole)
    assert len(quality._scored(pa.array([], pa.string()), field)) == 0
