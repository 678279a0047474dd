"""Tasks take texts out of Arrow bit by bit, count n-grams in place and get tokens once."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from periodica.llm import bpe, common, jaccard


def peak_mb(work) -> float:
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5, 400])
def test_frequent_grams_are_counted_like_unique_ones(n):
    rng = np.random.default_rng(n)
    sets = {i: np.unique(rng.integers(0, 50, 12).astype(np.uint64)) for i in range(n)}
    sets[-1] = np.empty(0, np.uint64)
    grams, times = np.unique(np.concatenate(list(sets.values())), return_counts=True)
    often = times >= jaccard._SEEN
    found, found_times = jaccard._often(sets)
    assert found.tolist() == grams[often].tolist() and found_times.tolist() == times[often].tolist()
    assert not sets


def test_a_blocks_grams_are_sorted_in_place():
    rng = np.random.default_rng(3)
    sets = {i: np.unique(rng.integers(0, 1 << 62, 1000).astype(np.uint64)) for i in range(1000)}
    # 8 MB of n-grams: one array of them and bits beside it
    assert peak_mb(lambda: jaccard._often(sets)) < 12


def test_ranges_of_texts():
    texts = pa.array(["ab", None, "é", "x" * 30, "", "y"]).slice(1)
    found = list(common.text_runs(texts, 6))
    assert [t for *_, part in found for t in part] == ["", "é", "x" * 30, "", "y"]
    assert [(a, b) for a, b, _ in found] == [(0, 2), (2, 3), (3, 5)]
    assert list(common.text_runs(pa.array([], pa.string()))) == []


def test_blocks_leave_texts_in_arrow():
    batch = pa.record_batch([pa.array([1, 2, 3]), pa.array(["é" * 5, None, "z" * 9])], ["id", "text"])
    found = list(bpe._blocks(iter([batch, batch]), 31))
    assert [ids for ids, _ in found] == [[1, 2], [3, 1], [2, 3]]
    assert all(isinstance(t, pa.StringScalar) for _, texts in found for t in texts)
    assert [t.as_py() for t in found[0][1]] == ["é" * 5, None]


def test_tokens_go_to_decoding_once(spark, documents):
    """Not once in their row and once beside it."""
    found = corpus_pipeline.tokens(spark, documents.where("doc_id < 60"), "unused")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "struct(" not in plan and plan.count("MapInArrow") == 1
    rows = found.collect()
    assert len(rows) == documents.where("doc_id < 60").count()
    assert all(r["n_tokens"] == len(r["ids"]) for r in rows)
