from __future__ import annotations

import time
import tracemalloc
from itertools import product

import numpy as np
import pytest

from periodica.llm import quality
from periodica.llm.common import held_out


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.01/labels.parquet")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


@pytest.fixture(scope="module")
def field(docs, labels):
    return quality.learn(docs, labels, ~held_out("doc_id"))


def test_held_out_documents(docs, labels, field):
    rows = quality.score(docs, field).join(labels, "doc_id").where(held_out("doc_id")).collect()
    right = [(r["score"] >= quality.CUT) == (r["quality"] == 1) for r in rows]
    assert np.mean(right) > 0.9
    bad = [r["score"] for r in rows if r["quality"] == 0]
    good = [r["score"] for r in rows if r["quality"] == 1]
    assert np.median(bad) < 0.2 and np.median(good) > 0.9


def test_marginals_are_exact():
    rng = np.random.default_rng(1)
    lines = np.array([3, 1, 5, 2])
    good = rng.normal(size=lines.sum())
    change = rng.normal(size=(2, 2))
    p, pairs = quality.marginals(good, lines, change)
    start = 0
    for n in lines:
        ways = list(product((0, 1), repeat=int(n)))
        weight = np.exp(
            [
                sum(good[start + i] * y[i] for i in range(n))
                + sum(change[y[i], y[i + 1]] for i in range(n - 1))
                for y in ways
            ]
        )
        weight /= weight.sum()
        for i in range(n):
            assert p[start + i] == pytest.approx(sum(w for w, y in zip(weight, ways) if y[i]))
            if i + 1 < n:
                both = sum(w for w, y in zip(weight, ways) if y[i] == 0 and y[i + 1] == 1)
                assert pairs[start + i, 0, 1] == pytest.approx(both)
        start += n


def test_line_features_by_hand():
    table, length, lines = quality.line_features(["Aa b%%\nAa b%%\n", "", "x x y."])
    assert lines.tolist() == [3, 1, 1]
    assert length.tolist() == [6, 6, 0, 0, 6]
    odd, distinct, repeats = table[:, 11], table[:, 9], np.expm1(table[:, 13])
    assert odd.tolist() == [0.5, 0.5, 0, 0, 0]
    assert distinct.tolist() == [1, 1, 0, 0, pytest.approx(2 / 3)]
    assert repeats.round().tolist() == [1, 1, 0, 0, 0]


def test_scores_do_not_depend_on_the_batch(texts, field):
    some = list(texts.values())[:60]
    together = quality.score_texts(some, field)
    alone = [quality.score_texts([t], field)[0] for t in some]
    assert np.allclose(together, alone)


def test_odd_texts(make_docs, field):
    rows = [(1, None), (2, ""), (3, "\n\n"), (4, "x " * 800_000), (4, "x " * 800_000), (None, "a b")]
    found = quality.score(make_docs(rows), field).collect()
    assert len(found) == 6
    by_id = {r["doc_id"]: r["score"] for r in found}
    assert by_id[1] == by_id[2]
    assert all(0 <= s <= 1 for s in by_id.values())


def test_keep_returns_whole_rows(make_docs, field):
    good = "The thing and then of it was a good one, he said to her.\nAnother line of it, too."
    docs = make_docs([(1, good, "en", "s"), (2, "AB!! CD!! EF!! " * 30, "en", None), (None, good)])
    kept = quality.keep(docs, field)
    assert kept.schema == docs.schema
    cut = {r["doc_id"]: r["score"] >= quality.CUT for r in quality.score(docs, field).collect()}
    assert {r["doc_id"] for r in kept.collect()} == {k for k, v in cut.items() if v}


def test_without_labels_or_rows(make_docs, labels, field):
    docs = make_docs([(1, "text")])
    none = quality.learn(docs, labels.where("false"))
    assert quality.score(docs, none).first()["score"] == 0.5
    assert quality.score(make_docs([]), field).collect() == []
    assert quality.keep(make_docs([]), field).collect() == []


def test_all_rows_stay_if_nothing_was_learnt(spark, make_docs):
    docs = make_docs([(1, "some text"), (1, "some text"), (2, None), (None, "")])
    labels = spark.createDataFrame([], "doc_id long, quality int")
    field = quality.learn(docs, labels)
    assert field is None
    assert sorted(map(str, quality.keep(docs, field).collect())) == sorted(map(str, docs.collect()))


def test_long_texts_in_stretches_have_the_same_marginals(monkeypatch, texts, field):
    rng = np.random.default_rng(5)
    lines = [line for t in list(texts.values())[:40] for line in (t or "").split("\n")] + ["", "", "é" * 30]
    odd = [
        "\n".join(lines[i] for i in rng.integers(0, len(lines), 900)),
        "\n" * 700,
        "\n" * 300 + "x" * 9000 + "\n" + "good words here.\n" * 40,
        "y" * 5000 + "\nz",
    ]
    whole = quality.score_texts(odd, field)
    for stretch in (37, 400, 100_000):
        monkeypatch.setattr(quality, "STRETCH", stretch)
        parts = [quality._score_long(t, field) for t in odd]
        scores = 1 / (1 + np.exp(-(field.slope * quality._logit(np.array(parts)) + field.offset)))
        assert scores == pytest.approx(whole, abs=1e-9)
    monkeypatch.setattr(quality, "LONG_LINES", 30)
    assert quality.score_texts([None, *odd], field)[1:] == pytest.approx(whole, abs=1e-9)


def test_a_million_lines_take_bounded_memory_and_time(field):
    text = "a short line, 17.\n" * 1_000_000
    tracemalloc.start()
    began = time.monotonic()
    (score,) = quality.score_texts([text], field)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert 0 <= score <= 1
    assert peak < 250 << 20
    assert time.monotonic() - began < 60
