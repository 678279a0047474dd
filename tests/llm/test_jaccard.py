from __future__ import annotations

import random
import re
from itertools import combinations

import numpy as np
import pytest

from periodica.llm import graph, jaccard
from periodica.llm.jaccard import Join

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if len(words) < width:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def plain(rows, width, percent):
    """(id, size, smallest id reached) per row, by comparing each with each."""
    sets = [grams(t, width) for _, t in rows]
    group = list(range(len(rows)))
    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and group[a] != group[b]:
            same = len(sets[a] & sets[b])
            if 100 * same >= percent * len(sets[a] | sets[b]):
                group = [group[a] if g == group[b] else g for g in group]
    least = {}
    for (doc_id, _), g in zip(rows, group):
        if doc_id is not None:
            least[g] = min(least.get(g, doc_id), doc_id)
    return sorted(
        ((d, len(s), least.get(g)) for (d, _), s, g in zip(rows, sets, group)), key=str
    )


def answer(docs, join):
    found = jaccard.groups(docs, join).collect()
    return sorted(((r["doc_id"], r["n_grams"], r["component_id"]) for r in found), key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    base = [f"{rng.choice('abcdef')}{rng.randint(0, 300)}" for _ in range(80)]
    out = []
    for i in range(130):  # near copies, some of them linked through others only
        text = list(base)
        for _ in range(rng.randint(0, 7)):
            text[rng.randrange(80)] = f"z{rng.randint(0, 9)}"
        out.append((i, " ".join(text)))
    common = " ".join(base[:30])  # a passage in many documents
    out += [(200 + i, f"{common} " + " ".join(f"q{rng.random()}" for _ in range(60))) for i in range(40)]
    out += [(300 + i, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 9)))) for i in range(60)]
    out += [(400, None), (401, ""), (402, " \t"), (403, "A b\tC"), (404, "a  B c"), (405, "É x y z")]
    out += [(None, out[0][1]), (None, "lonely"), (406, "é x y z"), (5, out[5][1]), (5, out[5][1])]
    return out


@pytest.mark.parametrize("join", [Join(4, 85), Join(5, 80), Join(4, 85, room=1500), Join(2, 60, room=900)])
def test_against_all_pairs(make_docs, rows, join):
    assert answer(make_docs(rows), join) == plain(rows, join.width, join.percent)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert answer(docs, Join()) == plain(rows, 4, 85)


def test_the_order_does_not_matter(make_docs, rows, monkeypatch):
    monkeypatch.setattr(jaccard, "FREQUENT", 3)
    assert answer(make_docs(rows), Join()) == plain(rows, 4, 85)


@pytest.mark.parametrize("percent", [50, 80, 95])
def test_trie_finds_what_comparing_finds(percent):
    rng = np.random.default_rng(percent)
    sets = [
        np.sort(rng.choice(40, size=rng.integers(1, 25), replace=False)).astype(np.int64)
        for _ in range(150)
    ]
    sets += [sets[0][:-1], sets[1], np.arange(40)]
    trie = jaccard.Trie(sets, percent)
    for probe in sets:
        mask = np.zeros(40, bool)
        mask[probe] = True
        expected = []
        for k, other in enumerate(sets):
            same = int(mask[other].sum())
            if 100 * same >= percent * (len(probe) + len(other) - same):
                expected.append(k)
        assert sorted(trie.similar(probe, mask)) == expected


def test_gram_sets_match_a_plain_count():
    texts = ["a b c d e", "A  b\nc D e", "a b", None, "", "x " * 500, "a b c d a b c d"]
    found = jaccard.gram_sets(texts, 4)
    assert [len(s) for s in found] == [len(grams(t, 4)) for t in texts]
    assert (found[0] == found[1]).all()


def test_representatives_are_whole_rows(make_docs, rows):
    docs = make_docs(rows)
    kept = jaccard.representatives(docs)
    assert kept.schema == docs.schema
    # groups of at least one id, each once, and rows without n-grams
    expected = sorted({c for _, n, c in plain(rows, 4, 85) if n and c is not None})
    empty = [i for i, t in rows if not grams(t, 4)]
    alone = [None]  # "lonely" has no id
    found = sorted((r["doc_id"] for r in kept.collect()), key=str)
    assert found == sorted([*expected, *empty, *alone], key=str)


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(40)]
    edges += [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(50)] + [(300, 300)]
    found = graph.components(spark.createDataFrame(edges, "a long, b long")).collect()
    label = {x: x for e in edges for x in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert len(found) == len({r["node"] for r in found})
    assert {r["node"]: r["component"] for r in found} == {k: v for k, v in label.items() if k != 300}


def test_empty_tables(make_docs):
    assert jaccard.groups(make_docs([])).collect() == []
    assert jaccard.representatives(make_docs([])).collect() == []
    assert answer(make_docs([(1, None), (2, "")]), Join()) == [(1, 0, 1), (2, 0, 2)]
