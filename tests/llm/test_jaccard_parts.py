"""Large candidate parts: chance matches are taken apart, sets far apart are told so without a descent."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from test_jaccard import answer, plain

from periodica.llm import jaccard
from periodica.llm.jaccard import Join


def edited(rng, base, most):
    """A text with up to that share of its words exchanged."""
    share = rng.random() * most
    return [f"x{rng.random()}" if rng.random() < share else w for w in base]


@pytest.mark.parametrize("percent", [50, 80, 85, 95])
def test_sets_that_link_share_a_range(percent):
    rng = np.random.default_rng(percent)
    join = Join(4, percent)
    linked = 0
    for _ in range(1500):
        base = np.unique(jaccard.mixed(rng.integers(0, 1 << 62, rng.integers(1, 300)).astype(np.uint64)))
        a, b = (base[rng.random(len(base)) > rng.random() * (100 - percent) / 140] for _ in range(2))
        same = len(np.intersect1d(a, b))
        if same and 100 * same >= percent * (len(a) + len(b) - same):
            linked += 1
            assert len(np.intersect1d(jaccard.signatures(a, join), jaccard.signatures(b, join)))
    assert linked > 300


def test_sets_far_apart_take_no_descent(monkeypatch):
    """Versions of one text that differ too much: each was compared with all, gram by gram."""
    rng = random.Random(3)
    base = range(300)
    sets = []
    for i in range(80):
        out = set(rng.sample(base, 60))
        sets.append(np.array([x for x in base if x not in out] + [1000 * (i + 1) + x for x in out], np.uint64))
    sets += [np.array([*s[:-2], 7], np.uint64) for s in sets[:5]]  # of these each links with one
    descents = []
    similar = jaccard.Trie.similar

    def counted(*given, **named):
        descents.append(1)
        return similar(*given, **named)

    monkeypatch.setattr(jaccard.Trie, "similar", counted)
    label = jaccard.connected([np.unique(s) for s in sets], 85)
    assert len(np.unique(label)) == 80 and (label[80:] == label[:5]).all()
    assert len(descents) <= 10


@pytest.mark.parametrize("join", [Join(4, 85, room=400), Join(5, 80, room=400)])
def test_chance_matches_do_not_make_large_parts(make_docs, monkeypatch, join):
    """A chain of pairs that share a phrase with the next one; nothing in it links."""
    rows = []
    for i in range(20):
        own = [f"w{i}a{k}" for k in range(60)]
        for copy, phrase in ((0, i), (1, i - 1)):
            text = [w if k % 20 or not copy else f"{w}c" for k, w in enumerate(own)]
            rows.append((2 * i + copy, " ".join(text + [f"p{phrase}b{k}" for k in range(12)])))

    def refused(*_):
        raise AssertionError("compared block by block")

    monkeypatch.setattr(jaccard, "_large", refused)
    assert answer(make_docs(rows), join) == plain(rows, join.width, join.percent)


def test_a_large_family(make_docs):
    """Edited versions of a text, more than one task takes: some link, most do not."""
    rng = random.Random(8)
    base = [f"w{rng.randint(0, 999)}" for _ in range(90)]
    rows = [(i, " ".join(edited(rng, base, 0.12 if i % 2 else 0.02))) for i in range(70)]
    assert answer(make_docs(rows), Join(4, 85, room=2000)) == plain(rows, 4, 85)


def test_thinned_grams_move_in_blocks():
    """A row per n-gram was sorted and moved; now a row per task and range of n-grams is."""
    rng = random.Random(4)
    texts = [" ".join(f"v{rng.randint(0, 400)}" for _ in range(rng.randint(1, 60))) for _ in range(60)]
    texts += [texts[0], "", None, "v1 v2"]

    class Order:
        value = (np.unique(np.concatenate(jaccard.gram_sets(texts[:3], 2))), None)

    buckets = 5
    halves = [pa.record_batch({"text": pa.array(t, pa.string())}) for t in (texts[:40], texts[20:])]
    blocks = [b for h in halves for b in jaccard._thinned(Join(2, 80), Order, buckets)(iter([h]))]
    assert sum(b.num_rows for b in blocks) <= 2 * (buckets + 1)
    table = pa.Table.from_batches(blocks)
    found, counts = set(), {}
    for k in range(buckets):
        rows = jaccard._shared(table.filter(pc.equal(table.column("bucket"), k)))
        for gram, node, thin in zip(*rows.to_pydict().values()):
            if gram is None:
                counts[node] = thin
            else:
                assert (gram, node) not in found
                found.add((gram, node))
    sets = {jaccard._node(s): s[jaccard._alone_maybe(s, Order.value[0])] for s in jaccard.gram_sets(texts, 2) if len(s)}
    assert counts == {node: len(s) for node, s in sets.items()}
    having = {}
    for node, s in sets.items():
        for gram in s.view(np.int64).tolist():
            having.setdefault(gram, set()).add(node)
    assert found == {(g, n) for g, nodes in having.items() if len(nodes) > 1 for n in nodes}
    assert found


def test_what_a_task_brings_together_is_bounded():
    assert jaccard._bucket_count(0) == 1
    assert (1 << 24) // jaccard._bucket_count(1 << 24) <= 1 << 17
    for thinned in (1 << 30, 1 << 33, 1 << 40):
        buckets = jaccard._bucket_count(thinned)
        assert buckets > 1 << 12 or thinned < 1 << 33
        assert thinned // buckets <= 1 << 20
