from __future__ import annotations

import random
import re

import pytest

from periodica.llm import mixing
from periodica.llm.mixing import Mix


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def plain_targets(sizes, mix):
    """By handing out what is left again and again."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: mix.weights[i % len(mix.weights)] for i, s in enumerate(names)}
    target = dict.fromkeys(names, 0.0)
    left, open_ = mix.budget * sum(sizes.values()), set(names)
    while open_ and left > 1e-9:
        total = sum(weight[s] for s in open_)
        share = {s: left * weight[s] / total for s in open_}
        left = 0.0
        for s in list(open_):
            target[s] += share[s]
            if target[s] >= mix.most * sizes[s]:
                left += target[s] - mix.most * sizes[s]
                target[s] = mix.most * sizes[s]
                open_.remove(s)
    return target


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    out = [
        (i, " ".join("w" for _ in range(rng.choice((0, 1, 5, 40, 200)))), None, rng.choice("abcd"))
        for i in range(600)
    ]
    out += [(1000 + i, "v " * 30, None, "hot") for i in range(300)]
    out += [(2000, None, None, "a"), (2001, "x y", None, None), (None, "x y z", None, "b")]
    return out


def test_targets_and_sizes(make_docs, rows):
    mix = Mix()
    sizes = {}
    for _, text, _, source in rows:
        sizes[source] = sizes.get(source, 0) + words(text)
    target = plain_targets(sizes, mix)
    found = mixing.plan(make_docs(rows), mix).collect()
    assert len(found) == len(rows)
    taken = {}
    largest = 200
    for r in found:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(target[r["source"]])
        assert 0 <= r["copies"] <= 2
        taken[r["source"]] = taken.get(r["source"], 0) + r["copies"] * r["size"]
    for source, words_taken in taken.items():
        assert abs(words_taken - target[source]) <= largest / 2 + 1
    assert sorted(r["size"] for r in found) == sorted(words(t) for _, t, *_ in rows)


def test_longer_documents_are_taken_more_often(make_docs):
    docs = make_docs([(i, "w " * (2 if i % 2 else 200), None, "a") for i in range(800)])
    docs = docs.union(make_docs([(9000 + i, "w " * 500, None, "b") for i in range(200)]))
    found = mixing.plan(docs, Mix(weights=(1, 3), budget=0.6)).where("source = 'a'").collect()
    short = [r["copies"] for r in found if r["size"] == 2]
    long = [r["copies"] for r in found if r["size"] == 200]
    assert sum(short) / len(short) < sum(long) / len(long)


def test_ranks_follow_the_odds(make_docs):
    """What is taken beyond the certain copies comes first by odds over odds, as sorted plainly."""
    docs = make_docs([(i, "w " * (1 + i % 9), None, "a") for i in range(500)])
    drawn = mixing.stored(
        docs.select(*mixing._drawn(docs, "doc_id", "text", "source", Mix()), "doc_id"), "test"
    )
    solved = mixing._with(drawn, mixing._solve(drawn, Mix(budget=0.4)), ["target", "level"])
    rows = [r.asDict() for r in mixing._scored(solved, Mix()).collect()]
    due = rows[0]["target"] - sum(r["certain"] * r["size"] for r in rows)
    expected, total = set(), 0
    for r in sorted((r for r in rows if r["rank"] is not None), key=lambda r: (r["rank"], r["tie"])):
        if total + r["size"] / 2 > due:
            break
        total += r["size"]
        expected.add(r["doc_id"])
    found = mixing.plan(docs, Mix(budget=0.4)).collect()
    certain = {r["doc_id"]: r["certain"] for r in rows}
    assert {r["doc_id"] for r in found if r["copies"] > certain[r["doc_id"]]} == expected


def test_runs_agree_and_draw_repeats_rows(make_docs, rows):
    docs = make_docs(rows)
    first = {r["doc_id"]: r["copies"] for r in mixing.plan(docs).collect()}
    again = {r["doc_id"]: r["copies"] for r in mixing.plan(docs.repartition(7)).collect()}
    assert first == again
    drawn = mixing.draw(docs)
    assert drawn.schema == docs.schema
    counts = {r["doc_id"]: r["count"] for r in drawn.groupBy("doc_id").count().collect()}
    assert counts == {k: v for k, v in first.items() if v}


def test_repeated_rows_and_empty_tables(make_docs):
    same = [(1, "a b c", None, "s")] * 40 + [(2, "d e f", None, "t")] * 40
    found = mixing.plan(make_docs(same)).collect()
    assert len(found) == 80
    assert all(len({r["copies"] for r in found if r["doc_id"] == i}) == 1 for i in (1, 2))
    assert mixing.plan(make_docs([])).collect() == []
    assert mixing.draw(make_docs([])).collect() == []
    assert mixing.plan(make_docs([(1, None), (2, "")])).count() == 2


def test_a_cut_among_repeated_rows_takes_part_of_them(make_docs):
    """One repeated row is most of a source: its words still come within half a row of the target."""
    rows = [(1, "a b c", "x", "s")] * 90 + [(1, "a b c", "y", "s")] * 11
    rows += [(10 + i, "w " * 4, None, "s") for i in range(5)] + [(2, "d e", None, None)] * 30
    for budget in (0.3, 0.55, 1.2):
        docs, mix = make_docs(rows).repartition(5), Mix(budget=budget)
        found = mixing.plan(docs, mix).collect()
        assert len(found) == len(rows)
        for source in ("s", None):
            own = [r for r in found if r["source"] == source]
            target = own[0]["target"]
            assert abs(sum(r["copies"] * r["size"] for r in own) - target) <= 2
        drawn = mixing.draw(docs, mix)
        assert drawn.schema == docs.schema
        want = {}
        for r in found:
            want[r["doc_id"]] = want.get(r["doc_id"], 0) + r["copies"]
        got = {r["doc_id"]: r["count"] for r in drawn.groupBy("doc_id").count().collect()}
        assert got == {k: v for k, v in want.items() if v}
