from __future__ import annotations

import random
import re

import numpy as np
import pytest

from periodica.llm import pii


def plain(text):
    """The base patterns, word for word."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((*m.span(), 0))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((*m.span(), 1))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        doubled = [int(c) * (1 + i % 2) for i, c in enumerate(digits[::-1])]
        if 14 <= len(digits) <= 19 and sum(d // 10 + d % 10 for d in doubled) % 10 == 0:
            out.append((*m.span(), 2))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((*m.span(), 3))
    return sorted(out, key=lambda s: (s[0], s[2]))


@pytest.fixture(scope="module")
def field(spark):
    return pii.learn(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_base_spans_of_all_documents(texts):
    assert all(pii.base_spans(t or "") == plain(t or "") for t in texts.values())
    assert sum(len(plain(t or "")) for t in texts.values()) > 0


def test_base_spans_of_random_texts():
    rng = random.Random(2)
    parts = ["a", "@", ".", "1", "23", "+", "-", " ", "(", ")", "x.y", "@b.c", "456", "0", "é", "%"]
    parts += ["7890123", "4111111111111111", "10.0.0.255", "\n"]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 20)))
        assert pii.base_spans(text) == plain(text), text


@pytest.mark.parametrize(
    ("text", "added"),
    [
        ("Call +1 (980) 555-6268, or (980) 555-6268.", ["(980) 555-6268"]),
        ("Call +1 (980) 555-6268! Or 9805556268!", ["9805556268"]),
        ("Card 4111 1111 1111 1111, again 4111.1111.1111.1111", ["4111.1111.1111.1111"]),
        ("Call +1 (980) 555-6268 in 2021, room 12345678, for 555 dollars", []),
        ("year 2021, 12345678 things, 555-6268", []),
        ("a.b@mail.example.com costs 12345678", []),
        ("", []),
    ],
)
def test_added_spans(field, text, added):
    found = pii.spans(text, field)
    assert [(a, b, k) for a, b, k, base in found if base] == plain(text)
    assert [text[a:b] for a, b, _, base in found if not base] == added


@pytest.mark.parametrize(
    ("text", "added"),
    [
        ("Call +1 (980) 555-6268 or 980 555 6268 now", ["980 555 6268"]),
        ("Call +44 20 7946 0958, here 020 7946 0958.", ["020 7946 0958"]),
        ("020 7946 0958 is short for +44 20 7946 0958", ["020 7946 0958"]),
        ("Call +49 30 1234567890 or 0049301234567890", ["0049301234567890"]),
        ("Call +49 30 1234567890 or 00 49 30 1234567890!", ["00 49 30 1234567890"]),
        ("Call +1 (980) 555-6268 or 12 980 555 6268 34", ["980 555 6268"]),
        ("Or +1 (980) 555-6268: 980 555 6268 980 555 6268", ["980 555 6268"] * 2),
        ("Card 4111 1111 1111 1111, or 4111/1111 1111 1111", ["4111/1111 1111 1111"]),
        ("Call +1 (980) 555-6268 or 980 555 6269, of 980 and 555 and 6268", []),
    ],
)
def test_numbers_written_again_in_groups(field, text, added):
    assert [text[a:b] for a, b, _, base in pii.spans(text, field) if not base] == added


def test_repeats_take_linear_time(field):
    text = "+1 (980) 555-6268 or " + "1 " * 100_000 + "x " + "0" * 300_000 + " 980 555 6268"
    assert [text[a:b] for a, b, _, base in pii.spans(text, field) if not base] == ["980 555 6268"]


def test_addresses_among_marks_take_linear_time(field):
    marks = "!" * 200_000
    text = f"a@b.cd and @{marks}x{marks}x or ({marks}a@b.cd)"
    assert len(pii.spans(text, field)) >= 1
    assert pii._key(f"<{marks}_Ab@b.cd{marks}>") == "@_ab@b.cd"
    assert pii._key(f"@{marks}") == "@"


def test_clean_documents_stay_clean(field, texts):
    for text in texts.values():
        if text and not plain(text):
            assert pii.spans(text, field) == []


def test_messages_are_exact_on_a_chain():
    rng = np.random.default_rng(5)
    local = rng.normal(size=(4, 3))
    links = np.array([[0, 1], [1, 2], [2, 3]])
    table = rng.normal(size=(3, 3, 3))
    total = np.zeros((4, 3))
    for y in np.ndindex(3, 3, 3, 3):
        score = sum(local[i, y[i]] for i in range(4))
        score += sum(table[e, y[a], y[b]] for e, (a, b) in enumerate(links))
        for i in range(4):
            total[i, y[i]] += np.exp(score)
    total /= total.sum(axis=1, keepdims=True)
    assert np.allclose(pii.beliefs(local, links, table, rounds=200), total, atol=1e-3)


def test_links_carry_labels_over_any_distance(field):
    filler = "word " * 50_000
    text = f"+49 30 1234567890 {filler} 30.1234567890"
    found = pii.spans(text, field)
    assert [text[a:b] for a, b, _, base in found if not base] == ["30.1234567890"]


def test_patterns_take_linear_time():
    text = "x" * 300_000 + " " + "9" * 300_000 + " " + "a.b@" * 50_000 + "1." * 100_000
    assert pii.base_spans(text) == pii.base_spans(text)


def test_rows(make_docs, field):
    rows = [(1, None), (2, ""), (3, "x@y.zz"), (3, "x@y.zz"), (None, "x@y.zz"), (5, "a" * 2_000_000)]
    found = pii.find(make_docs(rows), field).collect()
    assert len(found) == 6
    assert sum(len(r["spans"]) for r in found) == 3
    assert found[2]["spans"][0].asDict() == {"kind": "email", "start": 0, "end": 6, "base": True}
    assert pii.find(make_docs([]), field).collect() == []
    assert pii.find(make_docs(rows), pii.learn(make_docs([]))).count() == 6


def test_learning_is_bounded_and_does_not_depend_on_partitions(make_docs):
    rows = [(i, f"call +49 30 12345{i:03} or 0049301234{i:04}, a{i}@b.org " * 40) for i in range(60)]
    docs = make_docs(rows)
    how = pii.Learning(tokens=500, rounds=5)
    one, other = pii.learn(docs, how), pii.learn(docs.repartition(5), how)
    assert np.allclose(one.weights, other.weights)
    # links are counted over all of the sample's tokens
    assert np.array_equal(one.beside, other.beside) and np.array_equal(one.alike, other.alike)
    assert one.alike[pii.KINDS.index("email"), pii.KINDS.index("email")] > 0
