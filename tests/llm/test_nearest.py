from __future__ import annotations

import random

import pytest

from periodica.llm import nearest

SCHEMA = "vec_id long, embedding array<float>, code string, distance int"


def plain(rows, queries, k, bits):
    def code(v):
        return tuple((v[i] or 0) > 0 if i < len(v) else False for i in range(bits))

    have = {(i, code(v)) for i, v in rows if i is not None and v is not None}
    out = set()
    for q, c in {(i, code(v)) for i, v in queries if i is not None and v is not None}:
        near = sorted((sum(x != y for x, y in zip(c, d)), i) for i, d in have if (i, d) != (q, c))
        out |= {(q, n + 1, i, d) for n, (d, i) in enumerate(near[:k])}
    return out


def answer(spark, rows, queries, k, bits, width):
    def frame(some):
        return spark.createDataFrame([(i, v, "x", 1) for i, v in some], SCHEMA)

    found = nearest.search(frame(rows), frame(queries), k, bits, width).collect()
    assert len(found) == len(set(found))
    return {tuple(r) for r in found}


@pytest.mark.parametrize(("k", "bits", "width"), [(3, 16, 4), (5, 12, 6)])
def test_against_all_pairs(spark, k, bits, width):
    rng = random.Random(k)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(bits)]) for i in range(60)]
    hot = [(100 + i, rows[0][1]) for i in range(40)]  # one code in two fifths of the rows
    odd = [(200, None), (None, rows[1][1]), (201, [1.0]), (202, [None] * bits), rows[5], rows[5]]
    rows = rows + hot + odd
    queries = [rows[i] for i in (0, 3, 5, 60, 61, 102, 103)]
    assert answer(spark, rows, queries, k, bits, width) == plain(rows, queries, k, bits)


def test_fewer_rows_than_asked_for(spark):
    rows = [(1, [1.0, 1.0, -1.0, 1.0]), (2, [-1.0, -1.0, 1.0, -1.0])]
    assert answer(spark, rows, rows, 5, 4, 2) == {(1, 1, 2, 4), (2, 1, 1, 4)}


def test_empty_tables(spark):
    rows = [(1, [1.0, 1.0])]
    assert answer(spark, [], [], 3, 2, 1) == set()
    assert answer(spark, rows, [], 3, 2, 1) == set()
    assert answer(spark, [], rows, 3, 2, 1) == set()


def test_probes_of_a_radius(spark):
    queries = spark.createDataFrame([(0b1011_0110,)], "query long")
    for distance in range(5):
        found = nearest._probes(queries, distance, nearest.cuts(8, 16, 4)).collect()
        for segment, own in ((0, 0b0110), (1, 0b1011)):
            values = [r["value"] for r in found if r["segment"] == segment]
            expected = [v for v in range(16) if (v ^ own).bit_count() == distance]
            assert sorted(values) == expected


def test_segments_follow_the_number_of_codes(spark):
    for bits, codes in ((64, 0), (64, 1), (64, 2), (64, 20_000), (64, 10**9), (64, 1 << 63), (12, 9)):
        at = nearest.cuts(bits, codes, 1)
        assert [a for a, _ in at] == [sum(w for _, w in at[:i]) for i in range(len(at))]
        assert sum(w for _, w in at) == bits
        assert max(w for _, w in at) - min(w for _, w in at) <= 1
    assert nearest.cuts(64, 1 << 16) == nearest.cuts(64, 100) == [(i, 16) for i in (0, 16, 32, 48)]
    assert len(nearest.cuts(64, 10**9)) == 2
    rng = random.Random(1)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(64)]) for i in range(60)]
    assert answer(spark, rows, rows[:5], 4, 64, None) == plain(rows, rows[:5], 4, 64)
    # one segment of 64 bits, most of a code's sign bit set
    near = [(i, [1.0] * 63 + [1.0 if i % 2 else -1.0]) for i in range(6)]
    assert answer(spark, near, near, 2, 64, 64) == plain(near, near, 2, 64)
