"""Values, keys and names at the limits: nothing may depend on their size or merge silently."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from periodica.functions import parse_money, round_half_up
from periodica.layout import MONEY
from periodica.operators import clean, names, ranking, trends, value


def ranks(spark, values, kind, digits):
    df = spark.createDataFrame([(v,) for v in values], f"x {kind}")
    out = {"r": ("x", "rank"), "p": ("x", "percent_rank"), "d": ("x", "desc_rank")}
    rows = ranking.with_positions(df, out, digits).collect()
    return sorted(((r["x"], r["r"], r["d"], r["p"]) for r in rows), key=lambda t: (t[1], str(t)))


def test_values_off_the_grid_end_the_query(spark):
    with pytest.raises(Exception, match="more than 1 decimals"):
        ranks(spark, [0.11, 0.12, 0.13], "double", 1)


def test_large_and_odd_doubles(spark):
    found = ranks(spark, [2e18, 1.5, float("nan"), math.inf, -math.inf, None, 2e18], "double", 2)
    assert [r for _, r, *_ in found] == [1, 2, 3, 4, 4, 6, 7]
    assert found[0][0] is None and found[1][0] == -math.inf and math.isnan(found[6][0])


def test_neighbours_beyond_doubles(spark):
    low = 2**53
    assert [r for _, r, *_ in ranks(spark, [low, low + 1, low - 1], "bigint", 0)] == [1, 2, 3]
    money = spark.createDataFrame([(low, 1), (low + 1, 1), (5, 2)], "amount bigint, period int")
    cuts = ranking.percent_rank_floor(money, "amount", "period", 0.5).collect()
    assert {r["period"]: int(r["cut"]) for r in cuts} == {1: low + 1}


def test_repeated_rows_keep_their_number(spark):
    assert [t[1:3] for t in ranks(spark, [1.0, 1.0, 2.0], "double", 0)] == [(1, 2), (1, 2), (3, 1)]


def test_several_columns_rank_like_windows(spark):
    rows = [(i % 7 / 10, i % 5 / 10 if i % 4 else None, i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "a double, b double, g int")
    out = {"pa": ("a", "percent_rank"), "pb": ("b", "percent_rank"), "rb": ("b", "rank")}
    found = sorted(map(str, ranking.with_positions(df, out, 1, ["g"]).collect()))
    df.createOrReplaceTempView("limits")
    over = "over (partition by g order by"
    plain = spark.sql(
        f"select *, percent_rank() {over} a) pa, percent_rank() {over} b) pb, rank() {over} b) rb from limits"
    )
    assert found == sorted(map(str, plain.collect()))


def test_rounding_beyond_a_decimal(spark):
    values = [1e18, 1.005e17, 3e30, -2.5e25, 1.005, 24.95, math.inf, None]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    found = [r[0] for r in df.select(round_half_up("x", 1)).collect()]
    assert found == [1e18, 1.005e17, 3e30, -2.5e25, 1.0, 25.0, math.inf, None]


def test_money_in_both_modes(spark):
    stats = spark.createDataFrame(
        [("a", 2021, "X", "SF", 25, 50, 500, 100, 100, 10, 10, 10)],
        "Player string, Season int, Tm string, Pos string, Age int, G int, PTS int, AST int,"
        " TRB int, STL int, BLK int, TOV int",
    )
    money = spark.createDataFrame(
        [("a", 2021, "$4,250,000.50")], "playerName string, seasonStartYear int, salary string"
    )
    assert [r[0] for r in money.select(parse_money("salary", True)).collect()] == [4_250_000]
    assert clean.count_bad_money(money, MONEY).first()["bad_rows"] == 1
    for make in (value.value_per_cost, value.cost_per_unit, value.idle_cost):
        floor = {} if make is value.value_per_cost else {"min_amount": 1000}
        strict = make(stats, money, **floor).collect()
        lenient = make(stats, money, **floor, lenient=True).collect()
        assert [r["salary_millions"] for r in lenient] == [4.25]
        assert [r["salary_millions"] for r in strict] in ([], [None])


@pytest.mark.parametrize("method", ["window", "anti_join"])
def test_rows_without_a_key_all_stay(spark, method):
    rows = [(None, 2021, "TOT", i) for i in range(500)] + [(None, 2021, "X", i) for i in range(500)]
    rows += [("a", 2021, "TOT", 1), ("a", 2021, "X", 1), ("b", 2021, "X", 2), ("c", None, "X", 3)]
    stats = spark.createDataFrame(rows, "Player string, Season int, Tm string, PTS int")
    kept = clean.clean_stats(stats, method=method)
    assert kept.where("Player is null").count() == 1000
    assert {(r[0], r[2]) for r in kept.where("Player is not null").collect()} == {
        ("a", "TOT"), ("b", "X"), ("c", "X")
    }


def test_pairs_of_periods_are_those_of_the_join(spark):
    rows = [("a", y, t, 50, p) for y in (2020, 2021) for t, p in (("X", 100), ("Y", 333))]
    stats = spark.createDataFrame(rows, "Player string, Season int, Tm string, G int, PTS int")
    found = trends.period_delta(stats, 2020, 2021, k=None).collect()
    assert sorted((r["PPG_2020"], r["PPG_2021"]) for r in found) == [
        (2.0, 2.0), (2.0, 6.7), (6.7, 2.0), (6.7, 6.7)
    ]


def test_best_match_is_that_of_all_pairs(spark):
    import random
    from difflib import SequenceMatcher

    rng = random.Random(3)
    known = sorted({"".join(rng.choice("abcde ") for _ in range(rng.randint(1, 9))) for _ in range(90)})
    typed = sorted({"".join(rng.choice("abcde ") for _ in range(rng.randint(1, 9))) for _ in range(90)})
    dim = spark.createDataFrame([(k, k) for k in known], "norm_key string, name string")
    keys = spark.createDataFrame([(t,) for t in typed], "typed_key string")
    for method in ("edit", "ratio"):
        found = {
            r["typed_key"]: (round(r["best_score"], 9), r["best_name"])
            for r in names.best_matches(keys, dim, method, 0.6).collect()
        }
        if method == "ratio":
            score = lambda k, t: SequenceMatcher(None, k, t).ratio()
        else:
            pairs = dim.join(keys, F.lit(True)).select(
                "norm_key", "typed_key", F.levenshtein("norm_key", "typed_key").alias("d")
            )
            edits = {(r[0], r[1]): r[2] for r in pairs.collect()}
            score = lambda k, t: 1 - edits[k, t] / max(len(k), len(t))
        expected = {}
        for t in typed:
            best = max((round(score(k, t), 9), k) for k in known)
            if best[0] >= 0.6:
                expected[t] = best
        assert found == expected


def test_near_names_meet_in_few_rows(spark):
    dim = spark.createDataFrame(
        [(f"name {i * 7919 % 100003:05d} of {i * 104729 % 99991:05d}",) for i in range(1500)],
        "norm_key string",
    ).withColumn("name", F.col("norm_key"))
    keys = dim.select(F.expr("concat(substr(norm_key, 1, 6), substr(norm_key, 8))").alias("typed_key"))
    assert names.near_join(keys, dim).count() < 0.2 * 1500 * 1500


@pytest.mark.parametrize("n", [400, 1600])
def test_numbered_names_meet_in_few_rows(spark, n):
    """Names that are the same but for a number, as those of the customers' table."""
    dim = spark.range(n).selectExpr("format_string('customer#%09d', id * 37) as norm_key")
    dim = dim.withColumn("name", F.col("norm_key"))
    keys = dim.selectExpr("concat(norm_key, '~') as typed_key")
    assert names.near_join(keys, dim, 1).count() <= 3 * n
    assert names.near_join(keys, dim, 2).count() < 0.06 * n * n


def test_long_names_have_few_rows(spark):
    """The trees' first level: rows of a typed name of 40 letters, before any meets another."""
    import random

    rng = random.Random(4)
    longer = ["".join(rng.choice("etaoin shrdlu") for _ in range(40)) for _ in range(50)]
    dim = spark.createDataFrame([(n, n) for n in longer], "norm_key string, name string")
    classes = names.letter_classes(dim)
    assert sorted("".join(classes)) == sorted(set("".join(longer)))
    counted = names._counted(dim, "norm_key", "k", classes)
    per_name = counted.selectExpr("k_len", " + ".join(f"k{i}" for i in range(len(classes))) + " as n")
    assert all(r["k_len"] == r["n"] == 40 for r in per_name.collect())
    for edits, most in ((1, 2 * 40 + 2), (2, 40 * 39 + 2 * 40 + 1)):
        texts = dim.select(F.size(F.expr(names._neighbourhood("norm_key", edits, False))).alias("n"))
        assert texts.agg(F.max("n")).first()[0] <= most
    for cutoff in (0.6, 0.9):
        longest = int(40 * (2 - cutoff) / cutoff + 1e-9)
        assert longest - 40 * cutoff / (2 - cutoff) < 500


@pytest.mark.parametrize("cutoff", [0.6, 0.9])
def test_no_pair_within_a_few_edits_is_lost(spark, cutoff):
    import random

    rng = random.Random(9)
    known = ["".join(rng.choice("ab1 ") for _ in range(rng.randint(1, 7))).strip() for _ in range(120)]
    known = sorted({k for k in known if k})
    typed = sorted({k[: rng.randint(0, len(k))] + rng.choice(["", "a", "1b"]) + k[1:] for k in known})
    dim = spark.createDataFrame([(k, k) for k in known], "norm_key string, name string")
    keys = spark.createDataFrame([(t,) for t in typed], "typed_key string")
    both = keys.where("typed_key <> ''").join(dim, F.lit(True))
    for edits in (1, 2):
        met = names.near_join(keys, dim, edits).select("typed_key", "norm_key").distinct()
        near = both.where(F.levenshtein("typed_key", "norm_key") <= edits)
        assert near.select("typed_key", "norm_key").exceptAll(met).count() == 0
    score = 1 - F.levenshtein("typed_key", "norm_key") / F.greatest(
        F.length("typed_key"), F.length("norm_key")
    )
    best = both.withColumn("s", score).where(F.col("s") >= cutoff).groupBy("typed_key").agg(
        F.max(F.struct("s", "norm_key")).alias("b")
    )
    want = {r["typed_key"]: r["b"]["norm_key"] for r in best.collect()}
    got = names.best_matches(keys, dim, "edit", cutoff).collect()
    assert {r["typed_key"]: r["best_name"] for r in got} == want


def test_names_without_letters(spark):
    dim = spark.createDataFrame([("", "é"), ("a", "a")], "norm_key string, name string")
    keys = spark.createDataFrame([("",), ("b",)], "typed_key string")
    got = names.best_matches(keys, dim, "ratio", 0.6).collect()
    assert got == []
    none = spark.createDataFrame([], "typed_key string")
    assert names.best_matches(none, dim, "ratio", 0.6).collect() == []
    assert names.best_matches(keys, dim.limit(0), "edit", 0.6).collect() == []
