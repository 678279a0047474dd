"""Small literal tables, one per trap."""

from __future__ import annotations

import random
from difflib import SequenceMatcher, get_close_matches

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from periodica.functions import (
    amount_label,
    composite,
    normalize_name,
    parse_money,
    positive_lag,
    primary_token,
    rate,
    ratio_label,
    round_half_up,
    signed_label,
    tier,
)
from periodica.layout import DetailLayout
from periodica.operators import clean, names, ranking, trends, value
from periodica.plans.presets import LEAGUE
from periodica.sources import load
from periodica.sources.schemas import LOGICAL

STATS = (
    "Player string, Season int, Tm string, Pos string, Age int, G double, PTS double, "
    "AST double, TRB double, STL double, BLK double, TOV double"
)
MONEY = "playerName string, seasonStartYear int, salary string"


def stat(player, season, tm, g, pts, pos="C", age=25, ast=0.0, trb=0.0, stl=0.0, blk=0.0, tov=0.0):
    return (player, season, tm, pos, age, g, pts, ast, trb, stl, blk, tov)


def rows(df, *columns):
    return [tuple(r) for r in (df.select(*columns) if columns else df).collect()]


@pytest.mark.parametrize("method", ["window", "anti_join"])
def test_combined_rows_replace_their_parts(spark, method):
    stats = spark.createDataFrame(
        [("a", 2021, "TOT", 10), ("a", 2021, "X", 4), ("a", 2021, "Y", 6), ("b", 2021, "Z", 5)],
        "Player string, Season int, Tm string, G int",
    )
    kept = rows(clean.clean_stats(stats, method=method), "Player", "Tm")
    assert sorted(kept) == [("a", "TOT"), ("b", "Z")]


@pytest.mark.parametrize("method", ["window", "anti_join"])
def test_two_combined_rows_null_keys_and_null_groups_stay(spark, method):
    stats = spark.createDataFrame(
        [
            ("a", 2021, "TOT"),
            ("a", 2021, "TOT"),
            ("a", 2021, "X"),
            (None, 2021, "TOT"),
            (None, 2021, "X"),
            ("c", 2021, None),
        ],
        "Player string, Season int, Tm string",
    )
    kept = rows(clean.clean_stats(stats, method=method))
    assert sorted(kept, key=repr) == sorted(
        [
            ("a", 2021, "TOT"),
            ("a", 2021, "TOT"),
            (None, 2021, "TOT"),
            (None, 2021, "X"),
            ("c", 2021, None),
        ],
        key=repr,
    )


def test_money_parse_merges_and_counts_bad_text(spark):
    texts = ["$4,250,000", "$4250000", "", "n/a", None, "12abc", "12.5"]
    money = spark.createDataFrame([("p", 2021, t) for t in texts], MONEY)
    assert sorted(rows(clean.clean_money(money), "salary_int"), key=repr) == [(4250000,), (None,)]
    assert rows(clean.count_bad_money(money)) == [(7, 5)]
    lenient = rows(money.select(parse_money("salary", lenient=True)))
    assert [r[0] for r in lenient] == [4250000, 4250000, 0, 0, None, 12, 12]


def test_two_amounts_give_two_rows(spark):
    stats = spark.createDataFrame([stat("a", 2021, "X", 50.0, 500.0)], STATS)
    money = spark.createDataFrame(
        [("a", 2021, "$2,000,000"), ("a", 2021, "$3,000,000"), ("a", 2021, "$3,000,000")], MONEY
    )
    paid = value.value_per_cost(stats, money)
    assert rows(paid, "salary_millions", "ppg_per_million") == [(2.0, 5.0), (3.0, 3.33)]


def test_rate_without_units_is_null(spark):
    df = spark.createDataFrame([(10.0, 0.0), (10.0, None), (7.0, 2.0)], "a double, b double")
    assert [r[0] for r in rows(df.select(rate("a", "b")))] == [None, None, 3.5]


def test_rounding_goes_half_up(spark):
    cases = [(1.005, 2, 1.01), (0.285, 2, 0.29), (2.675, 2, 2.68), (24.95, 1, 25.0), (-0.25, 1, -0.3)]
    for x, digits, want in cases:
        df = spark.range(1).select(round_half_up(F.lit(x), digits).alias("x"))
        assert df.first()["x"] == want


def test_percent_rank_with_ties_and_null(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (3.0,), (None,)], "v double")
    ranked = ranking.with_positions(
        df,
        {"pr": ("v", "percent_rank"), "up": ("v", "rank"), "down": ("v", "desc_rank")},
        digits=1,
    )
    assert sorted(rows(ranked), key=repr) == sorted(
        [(1.0, 0.25, 2, 4), (2.0, 0.5, 3, 2), (2.0, 0.5, 3, 2), (3.0, 1.0, 5, 1), (None, 0.0, 1, 5)],
        key=repr,
    )


def test_positions_equal_windows_across_buckets(spark):
    rng = random.Random(7)
    data = [
        (rng.choice("ab"), rng.choice([None, 5e6, rng.uniform(-3e6, 3e6), round(rng.uniform(0, 9), 1)]))
        for _ in range(400)
    ]
    df = spark.createDataFrame(data, "g string, v double").withColumn(
        "v", round_half_up("v", 1)
    )
    up = Window.partitionBy("g").orderBy(F.asc_nulls_first("v"))
    down = Window.partitionBy("g").orderBy(F.desc_nulls_last("v"))
    want = df.select(
        "g", "v", F.percent_rank().over(up), F.rank().over(up).cast("bigint"),
        F.rank().over(down).cast("bigint"),
    )
    got = ranking.with_positions(
        df,
        {"p": ("v", "percent_rank"), "u": ("v", "rank"), "d": ("v", "desc_rank")},
        digits=1,
        within=["g"],
    )
    assert sorted(rows(got), key=repr) == sorted(rows(want), key=repr)


def test_several_columns_at_once(spark):
    df = spark.createDataFrame([(1.0, 30.0), (2.0, 20.0), (2.0, 10.0)], "a double, b double")
    ranked = ranking.with_positions(df, {"ra": ("a", "rank"), "rb": ("b", "rank")}, digits=0)
    assert sorted(rows(ranked)) == [(1.0, 30.0, 1, 3), (2.0, 10.0, 2, 1), (2.0, 20.0, 2, 2)]


def test_primary_token(spark):
    df = spark.createDataFrame([("SF-PF",), ("C",), ("",), (None,)], "p string")
    assert [r[0] for r in rows(df.select(primary_token("p")))] == ["SF", "C", "", None]


def test_ties_at_the_third_place_all_stay(spark):
    data = [stat(n, 2022, "X", 10.0, p) for n, p in zip("abcde", [9.0, 8.0, 7.0, 7.0, 7.0], strict=True)]
    stats = spark.createDataFrame([*data, stat("f", 2022, "X", 10.0, 1.0)], STATS)
    best = trends.leaders_by_group(stats, 2022)
    assert rows(best, "team_total_pts", "team_ranking", "Player") == [
        (39.0, 1, "a"), (39.0, 2, "b"), (39.0, 3, "c"), (39.0, 3, "d"), (39.0, 3, "e"),
    ]


def test_peak_lies_inside_the_age_range(spark):
    stats = spark.createDataFrame(
        [stat(f"p{a}", 2021, "X", 50.0, 50.0 * a, age=a) for a in (18, 19, 38, 39)], STATS
    )
    money = spark.createDataFrame([(f"p{a}", 2021, f"${a},000,000") for a in (18, 19, 38, 39)], MONEY)
    curve = value.peak_index(stats, money)
    assert rows(curve, "Age", "prod_index", "salary_index") == [(19, 50.0, 50.0), (38, 100.0, 100.0)]
    assert rows(value.peaks(curve)) == [(38, 38, None)]


def test_first_of_tied_peaks_and_lag(spark):
    curve = spark.createDataFrame(
        [(20, 100.0, 50.0), (21, 100.0, 100.0), (22, 90.0, 100.0)],
        "Age int, prod_index double, salary_index double",
    )
    assert rows(value.peaks(curve)) == [(20, 21, 1)]
    assert spark.range(1).select(positive_lag(F.lit(1), F.lit(2))).first()[0] is None


def test_a_lone_amount_is_below_the_median(spark):
    stats = spark.createDataFrame(
        [stat(p, s, "X", 41.0, 1.0) for p, s in [("a", 2020), ("a", 2021), ("b", 2021)]], STATS
    )
    money = spark.createDataFrame(
        [("a", 2020, "$9"), ("a", 2021, "$5"), ("b", 2021, "$7")], MONEY
    )
    assert rows(value.availability_trend(stats, money)) == [(2021, 1, 0.5)]


def test_null_amounts_and_names_count_in_the_percent_rank(spark):
    stats = spark.createDataFrame([stat(p, 2021, "X", 82.0, 1.0) for p in "abc"], STATS)
    money = spark.createDataFrame(
        [("a", 2021, "bad"), ("b", 2021, "$5"), ("c", 2021, "$6"), (None, 2021, "$7"), ("a", None, "$1")],
        MONEY,
    )
    # ranks of the period: NULL 0, 5 -> 1/3, 6 -> 2/3, 7 -> 1
    assert rows(value.availability_trend(stats, money)) == [(2021, 1, 1.0)]


def test_missing_term_drops_the_composite(spark):
    stats = spark.createDataFrame(
        [stat("a", 2021, "X", 50.0, 100.0, blk=None), stat("b", 2021, "X", 50.0, 100.0, tov=50.0)],
        STATS,
    )
    score = composite(value.SCORE_PLUS, value.SCORE_MINUS, "G")
    assert rows(stats.select("Player", score)) == [("a", None), ("b", 1.0)]
    money = spark.createDataFrame([("a", 2021, "$2,000,000"), ("b", 2021, "$2,000,000")], MONEY)
    assert rows(value.cost_per_unit(stats, money), "Player", "cost_per_unit") == [("b", 2.0)]


def test_consistency_centres_on_the_rounded_rate(spark):
    stats = spark.createDataFrame([stat("a", 2022, "X", 40.0, 612.0)], STATS)  # 15.3 a game
    games = [("a", "X", 2022, 10.0), ("a", "X", 2022, 20.0), ("a", "X", 2021, 99.0)]
    detail = spark.createDataFrame(games, "PLAYER_NAME string, Team string, Season int, PTS double")
    want = [("a", "X", 40.0, 15.3, 5.0)]  # sqrt((5.3^2 + 4.7^2) / 2) = 5.009
    assert rows(trends.consistency(stats, detail, 2022)) == want
    counted = detail.groupBy(*detail.columns).agg(F.count(F.lit(1)).alias("games"))
    layout = DetailLayout(weight="games")
    assert rows(trends.consistency(stats, counted, 2022, detail_layout=layout)) == want


def test_threshold_on_the_rounded_or_the_raw_rate(spark):
    stats = spark.createDataFrame(
        [stat("a", 2022, "X", 100.0, 2496.0, ast=800.0), stat("b", 2022, "X", 100.0, 2494.0, ast=800.0)],
        STATS,
    )
    floors = LEAGUE.dual_floors
    assert rows(trends.dual_threshold(stats, floors), "Player", "PPG") == [("a", 25.0)]
    assert rows(trends.dual_threshold(stats, floors, round_before=False)) == []


def test_short_debut_disqualifies(spark):
    stats = spark.createDataFrame(
        [
            stat("a", 1960, "X", 10.0, 400.0),
            stat("a", 1961, "X", 70.0, 2800.0),
            stat("b", 1960, "X", 70.0, 700.0),
            stat("c", 1961, "X", 70.0, 1400.0),
            stat("d", 1961, "X", 70.0, 1400.0),
            stat(None, 1961, "X", 70.0, 9000.0),
        ],
        STATS,
    )
    assert rows(trends.top_debut(stats), "Player", "Season", "PPG") == [
        ("b", 1960, 10.0), ("c", 1961, 20.0), ("d", 1961, 20.0),
    ]


def test_period_delta_pairs_like_a_join(spark):
    stats = spark.createDataFrame(
        [
            stat("a", 2021, "X", 50.0, 500.0),
            stat("a", 2022, "X", 50.0, 1000.0),
            stat("twin", 2021, "X", 50.0, 100.0),
            stat("twin", 2021, "Y", 50.0, 200.0),
            stat("twin", 2022, "Z", 50.0, 300.0),
            stat("new", 2022, "Z", 50.0, 300.0),
            stat(None, 2021, "X", 50.0, 1.0),
            stat(None, 2022, "X", 50.0, 1.0),
        ],
        STATS,
    )
    delta = trends.period_delta(stats, 2021, 2022, k=None)
    assert rows(delta) == [
        ("a", "X", 10.0, 20.0, 10.0), ("twin", "Z", 2.0, 6.0, 4.0), ("twin", "Z", 4.0, 6.0, 2.0),
    ]


def test_tiers_and_share(spark):
    data = [stat(f"p{i}", 2022, "X", 10.0, 10.0 * r) for i, r in enumerate([26, 25, 19, 3, None])
            if r is not None]
    stats = spark.createDataFrame([*data, stat("n", 2022, "X", 10.0, None)], STATS)
    counted = trends.tier_distribution(stats, LEAGUE.tiers, LEAGUE.lowest_tier, 2022)
    assert rows(trends.with_share(counted, "num_players")) == [
        ("Elite (25+)", 2, 40.0), ("Starter (15-19)", 1, 20.0), ("Bench (< 10)", 2, 40.0),
    ]
    assert spark.range(1).select(tier(F.lit(20.0), LEAGUE.tiers, "low")).first()[0] == "Star (20-24)"


def test_sustained(spark):
    stats = spark.createDataFrame(
        [stat("a", 2000 + i, "X", 10.0, 200.0 + i) for i in range(5)]
        + [stat("b", 2000 + i, "X", 10.0, 200.0 - i) for i in range(5)],
        STATS,
    )
    assert rows(trends.sustained(stats)) == [("a", 5, 20.2)]


def test_idle_cost(spark):
    stats = spark.createDataFrame(
        [stat("a", 2021, "X", 41.0, 1.0), stat("b", 2021, "X", 82.0, 1.0), stat("c", 2021, "X", 0.0, 1.0)],
        STATS,
    )
    money = spark.createDataFrame([(p, 2021, "$10,000,000") for p in "abc"], MONEY)
    idle = value.idle_cost(stats, money)
    assert rows(idle) == [
        ("c", 2021, 0.0, 0.0, 10.0, None, 10.0), ("a", 2021, 41.0, 0.5, 10.0, 0.244, 5.0),
    ]
    assert rows(value.idle_cost(stats, money, whole_units="Games"), "Games") == [(0,), (41,)]


def test_extremes_are_each_listed_once(spark):
    df = spark.createDataFrame([(f"n{i}", float(i)) for i in range(4)] + [("x", None)], "n string, v double")
    both = ranking.extremes(df, "v", 3, 2, ["n"], best_is_high=False)
    assert sorted(rows(both)) == [("n0", 0.0), ("n1", 1.0), ("n2", 2.0), ("n3", 3.0)]


def test_extremes_leave_out_nulls_and_list_repeated_rows_once(spark):
    df = spark.createDataFrame(
        [("x", None, 1), ("a", 1.0, 2), ("b", 2.0, 3), ("b", 2.0, 3)],
        "n string, v double, __row int",
    )
    high = ranking.extremes(df, "v", 5, 2, ["n"])
    assert sorted(rows(high, "n", "__row")) == [("a", 2), ("b", 3), ("x", 1)]
    low = ranking.extremes(df, "v", 1, 1, ["n"], best_is_high=False)
    assert sorted(rows(low, "n")) == [("a",), ("b",)]
    assert rows(ranking.extremes(df.limit(0), "v", 1, 1, ["n"])) == []


@pytest.mark.parametrize("method", ["window", "anti_join"])
def test_preferred_rows_keep_columns_named_like_helpers(spark, method):
    df = spark.createDataFrame(
        [("a", "TOT", 1, True), ("a", "X", 2, False), ("b", "X", 3, False), (None, "TOT", 4, None),
         (None, "X", 5, None)],
        "k string, Tm string, __at int, __keep boolean",
    )
    kept = clean.prefer_rows(df, ["k"], F.col("Tm") == "TOT", method)
    assert kept.columns == df.columns
    assert sorted(rows(kept, "__at", "__keep")) == [(1, True), (3, False), (4, None), (5, None)]


def test_ranked_rows_keep_columns_named_like_helpers(spark):
    df = spark.createDataFrame([(1, 7, "r"), (2, 8, "s"), (2, 8, "s")], "v int, __times int, __row string")
    ranked = ranking.with_positions(df, {"place": ("v", "rank")}, digits=0)
    assert sorted(rows(ranked)) == [(1, 7, "r", 1), (2, 8, "s", 2), (2, 8, "s", 2)]


def test_availability_counts_each_amount_once_and_null_amounts_lowest(spark):
    stats = spark.createDataFrame(
        [stat("a", 2021, "X", 41.0, 1.0), stat("a", 2021, "Y", 82.0, 1.0), stat("b", 2021, "X", 20.5, 1.0),
         stat("d", 2021, "X", 82.0, 1.0)],
        STATS,
    )
    # ranks of 2021: NULL 0, b 1/3, c 2/3, a 1; c has money only, d has no amount; 2022 has no stats
    money = spark.createDataFrame(
        [("a", 2021, "$9"), ("b", 2021, "$5"), ("c", 2021, "$7"), ("d", 2021, "none"), ("a", 2022, "$9"),
         ("a", None, "$9")],
        MONEY,
    )
    assert rows(value.availability_trend(stats, money, floor=0.3)) == [(2021, 3, 0.583)]
    assert rows(value.availability_trend(stats, money, floor=0.5)) == [(2021, 2, 0.75)]
    assert rows(value.availability_trend(stats, money.limit(0))) == []


def test_share_premium_shares_add_up(spark):
    stats = spark.createDataFrame(
        [stat("a", 2021, "X", 50.0, 500.0, pos="C-PF"), stat("b", 2021, "X", 50.0, 1500.0, pos="PG")],
        STATS,
    )
    money = spark.createDataFrame([("a", 2021, "$2,000,000"), ("b", 2021, "$2,000,000")], MONEY)
    premium = rows(value.share_premium(stats, money), "position", "position_premium")
    assert premium == [("C", 2.0), ("PG", 0.67)]


def test_labels(spark):
    amounts = [519.25, 553.65, 0.05, 0.15, 0.25, 0.75, 12.34, 1.0, 41.85, 519.35]
    df = spark.createDataFrame([(a, 3) for a in amounts], "m double, g int")
    texts = [r[0] for r in rows(df.select(amount_label("m", "g")))]
    assert texts == [f"${a:.1f}M  (3 Games)" for a in amounts]
    df = spark.createDataFrame([(1.5, 2)], "p double, n bigint")
    assert rows(df.select(ratio_label("p", "n"), signed_label("p"))) == [("1.50\n(n=2)", "+1.5")]


NAMES = ["Luka Dončić", "LeBron James", "Nikola Jokić", "Nikola Jović", "Bogdan Bogdanović", "Ömer Aşık"]


def test_exact_suggested_unmatched(spark):
    dim = names.name_dimension(spark.createDataFrame([(n,) for n in NAMES], "p string"), "p")
    raw = spark.createDataFrame([("luka doncic",), ("lebron jmes",), ("zzzz",), (None,)], "raw string")
    for method in ("ratio", "edit"):
        got = {r["raw"]: (r["match"], r["status"]) for r in names.resolve(raw, "raw", dim, method).collect()}
        assert got == {
            "luka doncic": ("Luka Dončić", "exact"),
            "lebron jmes": ("LeBron James", "suggested"),
            "zzzz": (None, "unmatched"),
            None: (None, "unmatched"),
        }


def test_normalize(spark):
    df = spark.createDataFrame([("Luka Dončić",), ("Øyvind Łódź",), (None,)], "n string")
    assert [r[0] for r in rows(df.select(normalize_name("n")))] == ["luka doncic", "yvind odz", None]


def test_last_name_in_order_wins(spark):
    df = spark.createDataFrame([("JOSE", 2), ("José", 1), ("Ann", 3)], "p string, o int")
    by_order = names.name_dimension(df, "p", order=F.col("o"))
    assert sorted(rows(by_order, "norm_key", "name")) == [("ann", "Ann"), ("jose", "JOSE")]


def _typo(rng, name):
    chars = list(name)
    for _ in range(rng.randint(0, 4)):
        i = rng.randrange(len(chars))
        kind = rng.choice(["drop", "swap", "double", "change"])
        if kind == "drop" and len(chars) > 2:
            del chars[i]
        elif kind == "double":
            chars.insert(i, chars[i])
        elif kind == "swap" and i + 1 < len(chars):
            chars[i], chars[i + 1] = chars[i + 1], chars[i]
        else:
            chars[i] = rng.choice("abcdefghij klmnop-")
    return "".join(chars)


def _edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_no_close_match_is_lost(spark):
    """All of the dimension is compared here, by the standard library and by a plain edit distance."""
    rng = random.Random(11)
    known = sorted(
        {
            "".join(rng.choice("abcdeiklmnorstu") for _ in range(rng.randint(1, 12)))
            + rng.choice(["", " " + "".join(rng.choice("aeionrst") for _ in range(rng.randint(1, 9)))])
            for _ in range(150)
        }
    )
    typed = sorted({_typo(rng, n) for n in known} | {"a", "zzzz", "aaaaaaaaaaaaaaaaaaaaaaaa"})
    dim = names.name_dimension(spark.createDataFrame([(n,) for n in known], "p string"), "p")
    raw = spark.createDataFrame([(t,) for t in typed], "raw string")

    got = {r["raw"]: r["match"] for r in names.resolve(raw, "raw", dim, "ratio").collect()}
    want = {}
    for t in typed:
        close = get_close_matches(t, known, n=1, cutoff=0.6)
        want[t] = t if t in known else close[0] if close else None
    assert got == want

    got = {r["raw"]: r["match"] for r in names.resolve(raw, "raw", dim, "edit").collect()}
    for t in typed:
        score, best = max((1 - _edit(t, n) / max(len(t), len(n)), n) for n in known)
        want[t] = t if t in known else best if score >= 0.6 else None
    assert got == want


def test_ratio_is_the_library_ratio(spark):
    from periodica.functions import sequence_ratio

    pairs = [("lebron james", "lebron jmes"), ("abcd", "bcde"), ("", "")]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = [r[0] for r in rows(df.select(sequence_ratio("a", "b")))]
    assert got == [SequenceMatcher(None, a, b).ratio() for a, b in pairs]


def test_split_list(spark):
    df = spark.createDataFrame([(1, " a b ,c,, d")], "id int, l string")
    assert rows(names.split_list(df, "l")) == [(1, 0, "a b"), (1, 1, "c"), (1, 2, ""), (1, 3, "d")]


def test_career_of_resolved_names(spark):
    stats = spark.createDataFrame(
        [stat("a", 2021, "X", 10.0, 105.0), stat("a", 2020, "X", 10.0, 50.0), stat("b", 2021, "X", 1.0, 1.0)],
        STATS,
    )
    wanted = spark.createDataFrame([("a",), ("a",)], "Player string")
    career = trends.career_progression(stats, wanted)
    assert rows(career, "Player", "Season", "PPG") == [("a", 2020, 5.0), ("a", 2021, 10.5)]


def test_csv_load_drops_artifacts_and_types_by_name(spark, tmp_path):
    source = tmp_path / "salaries.csv"
    source.write_text(
        ",Unnamed: 0,salary,playerName,seasonStartYear,inflationAdjSalary,note\n"
        '0,0,"$4,250,000",Ann,2021,"$5,000,000",x\n'
        '1,1,"$1","Bo ""B"" Li",not a year,,\n'
    )
    loaded = load.load_tables(spark, {"salaries": str(source)}, str(tmp_path / "t"), LOGICAL)
    table = loaded["salaries"]
    assert table.columns == ["salary", "playerName", "seasonStartYear", "inflationAdjSalary", "note"]
    assert sorted(rows(table), key=repr) == [
        ("$1", 'Bo "B" Li', None, None, None),
        ("$4,250,000", "Ann", 2021, "$5,000,000", "x"),
    ]
    assert rows(load.profile(loaded), "table_name", "n_rows", "n_columns") == [("salaries", 2, 5)]
    load.register_views(loaded)
    assert "salaries" in load.list_tables(spark)
    total = spark.sql("select count(*) from salaries where seasonStartYear = 2021")
    assert total.first()[0] == 1


def test_csv_without_a_declared_column_is_refused(spark, tmp_path):
    (tmp_path / "salaries.csv").write_text("playerName\nAnn\n")
    with pytest.raises(ValueError, match="inflationAdjSalary"):
        load.read_csv(spark, str(tmp_path / "salaries.csv"), LOGICAL["salaries"])


def test_loading_again_replaces(spark, tmp_path):
    source, target = tmp_path / "payroll.csv", str(tmp_path / "t")
    for text in ("team,payroll\nX,$1\nY,$2\n", "team,payroll\nZ,$3\n"):
        source.write_text(text)
        loaded = load.load_tables(spark, {"payroll": str(source)}, target, LOGICAL)
    assert rows(loaded["payroll"]) == [("Z", "$3")]
