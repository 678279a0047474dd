"""Thresholds of the named analyses."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from periodica.layout import MONEY, MoneyLayout


@dataclass(frozen=True)
class Preset:
    """Defaults are those of an 82-game league; all are parameters of the operators."""

    season: int = 2022
    previous_season: int = 2021
    money_season: int = 2021
    any_sample: int = 1
    small_sample: int = 20
    half_sample: int = 41
    consistency_sample: int = 40
    season_length: int = 82
    floor_amount: float = 1_000_000
    high_amount: float = 5_000_000
    dual_floors: Mapping[str, tuple[str, float]] = field(
        default_factory=lambda: {"PPG": ("PTS", 25), "APG": ("AST", 7)}
    )
    sustained_rate: float = 20
    sustained_periods: int = 5
    # fixed values: floors and labels of the tiers
    tiers: Sequence[tuple[float, str]] = (
        (25, "Elite (25+)"),
        (20, "Star (20-24)"),
        (15, "Starter (15-19)"),
        (10, "Role Player (10-14)"),
    )
    lowest_tier: str = "Bench (< 10)"
    debut_from: int = 1953
    consistency_rate: float = 15
    streak_floor: float = 20
    significant: float = 2.0
    lowest_age: int = 19
    highest_age: int = 38
    money: MoneyLayout = MONEY
    adjusted_money: MoneyLayout = MoneyLayout(amount="inflationAdjSalary")


LEAGUE = Preset()

#: the same analyses scaled to customers, order years and line items
ORDERS = Preset(
    season=2000,
    previous_season=1999,
    money_season=2000,
    any_sample=1,
    small_sample=4,
    half_sample=8,
    consistency_sample=8,
    season_length=20,
    floor_amount=100_000,
    high_amount=250_000,
    dual_floors={"PPG": ("PTS", 30), "APG": ("AST", 3)},
    sustained_rate=25,
    sustained_periods=5,
    tiers=(
        (35, "Elite (35+)"),
        (30, "Star (30-34)"),
        (25, "Starter (25-29)"),
        (20, "Role Player (20-24)"),
    ),
    lowest_tier="Bench (< 20)",
    debut_from=1996,
    consistency_rate=20,
    money=MoneyLayout(unit=1_000.0),
    adjusted_money=MoneyLayout(amount="inflationAdjSalary", unit=1_000.0),
)
