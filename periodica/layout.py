"""Column roles of the logical tables, so that every operator works on any naming."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class StatLayout:
    """Who, when, where and over how many units a row of totals was collected."""

    entity: str = "Player"
    period: str = "Season"
    group: str = "Tm"
    units: str = "G"
    total: str = "PTS"
    #: group label of a row that already combines all groups of an entity-period
    combined: str = "TOT"

    @property
    def key(self) -> list[str]:
        return [self.entity, self.period]


@dataclass(frozen=True)
class MoneyLayout:
    """Money table: one text amount per entity and period."""

    entity: str = "playerName"
    period: str = "seasonStartYear"
    amount: str = "salary"
    unit: float = 1_000_000.0


@dataclass(frozen=True)
class DetailLayout:
    """Event-level table behind the totals; ``weight`` holds a row's multiplicity, if any."""

    entity: str = "PLAYER_NAME"
    period: str = "Season"
    group: str = "Team"
    value: str = "PTS"
    weight: str | None = None


STATS = StatLayout()
MONEY = MoneyLayout()
DETAIL = DetailLayout()
