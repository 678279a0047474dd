"""Column expressions: numbers, text and display labels."""

from periodica.functions.labels import (
    amount_label,
    entity_period_label,
    last_word,
    over_flag,
    positive_lag,
    ratio_label,
    signed_label,
)
from periodica.functions.numeric import (
    combine_terms,
    composite,
    rate,
    round_half_up,
    tier,
)
from periodica.functions.text import normalize_name, parse_money, primary_token, sequence_ratio

__all__ = [
    "amount_label",
    "combine_terms",
    "composite",
    "entity_period_label",
    "last_word",
    "normalize_name",
    "over_flag",
    "parse_money",
    "positive_lag",
    "primary_token",
    "rate",
    "ratio_label",
    "round_half_up",
    "sequence_ratio",
    "signed_label",
    "tier",
]
