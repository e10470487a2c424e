"""Interest weights of event types."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Weights:
    by_type: Mapping[str, int]
    default: int


# The live and the batch weights differ on purpose. In the batch profile a
# purchase event counts nothing because the order behind it supplies ORDER_SIGNAL.
LIVE = Weights({"page_view": 1, "add_to_cart": 5, "checkout": 7, "purchase": 10}, default=1)
BATCH = Weights({"page_view": 1, "add_to_cart": 3, "checkout": 7}, default=0)
ORDER_SIGNAL = 10


def score(weights: Weights, event_type: str = "event_type") -> Column:
    """The weight of each row's event type; an unknown or null type takes the default."""
    kind = F.col(event_type)
    chain = F
    for name, weight in weights.by_type.items():
        chain = chain.when(kind == name, F.lit(weight))
    return chain.otherwise(F.lit(weights.default)).cast("long")
