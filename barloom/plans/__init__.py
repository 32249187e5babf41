"""Composite plans: strategies, reviews, portfolio reports and the query catalogue."""

from barloom.plans import (  # noqa: F401
    queries_panel,
    queries_quality,
    queries_snapshots,
    queries_sources,
    queries_strategy,
)
from barloom.plans.catalogue import ORACLES, QUERIES  # noqa: F401
