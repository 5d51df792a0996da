"""Registered queries and their independent SQL twins."""

from furnacelens.registry import (  # noqa: F401
    features,
    flow,
    indices,
    metrics,
    models,
    ops,
    packets,
    prep,
    projections,
    rolling,
    scenarios,
    sources,
)
from furnacelens.registry.base import QUERIES, SQL  # noqa: F401
