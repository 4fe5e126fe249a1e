"""Every operator as a named query over the given tables, with its SQL twin."""

from __future__ import annotations

from riskgrove.catalog import (  # noqa: F401
    attribution,
    clusters,
    distributions,
    encoders,
    evaluation,
    features,
    files,
    models,
    profiles,
    rules,
    selection,
    statistics,
)
from riskgrove.catalog.registry import REGISTRY

__all__ = ["REGISTRY"]
