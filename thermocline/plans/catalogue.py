"""The catalogue of registered queries over the supplied tables, each with its DuckDB SQL where SQL can say it."""

from __future__ import annotations

from thermocline.plans import energy, mining, outlook, relations, season, series  # noqa: F401  (they register their queries)
from thermocline.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
