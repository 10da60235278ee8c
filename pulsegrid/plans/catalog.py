"""Loads every query module and exposes the registry."""

from __future__ import annotations

from .registry import ORACLES, QUERIES
from . import (grids, joins, rollups, scalars, scoring_q, selections, sequences, sources_q,  # noqa: F401
               streams_q, summaries)  # noqa: F401

__all__ = ["QUERIES", "ORACLES"]
