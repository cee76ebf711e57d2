"""Every query of the road-network part, with its SQL where SQL can express it."""

from __future__ import annotations

from .queries import ORACLES, QUERIES, SLOW

__all__ = ["ORACLES", "QUERIES", "SLOW"]
