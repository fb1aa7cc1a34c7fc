"""Named queries over the driver tables and the same questions in SQL."""

from __future__ import annotations

from helixframe.plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
