"""Every registered query with the SQL it is held against."""

from __future__ import annotations

from colonnade.plans import aggregates, codec_runs, joins, ordering, scalars, storage  # noqa: F401  they register
from colonnade.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
