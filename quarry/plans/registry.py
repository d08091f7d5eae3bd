"""All queries of the engine by name, with their DuckDB counterparts."""

from __future__ import annotations

from quarry.plans import changes, monitoring, relational, surface

MODULES = (relational, changes, monitoring, surface)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in MODULES for k, v in m.ORACLES.items()}
