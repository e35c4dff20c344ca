"""All registered queries of the engine's own operators, with their SQL."""

from __future__ import annotations

from bidsmith.plans import awards, lookups, memories, names, polls, scans, services, streams, texts, trades  # noqa: F401  they register their queries
from bidsmith.plans.registry import ORACLES, QUERIES  # noqa: F401
