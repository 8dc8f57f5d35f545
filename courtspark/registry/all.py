"""All registered queries."""

from __future__ import annotations

from courtspark.registry import history, learned, market, rows, scores, tables
from courtspark.registry.entry import Query

REGISTRY: dict[str, Query] = {}
for _module in (rows, history, scores, market, tables, learned):
    REGISTRY.update(_module.QUERIES)
