"""All registered queries in one place."""

from __future__ import annotations

from memlake.plans import (  # noqa: F401  (registration)
    context_queries,
    deletion_queries,
    maintenance_queries,
    memory_queries,
    recall_queries,
    rule_queries,
    source_queries,
)
from memlake.plans.registry import ORACLES, QUERIES


def all_queries():
    return dict(QUERIES)


def all_oracles():
    return dict(ORACLES)
