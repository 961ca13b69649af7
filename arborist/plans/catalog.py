"""All registered queries."""

from __future__ import annotations

from arborist.plans import code, docs, storage, tracking
from arborist.plans.registry import Query


def all_queries() -> list[Query]:
    items = [*code.R.items, *docs.R.items, *tracking.R.items, *storage.R.items]
    names = [q.name for q in items]
    if len(set(names)) != len(names):
        raise ValueError("duplicate query names")
    return items
