"""A query is a name, a DataFrame builder over the derived tables, and its check in SQL."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from arborist.sources.derived import Derived, oracle_ctes


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Derived], DataFrame]
    sql: str | None = None
    tables: Sequence[str] = ()

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        body = self.sql.strip()
        prefix = oracle_ctes(*self.tables)
        return f"{prefix}{body}" if body.startswith(",") else f"{prefix}\n{body}"


class Registry:
    def __init__(self) -> None:
        self.items: list[Query] = []

    def add(self, name: str, tables: str, build: Callable[[Derived], DataFrame], sql: str | None = None) -> None:
        self.items.append(Query(name, build, sql, tables.split()))
