"""A registered query: survey ids, the Spark plan and the equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from catalens.plans.oracle_views import with_views


@dataclass(frozen=True)
class Query:
    ids: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


class Catalogue(dict):
    """Name to query, filled by decorating plan functions."""

    def add(self, name: str, ids: str, sql: str | None = None):
        def register(run):
            if name in self:
                raise ValueError(f"duplicate query {name}")
            self[name] = Query(ids, run, with_views(sql) if sql else None)
            return run

        return register
