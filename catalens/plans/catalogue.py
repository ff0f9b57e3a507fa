"""All registered queries."""

from __future__ import annotations

from catalens.plans import queries_keys, queries_reports, queries_sources, queries_text
from catalens.plans.registry import Catalogue, Query


def all_queries() -> dict[str, Query]:
    merged = Catalogue()
    for module in (queries_keys, queries_reports, queries_text, queries_sources):
        for name, query in module.Q.items():
            if name in merged:
                raise ValueError(f"duplicate query {name}")
            merged[name] = query
    return merged
