"""Named queries of this subpackage."""

from __future__ import annotations

from fiscalis.plans.registry import Build, Query

LLM_QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    def add(build: Build) -> Build:
        LLM_QUERIES[name] = Query(build, sql)
        return build
    return add
