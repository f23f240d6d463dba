"""Queries bound to tables."""

from __future__ import annotations

import importlib

from fiscalis.plans.registry import QUERIES, Query

MODULES = ["feature_queries", "catalog_queries", "model_queries", "analytics_queries", "stat_queries", "raw_queries", "io_queries"]


def all_queries() -> dict[str, Query]:
    for module in MODULES:
        importlib.import_module(f"fiscalis.plans.{module}")
    return QUERIES
