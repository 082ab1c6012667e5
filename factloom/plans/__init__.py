"""Analysis flow and the registered queries."""

from __future__ import annotations

import importlib

AREAS = ("profile_queries", "chart_queries", "experiment_queries", "model_queries", "insight_queries", "evidence_queries", "source_queries")


def all_queries():
    """Every registered query by name."""
    from factloom.plans.registry import REGISTRY

    for area in AREAS:
        importlib.import_module(f"factloom.plans.{area}")
    return dict(REGISTRY)
