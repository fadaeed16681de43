"""Queries over the benchmark tables, one per operator or report."""

from __future__ import annotations

from importlib import import_module

MODULES = ["cleaning", "rollups", "running", "outcomes", "landing"]


def load_registry():
    from .registry import REGISTRY

    for name in MODULES:
        import_module(f"{__name__}.{name}")
    return REGISTRY
