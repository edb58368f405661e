"""Registered queries over the shared tables, each with the SQL it has to agree with."""

from __future__ import annotations

import importlib

MODULES = ("flagship", "sources", "projections", "joins", "aggregates", "windows", "shapes", "scalars", "models", "extracts", "builders")


def load_all():
    from .common import REGISTRY

    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
    return REGISTRY
