"""Registered queries, each next to the SQL that checks it."""

from __future__ import annotations

import importlib

MODULES = [
    "deviation_queries",
    "io_queries",
    "shape_queries",
    "profile_queries",
    "feature_queries",
    "cluster_queries",
    "chart_queries",
    "model_queries",
    "kernel_queries",
]


def load():
    """Import every query module and return the registry."""
    for name in MODULES:
        importlib.import_module(f"worthline.catalog.{name}")
    return importlib.import_module("worthline.catalog.registry")
