"""Registered queries over the driver tables, each with its SQL where SQL can say it."""

import importlib

MODULES = ("revenue", "products", "retention", "anomalies", "cleaning", "quality", "catalog", "kpis", "storage", "scalars")


def load_all() -> None:
    """Import every module that registers queries."""
    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
