"""The query catalogue, assembled from one module per family of operators."""

from __future__ import annotations

from importlib import import_module

from .base import Catalog

FAMILIES = ("labels", "transforms", "evaluation", "metrics", "screening", "validation", "trading", "market",
            "microstructure", "streams", "storage", "studies")


def load() -> Catalog:
    """All families in one catalogue."""
    out = Catalog()
    for name in FAMILIES:
        part = import_module(f"{__name__}.{name}").CATALOG
        for key, fn in part.queries.items():
            out.add(key, part.sql.get(key))(fn)
    return out
