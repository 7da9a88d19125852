"""Named queries over the shared tables."""

from __future__ import annotations

import importlib

MODULES = ("vectors", "evaluation", "grouping", "texts", "maintenance")


def registered():
    for name in MODULES:
        importlib.import_module(f"vecrec.catalog.{name}")
    from vecrec.catalog.base import ORACLES, QUERIES

    return QUERIES, ORACLES
