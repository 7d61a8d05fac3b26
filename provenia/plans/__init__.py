"""The catalog: every registered query and its SQL."""

from __future__ import annotations

import importlib

from provenia.plans.registry import BUILDERS, SQL, Builder

MODULES = ("scalar", "relational", "documents", "engine", "progress", "discovery", "surface")


def queries() -> dict[str, Builder]:
    for name in MODULES:
        importlib.import_module(f"provenia.plans.{name}")
    return dict(BUILDERS)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)
