"""Named queries over the test tables, each with the SQL that gives the same result where SQL can."""

from __future__ import annotations

from registry import base

_MODULES = ("lr", "tissue", "space", "learn", "files")


def load() -> dict[str, base.Query]:
    import importlib

    for name in _MODULES:
        importlib.import_module(f"registry.{name}")
    return base.QUERIES
