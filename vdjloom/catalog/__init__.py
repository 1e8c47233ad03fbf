"""Registered queries and the SQL each one must agree with.

A query is a pair: a function ``(spark, sf_dir) -> DataFrame`` and DuckDB SQL
over the same tables (``None`` where SQL on whole tables is too slow or the
result is not expressible; those are tested against brute force in ``tests/``).
"""

from __future__ import annotations

from importlib import import_module

_GROUPS = (
    "filters", "headers", "vendors", "split", "pairs", "sets", "collapse",
    "primers", "assembly", "errors", "clusters", "files", "cells", "checks",
    "workflows",
)


def load() -> dict[str, tuple]:
    found: dict[str, tuple] = {}
    for group in _GROUPS:
        found.update(import_module(f"vdjloom.catalog.{group}").QUERIES)
    return found
