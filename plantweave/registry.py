"""Modules with registered queries (QUERIES) and their SQL (ORACLE)."""

from __future__ import annotations

import importlib
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

MODULES = ("plantweave.plans.problems", "plantweave.plans.reference_queries", "plantweave.plans.composite_queries")


def queries(more: Sequence[str] = ()) -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Queries of the modules, and of ``more``, by name; each callable takes (spark, folder)."""
    return {k: f for m in (*MODULES, *more) for k, f in importlib.import_module(m).QUERIES.items()}
