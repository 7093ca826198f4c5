"""Registry of checkable queries: name -> Spark callable and its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chromatide.plans.fixtures import with_views

QueryFn = Callable[[SparkSession, str], DataFrame]

MODULES = ["q_matrix", "q_labels", "q_regions", "q_sequences", "q_sentences", "q_distance", "q_eval", "q_hits", "q_stats", "q_examples", "q_io", "q_stream"]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Register ``fn(spark, sf_dir)`` under ``name`` with an optional oracle SQL."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = with_views(sql, *views)
        return fn
    return deco


def load_all() -> None:
    # Importing the modules fills the registry.
    import importlib
    for m in MODULES:
        importlib.import_module(f"chromatide.plans.{m}")
