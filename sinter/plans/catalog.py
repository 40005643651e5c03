"""Registry of the named queries checked by the driver.

``register(name, sql=...)`` pairs a Spark query ``fn(spark, sf_dir) ->
DataFrame`` with its DuckDB oracle (``None`` = rows-only check).
"""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}
COVERS: dict[str, tuple[str, ...]] = {}


def register(name: str, sql: str | None = None, covers: tuple[str, ...] = ()):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        COVERS[name] = covers
        return fn
    return deco


def load_all() -> None:
    # importing the modules fills the registry
    from sinter.plans import q_clean, q_series, q_metrics, q_models, q_cluster, q_sources, flagship, q_flows  # noqa: F401
