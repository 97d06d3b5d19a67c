"""Registry of named queries: a Spark callable and, where SQL can say it, its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from utxolens.sources.views import VIEW_SQL, Kept, Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _needed(names: list[str]) -> list[str]:
    out: list[str] = []
    for n in names:
        for m in [*_needed(VIEW_SQL[n][0]), n]:
            if m not in out:
                out.append(m)
    return out


def with_views(names: str, sql: str) -> str:
    """sql with the named views in front; sql starts with `select`, or with further CTEs and a leading comma."""
    ctes = ",\n".join(f"{n} as ({VIEW_SQL[n][1]})" for n in _needed(names.split()))
    return f"with recursive {ctes}\n{sql}"


def query(name: str, views: str = "", sql: str | None = None, kept: bool = False):
    """Register f(Views) -> DataFrame as a query; sql is its twin over the same views. kept: its views are settled, as it reads them several times."""

    def keep(f: Callable[[Views], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f((Kept if kept else Views)(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[name] = with_views(views, sql) if views else sql
        return f

    return keep
