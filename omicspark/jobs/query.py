"""Registration of queries: a job over views, and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from omicspark.sources.adapters import view, view_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, views: str, job: Callable[..., DataFrame], sql: str | None = None) -> None:
    """Registers job(*views) as name. sql: DuckDB's query over the same views, which may go on with further common table
    expressions; None where SQL can't express the job."""
    names = views.split()

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return job(*[view(spark, sf_dir, n) for n in names])

    assert name not in QUERIES, name
    QUERIES[name] = run
    if sql is not None:
        ctes = ", ".join(view_sql(n) for n in names)
        rest = sql.strip()
        start = "WITH RECURSIVE" if rest.startswith("WITH RECURSIVE") else "WITH"
        ORACLES[name] = f"{start} {ctes}, {rest[len(start) :]}" if rest.startswith("WITH ") else f"WITH {ctes} {rest}"
