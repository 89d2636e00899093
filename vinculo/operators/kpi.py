"""Dashboard figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.present import miss_count, parse_misses
from ..sources.registry import top_runs


def dashboard(employees: DataFrame, companies: DataFrame, cities: DataFrame, runs: DataFrame, last_runs: int = 100) -> DataFrame:
    """A-6. One row: active employees, companies, cities, documents, last run and success rate of the latest runs.

    A run counts its misses in ``misses``; rows from elsewhere may hold them as JSON only.
    """
    latest = top_runs(runs.withColumn("_m", F.coalesce("misses", miss_count(F.col("unprocessed_data")))), last_runs).agg(
        F.coalesce(F.sum("pdf_count"), F.lit(0)).alias("documents"), F.max("created_at").alias("last_run"),
        F.coalesce(F.sum("_m"), F.lit(0)).alias("misses"),
    )
    total = F.col("documents") + F.col("misses")
    count = lambda df, name: F.broadcast(df.agg(F.count(F.lit(1)).alias(name)))  # noqa: E731  (one row each)
    return (
        latest.join(count(employees.filter("ativo"), "employees"))
        .join(count(companies, "companies")).join(count(cities, "cities"))
        .select(
            "employees", "companies", "cities", "documents", "last_run",
            F.when(total > 0, F.floor(100.0 * F.col("documents") / total + 0.5)).cast("long").alias("success_percent"),
        )
    )


def runs_with_misses(runs: DataFrame) -> DataFrame:
    """S-31. One row per miss of every run; runs without misses keep one row of NULLs."""
    return runs.select("id", "created_at", F.explode_outer(parse_misses(F.col("unprocessed_data"))).alias("m")).select(
        "id", "created_at", "m.*"
    )


def pending(links: DataFrame, status: str = "pending") -> DataFrame:
    """P-21."""
    return links.agg(F.count_if(F.col("status") == status).alias("n"))
