"""Registry scans and display joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fold import fold_weak
from ..operators.scale import rank_slice
from .schemas import REGISTRY, struct


def read_registry(spark: SparkSession, folder: str, table: str, *columns: str) -> DataFrame:
    """IO-10. A registry table; only the named columns are read."""
    df = spark.read.schema(struct(REGISTRY[table])).parquet(f"{folder}/{table}")
    return df.select(*columns) if columns else df


def active_only(df: DataFrame) -> DataFrame:
    """P-15."""
    return df.filter("ativo")


def search_by_name(df: DataFrame, text: str, column: str = "nome_normalizado") -> DataFrame:
    """P-16. Folded name contains the folded search text."""
    return df.filter(F.col(column).contains(fold_weak(F.lit(text))))


def display_join(
    employees: DataFrame, companies: DataFrame, cities: DataFrame, salaries: DataFrame | None = None
) -> DataFrame:
    """J-10. Employees with company and city name, '—' where missing; salaries only when given."""
    out = employees.join(
        companies.select(F.col("id").alias("empresa_id"), F.col("nome").alias("empresa")), "empresa_id", "left"
    ).join(cities.select(F.col("id").alias("municipio_id"), F.col("nome").alias("cidade")), "municipio_id", "left")
    out = out.withColumns({c: F.coalesce(c, F.lit("—")) for c in ("empresa", "cidade")})
    if salaries is not None:
        out = out.join(salaries.withColumnRenamed("funcionario_id", "id"), "id", "left")
    return out


def by_name(df: DataFrame, column: str = "nome") -> DataFrame:
    """L-1."""
    return df.orderBy(column)


def newest_first(df: DataFrame, column: str = "created_at") -> DataFrame:
    """L-2. Rows of one time in order of their id."""
    return df.orderBy(F.desc(column), "id")


def top_runs(runs: DataFrame, n: int = 100) -> DataFrame:
    """L-3."""
    return newest_first(runs).limit(n)


def page_slice(df: DataFrame, order: list[str], page: int, size: int, rows: int = 1 << 16) -> DataFrame:
    """L-4. One page of a list in the ascending order of columns; a page behind the end shows the last page.

    The page is found by counting, so a late page costs no more than an early
    one, and only about ``rows`` rows around it are sorted.
    """
    total = df.count()
    last = max(1, -(-total // size))
    shown = min(page, last)
    found = rank_slice(df, order, (shown - 1) * size, size, rows)
    return found.withColumns({"page": F.lit(shown), "pages": F.lit(last), "total": F.lit(total)})


def preview(records: DataFrame, n: int = 20) -> tuple[DataFrame, Column]:
    """L-5. First records in input order, and whether there are more."""
    head = records.orderBy("row_ord").limit(n)
    return head, F.lit(records.limit(n + 1).count() > n)


def role_of(roles: DataFrame, user_id: str) -> DataFrame:
    """L-7. One role of a user, the first in name order."""
    return roles.filter(F.col("user_id") == user_id).orderBy("role").limit(1)
