"""The queries registered with the driver, with their check SQL.

Every query reads whole driver tables (or rows Spark derives from them) and
runs one operator of the library on them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(check: str | None = None):
    """Register a query under its function name, with its check SQL if it has one."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if check is not None:
            CHECKS[fn.__name__] = check
        return fn

    return add


def big(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")
