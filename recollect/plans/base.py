"""Registration of queries with their SQL twins."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:  # lambdas are written x -> ... here, as in Spark
            SQL[f.__name__] = re.sub(r"\((\w), (\w)\) -> ", r"lambda \1, \2: ", re.sub(r"\b(\w) -> ", r"lambda \1: ", sql))
        return f

    return keep
