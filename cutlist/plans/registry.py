"""Where queries are registered, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .fixtures import cte, frame

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, *inputs: str):
    """Register a function of its input frames under its own name, with DuckDB SQL over inputs of the same names."""

    def register(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(*[frame(spark, sf_dir, name) for name in inputs])
        if sql:
            with_ = cte(*inputs).rstrip() + (", " + sql[5:] if sql.startswith("with ") else "\n" + sql)
            if sql.startswith("with recursive "):
                with_ = "with recursive " + cte(*inputs).rstrip()[5:] + ", " + sql[15:]
            ORACLE_SQL[f.__name__] = with_
        return f

    return register
