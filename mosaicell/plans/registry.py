"""Queries by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def tidy(df: DataFrame) -> DataFrame:
    """Results as they are compared: without the image's name, whole numbers as long, others to six places."""
    out = []
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        if f.name == "image_id":
            continue
        if kind in ("double", "float"):
            out.append((F.round(F.col(f"`{f.name}`").cast("double"), 6) + F.lit(0.0)).alias(f.name))
        elif kind in ("int", "smallint", "tinyint"):
            out.append(F.col(f"`{f.name}`").cast("long").alias(f.name))
        else:
            out.append(F.col(f"`{f.name}`"))
    return df.select(*out)


def query(name: str, sql: str | None = None):
    """Registers a query, and its SQL if it has one."""

    def register(f):
        QUERIES[name] = lambda spark, sf_dir: tidy(f(spark, sf_dir))
        QUERIES[name].__doc__ = f.__doc__
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register
