"""Register of queries: a Spark plan and, where SQL can state it, the same query in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.plans.fixtures import TIE_SHIFT, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def rounded(df: DataFrame) -> DataFrame:
    """Round floating columns to six places and times to microseconds since the epoch,
    so that engines can be compared by value."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = (F.round(c.cast("double") + F.lit(TIE_SHIFT), 6) + F.lit(0.0)).alias(f.name)
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.unix_micros(c.cast("timestamp")).alias(f.name)
        out.append(c)
    return df.select(*out)


def query(name: str, sql: str | None = None):
    """Register ``plan(tables) -> DataFrame`` under a name."""

    def add(plan: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, folder: rounded(plan(Tables(spark, folder)))
        if sql is not None:
            SQL[name] = sql
        return plan

    return add
