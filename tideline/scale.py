"""Skew handling shared by all operators.

Nothing here changes a result, and nothing decides by file sizes: entities are counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = "_chunk"

# Session setting and its default: a group of up to this many rows may be sorted by one task.
MAX_TASK_ROWS = ("spark.tideline.maxTaskRows", 5_000_000)
#: Cut points drawn for each MAX_TASK_ROWS rows of a hot entity; more make chunks more even.
CUTS = 4


def setting(spark: SparkSession, entry: tuple[str, int]) -> int:
    name, default = entry
    return int(spark.conf.get(name, str(default)))


def join_one_row_per_key(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join many ``left`` rows to at most one ``right`` row per key.

    A plain equi-join: adaptive execution broadcasts a right side that turns out small, and
    else splits the partitions of hot (and null) keys on the left, whose right rows are few.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join type {how}")
    return left.join(right, on, how)


#: Whether inputs counted so far have a hot entity, by session and plan. A stale answer can
#: cost time, never rows: cut points are found anew whenever a plan runs.
_counted: dict[tuple, bool] = {}


def has_hot_entity(df: DataFrame, entity: list[str]) -> bool:
    """True if one entity has more rows than a task should sort; one map-side combined count."""
    spark = df.sparkSession
    limit = setting(spark, MAX_TASK_ROWS)
    rows = df.select(*entity)
    known = (id(spark), limit, rows.semanticHash())
    if known not in _counted:
        most = rows.groupBy(*entity).agg(F.count(F.lit(1)).alias("_rows")).agg(F.max("_rows").alias("most")).first()
        _counted[known] = (most["most"] or 0) > limit
    return _counted[known]


def spread(df: DataFrame, entity: list[str], order: list[str]) -> tuple[DataFrame, bool]:
    """Cut hot entities into chunks of consecutive rows.

    Returns the input unchanged if no entity is hot. Otherwise cut points are drawn from the
    rows of hot entities, about ``CUTS`` for each task-sized run, by a hash of the row's place;
    a row's chunk is the number of its entity's cut points at or before it. So the chunk is a
    function of the row: nothing is pinned, and rows of other entities keep chunk 0.
    """
    if CHUNK in df.columns:
        return df, True
    if not has_hot_entity(df, entity):
        return df, False
    limit = setting(df.sparkSession, MAX_TASK_ROWS)
    sizes = df.groupBy(*entity).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > limit)
    hot = sizes.select(*[F.col(k).alias("_h_" + k) for k in entity])
    places = df.select(*entity, F.struct(*order).alias("_at"))
    places = places.join(hot, same_key(places, hot, entity, "_h_"), "left_semi")
    drawn = places.where(F.pmod(F.xxhash64("_at"), F.lit(limit)) < CUTS)
    cuts = drawn.groupBy(*entity).agg(F.array_sort(F.collect_set("_at")).alias("_cuts"))
    cuts = cuts.select(*[F.col(k).alias("_e_" + k) for k in entity], "_cuts")
    joined = df.join(cuts, same_key(df, cuts, entity, "_e_"), "left")
    before = F.size(F.filter("_cuts", lambda x: x <= F.struct(*order)))
    chunked = joined.withColumn(CHUNK, F.when(F.col("_cuts").isNull(), 0).otherwise(before))
    return chunked.drop("_cuts", *["_e_" + k for k in entity]), True


def attach(df: DataFrame, name: str, one_row: DataFrame) -> DataFrame:
    """Add the struct of a one-row table to every row, as a scalar subquery.

    It becomes a column of its own: if every use named the subquery anew, the optimizer
    would work through a copy of its whole plan per use.
    """
    return df.withColumn(name, one_row.select(F.struct(*one_row.columns)).scalar())


def same_key(left: DataFrame, right: DataFrame, keys: list[str], prefix: str) -> Column:
    """Null-safe equality of ``keys`` with the prefixed columns of ``right``."""
    condition = F.lit(True)
    for key in keys:
        condition = condition & left[key].eqNullSafe(right[prefix + key])
    return condition


def whole(df: DataFrame) -> DataFrame:
    """Add the constant entity ``_all`` for operators that order a whole table."""
    return df.withColumn("_all", F.lit(0))
