"""Joins with enforced cardinality and coverage, and set operations on keys.

The checked joins raise with a sample of offending keys, so each check is a small job
over the key columns alone; ``check=False`` leaves it out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.scale import join_one_row_per_key

SAMPLE = 10  # keys shown in an error text


def duplicate_keys(df: DataFrame, on: list[str]) -> DataFrame:
    """Keys that occur more than once, with their counts. Hashes are counted first, so only
    keys whose hashes repeat are shuffled at full width."""
    hashed = df.select(*on).withColumn("_hash", F.xxhash64(*on))
    again = hashed.groupBy("_hash").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_hash")
    rows = hashed.join(again, "_hash", "left_semi")
    return rows.groupBy(*on).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def refuse(bad: DataFrame, on: list[str], text: str) -> None:
    """Raise with a sample of the rows, if there are any."""
    sample = bad.select(*on).limit(SAMPLE).collect()
    if sample:
        raise ValueError(f"{text}; sample: {[tuple(r) for r in sample]}")


def key_census(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Per key its number of rows on each side. One shuffle of map-side combined counts
    answers uniqueness and coverage together, whatever the skew of the keys."""
    sides = left.select(*on, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(
        right.select(*on, F.lit(0).alias("_l"), F.lit(1).alias("_r"))
    )
    return sides.groupBy(*on).agg(F.sum("_l").alias("n_left"), F.sum("_r").alias("n_right"))


def require_unique(df: DataFrame, on: list[str], what: str) -> None:
    refuse(duplicate_keys(df, on), [*on, "n"], f"{what}: duplicate {on}")


def _require(left: DataFrame, right: DataFrame, on: list[str], bad: str, text: str) -> None:
    census = key_census(left, right, on).where(bad)
    refuse(census, [*on, "n_left", "n_right"], f"{text} (key, left rows, right rows)")


def one_to_one(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", check: bool = True) -> DataFrame:
    """Join on a key that is unique on both sides."""
    if check:
        _require(left, right, on, "n_left > 1 or n_right > 1", f"duplicate {on}")
    return left.join(right, on, how)


def many_to_one(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", check: bool = True) -> DataFrame:
    """Join on a key that is unique on the right side."""
    if check:
        require_unique(right, on, "right side")
    return join_one_row_per_key(left, right, on, how)


def full_coverage(left: DataFrame, right: DataFrame, on: list[str], check: bool = True) -> DataFrame:
    """Inner join in which every left row must find its one right row."""
    if check:
        _require(left, right, on, "n_right > 1 or (n_left > 0 and n_right = 0)", "no single match")
    return join_one_row_per_key(left, right, on, "inner")


def marker_rows(markers: DataFrame, rows: DataFrame, on: dict[str, str], check: bool = True) -> DataFrame:
    """Find each marker's row under differently named keys; unmatched markers raise."""
    renamed = rows.withColumnsRenamed({theirs: mine for mine, theirs in on.items()})
    keys = list(on)
    extra = [c for c in markers.columns if c in renamed.columns and c not in keys]
    joined = markers.drop(*extra).join(renamed.withColumn("_found", F.lit(True)), keys, "left")
    if check:
        refuse(joined.where(F.col("_found").isNull()), keys, "marker without a row")
    return joined.drop("_found")


def key_differences(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Keys on one side only: ``side`` is 'missing' (left only) or 'extra' (right only)."""
    one_sided = key_census(left, right, on).where("n_left = 0 or n_right = 0")
    return one_sided.select(*on, F.when(F.col("n_right") == 0, "missing").otherwise("extra").alias("side"))


def aligned(left: DataFrame, right: DataFrame, on: list[str], check: bool = True) -> DataFrame:
    """One-to-one inner join in which both key sets must be equal."""
    if check:
        _require(left, right, on, "n_left <> 1 or n_right <> 1", "key sets differ")
    return left.join(right, on, "inner")


def mismatches(claims: DataFrame, source: DataFrame, on: list[str], compare: list[str]) -> DataFrame:
    """Claimed rows that have no source row or differ from it in a compared column."""
    theirs = source.select(*on, *[F.col(c).alias("_src_" + c) for c in compare], F.lit(True).alias("_found"))
    joined = claims.join(theirs, on, "left")
    differs: Column = reduce(
        lambda a, c: a | ~F.col(c).eqNullSafe(F.col("_src_" + c)), compare, F.col("_found").isNull()
    )
    return joined.where(differs).select(*on, *compare)


def pair_means(df: DataFrame, entity: str, half: str, values: list[str]) -> DataFrame:
    """Mean per entity in half 1 and in half 2, for entities with rows in both.

    One conditional aggregation instead of two aggregates and a join."""
    parts = []
    for c in values:
        parts += [F.avg(F.when(F.col(half) == h, F.col(c))).alias(f"{c}_mean_{h}") for h in (1, 2)]
    present = [F.count_if(F.col(half) == h).alias(f"_n{h}") for h in (1, 2)]
    return df.groupBy(entity).agg(*parts, *present).where("_n1 > 0 and _n2 > 0").drop("_n1", "_n2")


def union_reports(*tables: DataFrame) -> DataFrame:
    """Stack report tables; columns a table lacks become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
