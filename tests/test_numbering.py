"""Global row numbers by ranges."""

import random

import pytest
from pyspark.sql import functions as F

from tideline.numbering import in_ranges, range_starts, row_numbers


@pytest.mark.parametrize("ranges", [1, 7, 1024])
def test_numbers_follow_the_order(spark, ranges):
    rng = random.Random(1)
    rows = [(rng.choice([None, 1, 2, 3]), rng.randint(0, 50) or None, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "a int, b int, c int").repartition(5)
    got = {r["c"]: r["n"] for r in row_numbers(df, ["a", "b", "c"], "n", ranges).collect()}
    place = lambda r: tuple((x is not None, x or 0) for x in r)
    want = {r[2]: n for n, r in enumerate(sorted(rows, key=place))}
    assert got == want


def test_equal_rows_share_a_range_and_get_all_numbers(spark):
    df = spark.createDataFrame([(1,)] * 400 + [(i,) for i in range(600)], "a int")
    numbers = sorted(r["n"] for r in row_numbers(df, ["a"], "n", 16).collect())
    assert numbers == list(range(1000))
    ranged = in_ranges(df, ["a"], 16)
    assert ranged.where("a = 1").select("_range").distinct().count() == 1
    assert 10 <= range_starts(ranged).count() <= 17


def test_an_empty_table_stays_empty(spark):
    assert row_numbers(spark.createDataFrame([], "a int, b string"), ["a"], "n").count() == 0


def test_a_range_takes_few_comparisons(spark):
    """Ten steps of halving find a row's range among 1,024 cut points, not a walk through them."""
    df = spark.range(20_000).select(((F.col("id") * 7919) % 20_000).alias("a"))
    ranged = in_ranges(df, ["a"], 1000)
    plan = ranged._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" in plan and "filter(_cuts" not in plan
    bounds = ranged.groupBy("_range").agg(F.min("a").alias("low"), F.max("a").alias("high")).orderBy("_range").collect()
    assert len(bounds) > 900
    assert all(x["high"] < y["low"] for x, y in zip(bounds, bounds[1:]))
