"""Chunks of hot entities, and edges of operators that build on them."""

import pytest
from pyspark.sql import functions as F

from tideline.operators import anchors, baselines, joins, splits
from tideline.roles import Roles
from tideline.scale import CHUNK, spread
from tideline.timeline import RowsBefore, SumBefore, Timeline

ROLES = Roles(entity="u", ts="t", tie="i", deltas=("x", "y"))


def rows(spark, n=500):
    return spark.range(n).selectExpr(
        "if(id % 3 = 0, null, if(id % 5 = 0, 1, 2)) AS u", "id div 50 AS t", "id AS i", "id % 7 AS v", "'wide' AS text"
    )


def test_chunk_is_a_function_of_the_row(spark, tiny_tasks):
    cut, chunked = spread(rows(spark), ["u"], ["t", "i"])
    again, _ = spread(rows(spark).repartition(7, "v"), ["u"], ["t", "i"])
    assert chunked and cut.count() == 500
    one = {r["i"]: r[CHUNK] for r in cut.collect()}
    assert one == {r["i"]: r[CHUNK] for r in again.collect()}
    assert len(set(one.values())) > 3
    largest = cut.groupBy("u", CHUNK).count().agg(F.max("count")).first()[0]
    assert largest <= 60


def test_running_values_of_cut_entities_null_key_included(spark, tiny_tasks):
    tl = Timeline(rows(spark), "u", ["t", "i"]).running(at=RowsBefore(), before=SumBefore(F.col("v")))
    assert tl.chunked
    seen = {}
    for r in sorted(tl.result().collect(), key=lambda r: r["i"]):
        n, total = seen.get(r["u"], (0, 0))
        assert (r["at"], r["before"]) == (n, total)
        seen[r["u"]] = n + 1, total + r["v"]


def test_latest_row_is_whole_and_single(spark):
    df = rows(spark).union(rows(spark))
    got = {r["u"]: r["i"] for r in anchors.latest_row(df, ROLES).collect()}
    assert got == {None: 498, 1: 490 if 490 % 3 else 485, 2: 499} and anchors.latest_row(df, ROLES).count() == 3


def test_two_lag_fit_of_no_and_of_collinear_rows(spark):
    columns = "u long, x double, y double, x_prev double, y_prev double"
    with pytest.raises(Exception, match="no row with both lags"):
        baselines.fit_two_lags(spark.createDataFrame([(1, 1.0, 1.0, None, 1.0)], columns), ROLES).collect()
    line = spark.createDataFrame([(1, 2.0 * k, 1.0, float(k), float(k)) for k in range(5)], columns)
    got = {r["delta"]: r for r in baselines.fit_two_lags(line, ROLES).collect()}
    assert abs(got["x"]["coef_1"] - 1) < 1e-9 and abs(got["x"]["coef_2"] - 1) < 1e-9


def test_folds_keep_their_columns_when_entities_are_few(spark):
    few = splits.group_folds(spark.createDataFrame([(1,), (1,), (2,)], "u long"), "u", 5)
    many = splits.group_folds(spark.range(40).withColumnRenamed("id", "u"), "u", 5)
    assert few.columns == many.columns and few.count() == 2


def test_duplicate_keys_and_anchors(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), (None, 2), (None, 2), ("b", 3)], "text string, k int")
    assert {tuple(r) for r in joins.duplicate_keys(df, ["text", "k"]).collect()} == {("a", 1, 2), (None, 2, 2)}
    two = spark.createDataFrame([(1, 5), (1, 6)], "u int, anchor_ts long")
    with pytest.raises(ValueError, match="more than one anchor"):
        anchors.history_up_to(rows(spark), two, ROLES, 3)
