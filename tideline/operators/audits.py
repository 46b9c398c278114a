"""Data-quality audits: each returns rows (check_name, status, n_bad, example).

``status`` is PASS, WARN or FAIL; ``example`` is the first offending key in key order,
so one aggregate gives the whole finding.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.expressions import clip, is_finite
from tideline.operators.anchors import latest_eligible
from tideline.operators.joins import duplicate_keys, key_differences, mismatches
from tideline.operators.splits import entities_in_both_parts
from tideline.roles import Roles
from tideline.scale import join_one_row_per_key


def _key(on: list[str]) -> Column:
    return F.concat_ws(":", *[F.col(c).cast("string") for c in on])


def _row(name: str, n_bad: Column, example: Column, level: str = "FAIL") -> list[Column]:
    return [
        F.lit(name).alias("check_name"),
        F.when(n_bad == 0, "PASS").otherwise(level).alias("status"),
        n_bad.alias("n_bad"),
        F.coalesce(example, F.lit("")).alias("example"),
    ]


def bad_rows(name: str, bad: DataFrame, on: list[str], level: str = "FAIL") -> DataFrame:
    """A finding from the table of offending rows."""
    return bad.agg(*_row(name, F.count(F.lit(1)), F.min(_key(on)), level))


def rows_where(name: str, df: DataFrame, bad: Column, on: list[str], level: str = "FAIL") -> DataFrame:
    """A finding from a condition on the rows."""
    return df.agg(*_row(name, F.count_if(bad), F.min(F.when(bad, _key(on))), level))


def report(*findings: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), findings)


def passed(findings: DataFrame) -> DataFrame:
    """One row: number of findings, failures, and whether the gate passes."""
    fails = F.count_if(F.col("status") == "FAIL")
    return findings.agg(F.count(F.lit(1)).alias("n_checks"), fails.alias("n_failed"), (fails == 0).alias("ok"))


def with_sample(name: str, bad: DataFrame, on: list[str]) -> DataFrame:
    """One finding about offending rows, with up to sixteen of their keys, from one aggregate.

    The sample has, for each first digit of the keys' hashes, the key with the smallest hash. Such
    minima merge, so it is as large however many rows are bad, and no second job looks for
    examples. Keys are shown in hash order, parted by spaces; null as an empty value.
    """
    text = F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in on])
    hashed = bad.select(F.struct(F.md5(text.cast("binary")).alias("hash"), text.alias("key")).alias("_k"))
    seats = [F.min(F.when(F.col("_k.hash").startswith(f"{i:x}"), F.col("_k"))) for i in range(16)]
    found = hashed.agg(F.count(F.lit(1)).alias("n_bad"), F.array_compact(F.array(*seats)).alias("_sample"))
    keys = F.array_join(F.transform("_sample", lambda x: x["key"]), " ")
    status = F.when(F.col("n_bad") > 0, "FAIL").otherwise("PASS")
    return found.select(F.lit(name).alias("check_name"), status.alias("status"), "n_bad", F.when(F.col("n_bad") > 0, keys).alias("sample"))


def required_columns(df: DataFrame, columns: list[str], what: str) -> DataFrame:
    """Missing columns, from the schema alone."""
    missing = [c for c in columns if c not in df.columns]
    spark = df.sparkSession
    row = [(what + ":columns", "FAIL" if missing else "PASS", len(missing), ",".join(missing))]
    return spark.createDataFrame(row, "check_name string, status string, n_bad bigint, example string")


def non_empty(df: DataFrame, what: str) -> DataFrame:
    empty = (F.count(F.lit(1)) == 0).cast("long")
    return df.agg(*_row(what + ":non_empty", empty, F.lit("")))


def unique_keys(df: DataFrame, on: list[str], what: str) -> DataFrame:
    return bad_rows(what + ":unique", duplicate_keys(df, on), on)


def table_contract(df: DataFrame, columns: list[str], on: list[str], what: str) -> DataFrame:
    """Columns there, not empty, one row per key."""
    return report(required_columns(df, columns, what), non_empty(df, what), unique_keys(df, on, what))


def finite_columns(df: DataFrame, columns: list[str], on: list[str], what: str) -> DataFrame:
    bad = reduce(lambda a, c: a | ~is_finite(F.col(c)), columns, F.lit(False))
    return rows_where(what + ":finite", df, bad, on)


def split_audit(split: DataFrame, key: list[str], rows: DataFrame, entity: str) -> DataFrame:
    """Keys in both parts, and entities with rows in both parts."""
    both = split.groupBy(*key).agg(F.countDistinct("part").alias("n")).where("n > 1")
    shared = entities_in_both_parts(rows, entity)
    return report(bad_rows("split:keys_disjoint", both, key), bad_rows("split:entities_disjoint", shared, [entity]))


def same_keys(preds: DataFrame, expected: DataFrame, on: list[str], what: str) -> DataFrame:
    """Missing, extra and duplicate prediction keys."""
    sides = key_differences(expected, preds, on)
    lost = rows_where(what + ":missing", sides, F.col("side") == "missing", on)
    extra = rows_where(what + ":extra", sides, F.col("side") == "extra", on)
    return report(lost, extra, unique_keys(preds, on, what))


def anchor_audit(preds: DataFrame, anchors: DataFrame, roles: Roles, what: str) -> DataFrame:
    """Prediction rows whose anchor is not the re-derived one, or whose deltas differ."""
    truth = anchors.select(
        F.col(roles.entity),
        F.col(roles.tie).alias("anchor_id"),
        F.col(roles.ts).alias("anchor_ts"),
        *[F.col(d).alias(d + "_true") for d in roles.deltas],
    )
    compare = [c for c in ("anchor_id", "anchor_ts", *[d + "_true" for d in roles.deltas]) if c in preds.columns]
    return bad_rows(what + ":anchors", mismatches(preds, truth, [roles.entity], compare), [roles.entity])


def latest_anchor_audit(preds: DataFrame, source: DataFrame, roles: Roles) -> DataFrame:
    return anchor_audit(preds, latest_eligible(source, roles), roles, "latest")


def coverage(rows: DataFrame, store: DataFrame, on: list[str], what: str) -> DataFrame:
    """Rows whose key is missing from a store."""
    absent = join_one_row_per_key(rows, store.select(*on), on, "left_anti")
    return bad_rows(what + ":covered", absent, on)


def first_half_only(preds: DataFrame, halves: DataFrame, entity: str) -> DataFrame:
    """Predicted entities without a row in half 1."""
    have = halves.where(F.col("half") == 1).select(entity).distinct()
    return bad_rows("leakage:first_half", preds.select(entity).distinct().join(have, entity, "left_anti"), [entity])


def label_in_features(df: DataFrame, features: list[str], labels: list[str]) -> DataFrame:
    """Feature names that contain a label's name, from the list alone."""
    bad = [f for f in features if any(l.lower() in f.lower() for l in labels)]
    row = [("leakage:label_as_feature", "FAIL" if bad else "PASS", len(bad), ",".join(bad))]
    return df.sparkSession.createDataFrame(row, "check_name string, status string, n_bad bigint, example string")


def vector_store(vectors: DataFrame, source: DataFrame, key: list[str], vector: str) -> DataFrame:
    """Constant dimension, unique keys, keys equal to the source's."""
    size = F.size(vector)
    uneven = (F.count(F.lit(1)) > 0) & ~F.coalesce(F.min(size) == F.max(size), F.lit(False))
    sides = key_differences(source, vectors, key)
    return report(
        vectors.agg(*_row("vectors:dimension", uneven.cast("long"), F.concat_ws("-", F.min(size), F.max(size)))),
        unique_keys(vectors, key, "vectors"),
        rows_where("vectors:missing", sides, F.col("side") == "missing", key),
        rows_where("vectors:extra", sides, F.col("side") == "extra", key, "WARN"),
    )


def row_counts_kept(raw: DataFrame, loaded: DataFrame, nullable: list[str]) -> DataFrame:
    """Loading kept every row; unknown values per nullable column are counted, not refused."""
    before = raw.agg(F.count(F.lit(1))).scalar()
    parts = [F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in nullable]]
    found = loaded.agg(*parts).withColumn("_lost", F.abs(F.col("n") - before))
    rows = [F.struct(*_row("load:rows", F.col("_lost"), F.col("n").cast("string")))]
    for c in nullable:
        rows.append(
            F.struct(
                F.lit(f"load:nulls:{c}").alias("check_name"),
                F.lit("PASS").alias("status"),
                F.lit(0).cast("long").alias("n_bad"),
                F.col(c).cast("string").alias("example"),
            )
        )
    return found.select(F.inline(F.array(*rows)))


def log_audit(log: DataFrame, columns: list[str], task: str, run_id: str, seed: int) -> DataFrame:
    """The evaluation log has its columns and a row for this task, run and seed."""
    wanted = (F.col("task") == task) & (F.col("run_id") == run_id) & (F.col("seed") == seed)
    absent = (F.count_if(wanted) == 0).cast("long")
    return report(required_columns(log, columns, "log"), log.agg(*_row("log:row", absent, F.lit(""))))


def degenerate_predictions(preds: DataFrame, columns: list[str], tolerance: float = 1e-9) -> DataFrame:
    """Columns whose predictions do not vary by more than the tolerance."""
    rows = []
    for c in columns:
        flat = ~F.coalesce(F.max(c) - F.min(c) > tolerance, F.lit(False))
        rows.append(F.struct(*_row(f"varies:{c}", flat.cast("long"), F.lit(""), "WARN")))
    return preds.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def submission_audit(
    df: DataFrame, key: list[str], bounds: dict[str, tuple[float, float]], expected_rows: int | Column
) -> DataFrame:
    """Row count, unique keys, and every value finite and within bounds."""
    expected = F.lit(expected_rows) if isinstance(expected_rows, int) else expected_rows
    counted = df.agg(F.count(F.lit(1)).alias("_n")).select(
        *_row("submission:rows", F.abs(F.col("_n") - expected), F.col("_n").cast("string"))
    )
    outside = F.lit(False)
    for c, (low, high) in bounds.items():
        outside = outside | ~is_finite(F.col(c)) | (clip(F.col(c), low, high) != F.col(c))
    return report(
        counted, unique_keys(df, key, "submission"), rows_where("submission:bounds", df, F.coalesce(outside, F.lit(True)), key)
    )
