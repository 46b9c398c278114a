"""Queries that write tables, splits and logs, and read them back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tideline.numbering import row_numbers
from tideline.operators import audits, metrics, splits
from tideline.plans.fixtures import EVENTS, SEED, Tables, sql
from tideline.plans.registry import SQL, query
from tideline.scale import join_one_row_per_key
from tideline.sources import sinks, stored, vectors


def fresh(t: Tables, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{stored.shared_folder(t.spark)}/tideline-{name}-{uuid.uuid4().hex}"


def _parted(t: Tables):
    return join_one_row_per_key(t.entries.select("user_id", "ts", "event_id"), t.user_split, ["user_id"])


@query("frozen_split_positions", sql("entries user_split", "SELECT event_id, part FROM entries JOIN user_split USING (user_id)"))
def _(t: Tables):
    """A split frozen as row positions, written, read and applied to the rows again."""
    # numbering reads its rows several times; the split is made once
    placed = row_numbers(stored.once(_parted(t)), ["user_id", "ts", "event_id"], "place")
    path = fresh(t, "split")
    splits.save_split(placed, path, "place", per_document=500)
    split = splits.load_split(t.spark, path, lines=True)
    return splits.apply_split(t.entries.select("user_id", "ts", "event_id"), split, EVENTS).select("event_id", "part")


@query("row_positions", sql("entries", "SELECT event_id, row_number() OVER (ORDER BY user_id, ts, event_id) - 1 AS place FROM entries"))
def _(t: Tables):
    return row_numbers(t.entries.select("user_id", "ts", "event_id"), ["user_id", "ts", "event_id"], "place").select("event_id", "place")


@query("frozen_split_ids", sql("entries user_split", "SELECT event_id, part FROM entries JOIN user_split USING (user_id) WHERE user_id % 3 <> 0"))
def _(t: Tables):
    """A split frozen as row keys, of two thirds of the users; the other rows go."""
    path = fresh(t, "split")
    splits.save_split(_parted(t).where("user_id % 3 <> 0"), path, "event_id", "event_id", per_document=500)
    split = splits.load_split(t.spark, path, lines=True)
    return splits.apply_split(t.entries.select("user_id", "ts", "event_id"), split, EVENTS).select("event_id", "part")


LOG = SQL["evaluation_log"]


@query("appended_log", f"SELECT * FROM ({LOG}) UNION ALL SELECT * REPLACE ('r2' AS run_id) FROM ({LOG})")
def _(t: Tables):
    """Two runs in the log; the first is written twice and counts once."""
    sliced = metrics.with_slices(t.level_preds, "flag", "words", "essays")
    rows = metrics.regression_errors(sliced, ["v", "a"], ["slice"]).withColumnsRenamed(
        {"mae_v": "mae_valence", "mae_a": "mae_arousal", "mse_v": "mse_valence", "mse_a": "mse_arousal"}
    )
    rows = rows.withColumn("config_hash", F.md5(F.lit(f"r1:{SEED}")))
    path = fresh(t, "log")
    for run in ("r1", "r2", "r1"):
        sinks.append_log(rows, path, run_id=run, seed=SEED, task="levels", regime="all_rows", model_tag="affine")
    return sinks.read_log(t.spark, path)


@query("stored_parquet", "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, epoch_us(CAST(o_orderdate AS TIMESTAMP)) AS o_orderdate FROM orders")
def _(t: Tables):
    rows = t.raw("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_orderdate")
    path = fresh(t, "orders")
    stored.write(rows, path)
    return stored.read(t.spark, path)


@query("stored_csv", "SELECT doc_id, nullif(text, '') AS text, source, row_number() OVER (ORDER BY source, doc_id) - 1 AS place FROM documents")
def _(t: Tables):
    """Whole texts with quotes and line breaks through an ordered CSV of several parts; an empty text is unknown in CSV.

    A row's place is counted from the parts, taken by name, and the rows within them.
    """
    rows = t.raw("documents").select("doc_id", F.nullif("text", F.lit("")).alias("text"), "source")
    path = fresh(t, "documents")
    stored.write(rows, path, form="csv", order=["source", "doc_id"])
    back = stored.read(t.spark, path)
    part = F.input_file_name()
    placed = back.select("*", part.alias("_part"), F.monotonically_increasing_id().alias("_row"))
    return row_numbers(placed, ["_part", "_row"], "place").drop("_part", "_row")


@query("vectors_npz", "SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding][1:8] AS head, len(embedding) AS dim FROM embeddings")
def _(t: Tables):
    """Vectors written as NPZ files and read back by ranges of rows."""
    path = fresh(t, "vectors")
    vectors.export_npz(t.raw("embeddings"), path, ["vec_id"], "embedding")
    back = vectors.import_npz(t.spark, path, ["vec_id"], rows=500)
    return back.select("vec_id", F.slice("vec", 1, 8).cast("array<double>").alias("head"), F.size("vec").cast("long").alias("dim"))


DIGEST = """SELECT count(*) AS n, concat_ws('-', CAST(sum(CAST(CAST(('0x' || substr(h, 1, 16)) AS UBIGINT) AS HUGEINT)) AS VARCHAR),
    CAST(sum(CAST(CAST(('0x' || substr(h, 17, 16)) AS UBIGINT) AS HUGEINT)) AS VARCHAR)) AS digest FROM
    (SELECT md5(concat_ws('|', {row})) AS h FROM events)"""


def digest_sql(*columns: str) -> str:
    cell = "CASE WHEN {c} IS NULL THEN '-' ELSE length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END"
    return DIGEST.format(row=", ".join(cell.format(c=c) for c in columns))


@query("table_digest", digest_sql("event_id", "user_id", "event_type", "props"))
def _(t: Tables):
    return stored.digest(t.raw("events"), ["event_id", "user_id", "event_type", "props"])


@query(
    "scores_remade",
    " UNION ALL ".join(
        f"SELECT '{step}' AS step, {made} AS made, {n} AS n, CAST({total} AS BIGINT) AS total FROM events"
        for step, made, n, total in (
            ("first", "true", "count(*)", "sum(event_id % 100)"),
            ("other order", "false", "count(*)", "sum(event_id % 100)"),
            ("one value changed", "true", "count(*)", "sum(CASE WHEN event_id = 7 THEN 8 ELSE event_id % 100 END)"),
            ("one row repeated", "true", "count(*) + 1", "sum(event_id % 100) + 7"),
            ("one row missing", "true", "count(*) - 1", "sum(event_id % 100) - 7"),
            ("stored rows lost", "true", "count(*) - 1", "sum(event_id % 100) - 7"),
        )
    ),
)
def _(t: Tables):
    """Scores of a table that changes step by step: made anew when its rows change, or when the stored scores are not whole."""
    rows = t.raw("events").select("event_id", (F.col("event_id") % 100).alias("x"))
    one = F.col("event_id") == 7
    steps = {
        "first": rows,
        "other order": rows.orderBy(F.desc("event_id")),
        "one value changed": rows.withColumn("x", F.when(one, 8).otherwise(F.col("x"))),
        "one row repeated": rows.unionByName(rows.where(one)),
        "one row missing": rows.where(~one),
        "stored rows lost": rows.where(~one),
    }
    path, out = fresh(t, "scores"), []
    made = []

    def score(df):
        made.append(True)
        return df.withColumn("score", F.col("x") * 2)

    for step, df in steps.items():
        made.clear()
        if step == "stored rows lost":
            # another program replaces the data, but not the manifest
            known = stored.manifest(t.spark, path)
            df.limit(1).withColumn("score", F.lit(0).cast("long")).write.mode("overwrite").parquet(f"{path}/{known['version']}")
        found = stored.reused(df, path, score).agg(F.count(F.lit(1)).alias("n"), (F.sum("score") / 2).cast("long").alias("total")).first()
        out.append((step, bool(made), found["n"], found["total"]))
    return t.spark.createDataFrame(out, "step string, made boolean, n long, total long")


@query(
    "audit_offending_keys",
    """SELECT 'documents:labelled' AS check_name, CASE WHEN count(*) > 0 THEN 'FAIL' ELSE 'PASS' END AS status, count(*) AS n_bad, (SELECT string_agg(k, ' ' ORDER BY m) FROM
       (SELECT min(md5(CAST(doc_id AS VARCHAR))) AS m, arg_min(CAST(doc_id AS VARCHAR), md5(CAST(doc_id AS VARCHAR))) AS k FROM documents ANTI JOIN labels USING (doc_id)
        GROUP BY substr(md5(CAST(doc_id AS VARCHAR)), 1, 1))) AS sample FROM documents ANTI JOIN labels USING (doc_id)
       UNION ALL SELECT 'events:repeated_users', CASE WHEN count(*) > 0 THEN 'FAIL' ELSE 'PASS' END, count(*), (SELECT string_agg(k, ' ' ORDER BY m) FROM
       (SELECT min(md5(CAST(user_id AS VARCHAR))) AS m, arg_min(CAST(user_id AS VARCHAR), md5(CAST(user_id AS VARCHAR))) AS k FROM
        (SELECT user_id FROM events GROUP BY user_id HAVING count(*) > 1) GROUP BY substr(md5(CAST(user_id AS VARCHAR)), 1, 1)))
       FROM (SELECT user_id FROM events GROUP BY user_id HAVING count(*) > 1)""",
)
def _(t: Tables):
    """Failed checks with their number of bad keys and a sample of them, each from one aggregate."""
    absent = t.raw("documents").select("doc_id").join(t.raw("labels").select("doc_id"), "doc_id", "left_anti")
    repeated = t.raw("events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return audits.report(
        audits.with_sample("documents:labelled", absent, ["doc_id"]), audits.with_sample("events:repeated_users", repeated, ["user_id"])
    )
