"""Queries over data-quality audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.operators import anchors, audits, splits
from tideline.operators.datasets import feature_columns
from tideline.operators.metrics import LOG_SCHEMA
from tideline.plans.fixtures import EVENTS, Tables, sql
from tideline.plans.registry import query
from tideline.scale import join_one_row_per_key
from tideline.sources import stored, tables


def finding(name: str, bad: str, key: str, source: str, level: str = "FAIL") -> str:
    """SQL form of a finding: count of rows where ``bad`` and the first bad key."""
    return f"""SELECT '{name}' AS check_name, CASE WHEN count(*) FILTER ({bad}) = 0 THEN 'PASS' ELSE '{level}' END AS status,
        count(*) FILTER ({bad}) AS n_bad, coalesce(min({key}) FILTER ({bad}), '') AS example FROM {source}"""


def constant(name: str, n_bad: int = 0, example: str = "") -> str:
    status = "PASS" if n_bad == 0 else "FAIL"
    return f"SELECT '{name}' AS check_name, '{status}' AS status, CAST({n_bad} AS BIGINT) AS n_bad, '{example}' AS example"


def both(*parts: str) -> str:
    return " UNION ALL ".join(parts)


USER = "CAST(user_id AS VARCHAR)"
DAMAGED = """SELECT user_id, CASE WHEN user_id % 50 = 7 THEN anchor_id + 1 ELSE anchor_id END AS anchor_id, anchor_ts, dv_true, da_true,
    CASE WHEN user_id % 40 = 1 THEN NULL WHEN user_id % 40 = 2 THEN CAST('NaN' AS DOUBLE) WHEN user_id % 40 = 3 THEN CAST('Infinity' AS DOUBLE) ELSE dv_pred END AS dv_pred, da_pred
    FROM anchor_preds WHERE user_id % 30 <> 4"""
# The damaged table with one user twice.
REPEATED = f"{DAMAGED} UNION ALL SELECT * FROM ({DAMAGED}) WHERE user_id = 11"


def damaged(t: Tables):
    """Anchor predictions with wrong anchors, unusable values and missing users."""
    u, p = F.col("user_id"), F.col("dv_pred")
    broken = (
        F.when(u % 40 == 1, F.lit(None).cast("double"))
        .when(u % 40 == 2, F.lit(float("nan")))
        .when(u % 40 == 3, F.lit(float("inf")))
        .otherwise(p)
    )
    moved = F.when(u % 50 == 7, F.col("anchor_id") + 1).otherwise(F.col("anchor_id"))
    return t.stored_preds.where(u % 30 != 4).withColumns({"anchor_id": moved, "dv_pred": broken})


def repeated(t: Tables):
    d = damaged(t)
    return d.unionByName(d.where("user_id = 11"))


@query(
    "audit_gate",
    sql(
        "anchor_preds",
        """SELECT CAST(5 AS BIGINT) AS n_checks, 2 + (SELECT count(*) FILTER (n > 1) > 0 FROM (SELECT count(*) AS n FROM repeated GROUP BY user_id))::BIGINT AS n_failed, false AS ok""",
        repeated=REPEATED,
    ),
)
def _(t: Tables):
    p = repeated(t)
    findings = audits.report(
        audits.table_contract(p, ["user_id", "dv_pred", "da_pred"], ["user_id"], "preds"),
        audits.required_columns(p, ["user_id", "run_id"], "preds"),
        audits.finite_columns(p, ["dv_pred", "da_pred"], ["user_id"], "preds"),
    )
    return audits.passed(findings)


@query(
    "audit_table_contract",
    sql(
        "anchor_preds",
        both(
            constant("preds:columns", 1, "run_id"),
            "SELECT 'preds:non_empty', CASE WHEN count(*) > 0 THEN 'PASS' ELSE 'FAIL' END, CAST(count(*) = 0 AS BIGINT), '' FROM repeated",
            finding("preds:unique", "n > 1", USER, "(SELECT user_id, count(*) AS n FROM repeated GROUP BY user_id)"),
        ),
        repeated=REPEATED,
    ),
)
def _(t: Tables):
    return audits.table_contract(repeated(t), ["user_id", "run_id"], ["user_id"], "preds")


@query(
    "audit_split",
    sql(
        "entries",
        both(
            finding("split:keys_disjoint", "n > 1", "CAST(event_id AS VARCHAR)", "(SELECT event_id, count(DISTINCT part) AS n FROM parts GROUP BY event_id)"),
            finding("split:entities_disjoint", "n > 1", USER, "(SELECT user_id, count(DISTINCT part) AS n FROM parts GROUP BY user_id)"),
        ),
        parts="""SELECT user_id, event_id, CASE WHEN CAST(('0x' || substr(md5(concat(user_id, ':', CASE WHEN user_id % 9 = 0 THEN event_id ELSE 0 END, ':42')), 1, 8)) AS BIGINT) < 858993459
                 THEN 'val' ELSE 'train' END AS part FROM entries""",
    ),
)
def _(t: Tables):
    # Every ninth user is split by row, which leaks.
    by = F.when(F.col("user_id") % 9 == 0, F.col("event_id")).otherwise(0)
    parts = t.entries.select("user_id", "event_id", splits.row_part([F.col("user_id"), by]).alias("part"))
    return audits.split_audit(parts, ["event_id"], parts, "user_id")


@query(
    "audit_prediction_keys",
    sql(
        "anchor_preds",
        both(
            finding("preds:missing", "side = 'missing'", USER, "sides"),
            finding("preds:extra", "side = 'extra'", USER, "sides"),
            finding("preds:unique", "n > 1", USER, "(SELECT user_id, count(*) AS n FROM repeated GROUP BY user_id)"),
        ),
        repeated=REPEATED,
        expected="SELECT DISTINCT user_id FROM events WHERE user_id % 31 <> 5",
        sides="""SELECT user_id, 'missing' AS side FROM expected WHERE user_id NOT IN (SELECT user_id FROM repeated)
                 UNION ALL SELECT DISTINCT user_id, 'extra' FROM repeated WHERE user_id NOT IN (SELECT user_id FROM expected)""",
    ),
)
def _(t: Tables):
    expected = t.raw("events").where("user_id % 31 <> 5").select("user_id").distinct()
    return audits.same_keys(repeated(t), expected, ["user_id"], "preds")


@query(
    "audit_finite",
    sql("anchor_preds", finding("preds:finite", "dv_pred IS NULL OR da_pred IS NULL OR NOT isfinite(dv_pred) OR NOT isfinite(da_pred)", USER, "damaged"), damaged=DAMAGED),
)
def _(t: Tables):
    return audits.finite_columns(damaged(t), ["dv_pred", "da_pred"], ["user_id"], "preds")


@query(
    "audit_latest_anchor",
    sql("anchor_preds", finding("latest:anchors", "user_id % 50 = 7", USER, "damaged"), damaged=DAMAGED),
)
def _(t: Tables):
    return audits.latest_anchor_audit(damaged(t), t.timeline, EVENTS)


@query(
    "audit_forecast_anchor",
    sql(
        "entries cutoffs",
        finding("forecast:anchors", "claimed IS DISTINCT FROM event_id", USER, "anchored"),
        anchored="""SELECT user_id, event_id, CASE WHEN user_id % 50 = 7 THEN event_id + 1 ELSE event_id END AS claimed FROM entries JOIN cutoffs USING (user_id)
                    WHERE ts < cutoff QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
    ),
)
def _(t: Tables):
    """Claims come from the raw rows and are stored; the truth is derived from the timeline."""
    before = t.entries.join(t.cutoffs, "user_id").where("ts < cutoff")
    last = before.groupBy("user_id").agg(F.max(F.struct("ts", "event_id")).alias("last")).select("user_id", "last.*")
    claim = F.when(F.col("user_id") % 50 == 7, F.col("event_id") + 1).otherwise(F.col("event_id"))
    preds = stored.once(last.select("user_id", claim.alias("anchor_id"), F.col("ts").alias("anchor_ts")))
    found = anchors.last_before(t.timeline, t.cutoffs, EVENTS, check=False)
    return audits.anchor_audit(preds, found, EVENTS, "forecast")


@query(
    "audit_vector_coverage",
    sql("docs", finding("vectors:covered", "doc_id NOT IN (SELECT vec_id FROM embeddings)", "CAST(doc_id AS VARCHAR)", "docs")),
)
def _(t: Tables):
    return audits.coverage(t.docs.select("doc_id"), t.vectors, ["doc_id"], "vectors")


@query(
    "audit_first_half_only",
    sql(
        "",
        finding("leakage:first_half", "n < 2", "CAST(o_custkey AS VARCHAR)", "(SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey)"),
    ),
)
def _(t: Tables):
    from tideline.operators import windows
    from tideline.timeline import Timeline

    rows = t.raw("orders").select("o_custkey", "o_orderdate", "o_orderkey")
    halves = windows.halves(Timeline(rows, "o_custkey", ["o_orderdate", "o_orderkey"])).result()
    return audits.first_half_only(rows.select("o_custkey"), halves, "o_custkey")


@query(
    "audit_target_finite",
    sql("timeline user_split", finding("targets:finite", "dv IS NULL OR da IS NULL", "concat(user_id, ':', event_id)", "(SELECT * FROM timeline JOIN user_split USING (user_id) WHERE part = 'val')")),
)
def _(t: Tables):
    rows = join_one_row_per_key(t.timeline, t.user_split.where("part = 'val'"), ["user_id"], "left_semi")
    return audits.finite_columns(rows, ["dv", "da"], ["user_id", "event_id"], "targets")


@query(
    "audit_forecast_users",
    sql(
        "entries",
        both(
            finding("forecast:missing", "side = 'missing'", USER, "sides"),
            finding("forecast:extra", "side = 'extra'", USER, "sides"),
            constant("forecast:unique"),
        ),
        flagged="SELECT DISTINCT user_id FROM entries WHERE a > 97",
        predicted="SELECT DISTINCT user_id FROM entries WHERE v > 250",
        sides="""SELECT user_id, 'missing' AS side FROM flagged WHERE user_id NOT IN (SELECT user_id FROM predicted)
                 UNION ALL SELECT user_id, 'extra' FROM predicted WHERE user_id NOT IN (SELECT user_id FROM flagged)""",
    ),
)
def _(t: Tables):
    flagged = t.entries.where("a > 97").select("user_id").distinct()
    predicted = t.entries.where("v > 250").select("user_id").distinct()
    return audits.same_keys(predicted, flagged, ["user_id"], "forecast")


@query(
    "audit_vector_store",
    sql(
        "docs",
        both(
            """SELECT 'vectors:dimension' AS check_name, CASE WHEN min(len(embedding)) = max(len(embedding)) THEN 'PASS' ELSE 'FAIL' END AS status,
               CAST(min(len(embedding)) <> max(len(embedding)) AS BIGINT) AS n_bad, concat(min(len(embedding)), '-', max(len(embedding))) AS example FROM embeddings""",
            finding("vectors:unique", "n > 1", "CAST(vec_id AS VARCHAR)", "(SELECT vec_id, count(*) AS n FROM embeddings GROUP BY vec_id)"),
            finding("vectors:missing", "doc_id NOT IN (SELECT vec_id FROM embeddings)", "CAST(doc_id AS VARCHAR)", "docs"),
            finding("vectors:extra", "vec_id NOT IN (SELECT doc_id FROM docs)", "CAST(vec_id AS VARCHAR)", "embeddings", "WARN"),
        ),
    ),
)
def _(t: Tables):
    return audits.vector_store(t.vectors, t.docs, ["doc_id"], "vec")


@query(
    "audit_row_counts",
    sql(
        "timeline",
        both(
            """SELECT 'load:rows' AS check_name, CASE WHEN n = (SELECT count(*) FROM events) THEN 'PASS' ELSE 'FAIL' END AS status,
               abs(n - (SELECT count(*) FROM events)) AS n_bad, CAST(n AS VARCHAR) AS example FROM (SELECT count(*) AS n FROM timeline)""",
            *[f"SELECT 'load:nulls:{c}', 'PASS', CAST(0 AS BIGINT), CAST(count(*) FILTER ({c} IS NULL) AS VARCHAR) FROM timeline" for c in ("dv", "da")],
        ),
    ),
)
def _(t: Tables):
    return audits.row_counts_kept(t.raw("events"), t.timeline, ["dv", "da"])


@query(
    "audit_log",
    sql("", both(constant("log:columns"), "SELECT 'log:row' AS check_name, 'PASS' AS status, CAST(0 AS BIGINT) AS n_bad, '' AS example FROM events HAVING count(*) > 0")),
)
def _(t: Tables):
    from tideline.operators import metrics
    from tideline.sources import sinks

    log = sinks.log_rows(metrics.regression_errors(t.level_preds, ["v"]), task="levels", run_id="r1", seed=42)
    names = [c.strip().split(" ")[0] for c in LOG_SCHEMA.split(",")]
    return audits.log_audit(log, names, "levels", "r1", 42)


@query(
    "audit_degenerate_predictions",
    sql(
        "anchor_preds",
        both(
            *[
                f"SELECT 'varies:{c}' AS check_name, CASE WHEN max({x}) - min({x}) > 1e-9 THEN 'PASS' ELSE 'WARN' END AS status, CAST(NOT coalesce(max({x}) - min({x}) > 1e-9, false) AS BIGINT) AS n_bad, '' AS example FROM anchor_preds"
                for c, x in (("dv_pred", "dv_pred"), ("flat", "0.5"))
            ]
        ),
    ),
)
def _(t: Tables):
    return audits.degenerate_predictions(t.stored_preds.withColumn("flat", F.lit(0.5)), ["dv_pred", "flat"])


@query(
    "audit_submission",
    sql(
        "anchor_preds",
        both(
            """SELECT 'submission:rows' AS check_name, CASE WHEN n = users THEN 'PASS' ELSE 'FAIL' END AS status, abs(n - users) AS n_bad, CAST(n AS VARCHAR) AS example
               FROM (SELECT count(*) AS n FROM damaged), (SELECT count(DISTINCT user_id) AS users FROM events)""",
            constant("submission:unique"),
            finding("submission:bounds", "dv_pred IS NULL OR NOT isfinite(dv_pred) OR dv_pred < -10 OR dv_pred > 10 OR da_pred < -50 OR da_pred > 50", USER, "damaged"),
        ),
        damaged=DAMAGED,
    ),
)
def _(t: Tables):
    users = t.raw("events").agg(F.countDistinct("user_id")).scalar()
    return audits.submission_audit(damaged(t), ["user_id"], {"dv_pred": (-10, 10), "da_pred": (-50, 50)}, users)


@query(
    "audit_label_as_feature",
    sql(
        "",
        both(
            constant("leakage:label_as_feature", 1, "dv_target"),
            "SELECT 'timeline:non_empty', CASE WHEN count(*) > 0 THEN 'PASS' ELSE 'FAIL' END, CAST(count(*) = 0 AS BIGINT), '' FROM events",
        ),
    ),
)
def _(t: Tables):
    names = [*feature_columns(EVENTS), "dv_target"]
    checked = audits.label_in_features(t.timeline, names, ["dv_target"])
    return audits.report(checked, audits.non_empty(tables.require_columns(t.timeline, ["dv", "da"], "timeline"), "timeline"))

