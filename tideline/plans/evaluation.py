"""Queries over evaluation metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.operators import aggregates, comparison, metrics, profiles, splits, text_ridge, windows
from tideline.plans.fixtures import EVENTS, OK, Tables, r6, sql
from tideline.plans.models import PRED_SCORE
from tideline.plans.registry import query
from tideline.scale import join_one_row_per_key
from tideline.timeline import Timeline


def safe_r(x: str, y: str) -> str:
    return f"coalesce(covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0), 0)"


def errors(columns: list[str]) -> str:
    return ", ".join(
        f"{r6(f'avg(abs({c} - {c}_pred))', f'mae_{c}')}, {r6(f'avg(({c} - {c}_pred) ** 2)', f'mse_{c}')}, {r6(f'corr({c}, {c}_pred)', f'r_{c}')}"
        for c in columns
    )


SLICED = "SELECT *, unnest(['all', CASE WHEN flag THEN 'words' ELSE 'essays' END]) AS slice FROM level_preds"
PER_USER = "SELECT {by} user_id, count(*) AS n, " + ", ".join(
    f"{safe_r(c, c + '_pred')} AS r_{c}, avg({c}) AS t_{c}, avg({c}_pred) AS p_{c}, sum(abs({c} - {c}_pred)) AS ae_{c}, sum(({c} - {c}_pred) ** 2) AS se_{c}"
    for c in ("v", "a")
) + " FROM {src} GROUP BY {by} user_id"
WITHIN = {c: f"coalesce(avg(r_{c}) FILTER (n >= 2), 0)" for c in ("v", "a")}
BETWEEN = {c: safe_r(f"t_{c}", f"p_{c}") for c in ("v", "a")}
COMPOSITE = "CAST(sum(n) AS BIGINT) AS n, " + ", ".join(
    [
        r6(x, n)
        for c in ("v", "a")
        for x, n in (
            (WITHIN[c], f"r_within_{c}"),
            (BETWEEN[c], f"r_between_{c}"),
            (f"({WITHIN[c]} + {BETWEEN[c]}) / 2", f"r_composite_{c}"),
            (f"sum(ae_{c}) / sum(n)", f"mae_{c}"),
            (f"sum(se_{c}) / sum(n)", f"mse_{c}"),
        )
    ]
    + [r6(f"({WITHIN['v']} + {BETWEEN['v']} + {WITHIN['a']} + {BETWEEN['a']}) / 4", "primary_score")]
)


@query("delta_errors", sql("scored_steps", f"SELECT count(*) AS n, {PRED_SCORE} FROM scored_steps WHERE {OK}"))
def _(t: Tables):
    return metrics.delta_errors(t.scored_steps.where(EVENTS.eligible()), ["dv", "da"])


@query("regression_errors", sql("level_preds", f"SELECT event_type, count(*) AS n, {errors(['v', 'a'])} FROM level_preds GROUP BY event_type"))
def _(t: Tables):
    return metrics.regression_errors(t.level_preds, ["v", "a"], ["event_type"])


@query(
    "safe_correlation",
    sql(
        "",
        f"SELECT o_custkey, {r6(safe_r('o_totalprice', 'd'), 'r')} FROM (SELECT o_custkey, o_totalprice, CAST(CASE WHEN o_custkey % 3 = 0 THEN 1 ELSE o_orderkey % 11 END AS DOUBLE) AS d FROM orders) GROUP BY o_custkey",
    ),
)
def _(t: Tables):
    from tideline.functions.expressions import safe_pearson

    d = F.when(F.col("o_custkey") % 3 == 0, 1).otherwise(F.col("o_orderkey") % 11).cast("double")
    return t.raw("orders").groupBy("o_custkey").agg(safe_pearson(F.col("o_totalprice"), d).alias("r"))


CORR = ", ".join(
    f"{r6(safe_r(c, c + '_pred'), f'r_{c}')}, {r6(f'avg(abs({c} - {c}_pred))', f'mae_{c}')}" for c in ("dv", "da")
)
ANCHORS = "SELECT user_id, anchor_id, dv_true AS dv, da_true AS da, dv_pred, da_pred FROM anchor_preds"


@query(
    "delta_correlations",
    sql("anchor_preds", f"SELECT count(*) AS n, {CORR}, {r6('(' + safe_r('dv', 'dv_pred') + ' + ' + safe_r('da', 'da_pred') + ') / 2', 'primary_score')} FROM anchored", anchored=ANCHORS),
)
def _(t: Tables):
    return metrics.correlation_errors(_anchored(t), ["dv", "da"])


def _anchored(t: Tables):
    return t.anchor_preds.withColumnsRenamed({"dv_true": "dv", "da_true": "da"})


@query(
    "within_between_composite",
    sql("level_preds", f"SELECT {COMPOSITE} FROM per_user", per_user=PER_USER.format(by="", src="level_preds")),
)
def _(t: Tables):
    return metrics.composite_correlations(t.level_preds, "user_id", ["v", "a"])


@query(
    "sliced_composite",
    sql("level_preds", f"SELECT slice, {COMPOSITE} FROM per_user GROUP BY slice", sliced=SLICED, per_user=PER_USER.format(by="slice,", src="sliced")),
)
def _(t: Tables):
    return metrics.composite_correlations(metrics.with_slices(t.level_preds, "flag", "words", "essays"), "user_id", ["v", "a"], ["slice"])


@query(
    "metrics_from_stored",
    sql(
        "level_preds user_split",
        f"SELECT slice, {COMPOSITE} FROM per_user GROUP BY slice",
        sliced=SLICED + " JOIN user_split USING (user_id) WHERE part = 'val'",
        per_user=PER_USER.format(by="slice,", src="sliced"),
    ),
)
def _(t: Tables):
    val = t.user_split.where("part = 'val'").select("user_id")
    truth = join_one_row_per_key(t.entries, val, ["user_id"], "left_semi")
    stored = join_one_row_per_key(t.level_preds, val, ["user_id"], "left_semi")
    stored = stored.select("user_id", "event_id", "v_pred", "a_pred")
    return metrics.metrics_from_stored(truth, stored, ["user_id", "event_id"], "user_id", ["v", "a"], "flag")


@query(
    "regime_slice_rows",
    sql(
        "level_preds user_split",
        f"SELECT 'unseen_user' AS regime, slice, count(*) AS n, {errors(['v', 'a'])} FROM sliced JOIN user_split USING (user_id) WHERE part = 'val' GROUP BY slice",
        sliced=SLICED,
    ),
)
def _(t: Tables):
    rows = join_one_row_per_key(t.level_preds, t.user_split, ["user_id"]).where("part = 'val'")
    rows = rows.withColumn("regime", F.lit("unseen_user"))
    return metrics.regression_errors(metrics.with_slices(rows, "flag", "words", "essays"), ["v", "a"], ["regime", "slice"])


@query(
    "user_diagnostics",
    sql(
        "level_preds",
        "SELECT user_id, count(*) AS n, "
        + ", ".join(f"{r6(safe_r(c, c + '_pred'), f'r_{c}')}, {r6(f'avg(abs({c} - {c}_pred))', f'mae_{c}')}" for c in ("v", "a"))
        + " FROM level_preds GROUP BY user_id",
    ),
)
def _(t: Tables):
    return metrics.entity_diagnostics(t.level_preds, "user_id", ["v", "a"])


@query(
    "user_delta_diagnostics",
    sql("scored_steps", f"SELECT user_id, count(*) AS n, {CORR} FROM scored_steps WHERE {OK} GROUP BY user_id"),
)
def _(t: Tables):
    return metrics.entity_diagnostics(t.scored_steps.where(EVENTS.eligible()), "user_id", ["dv", "da"])


FOLD_ROWS = """SELECT *, CASE WHEN (r // 5) % 2 = 0 THEN r % 5 ELSE 4 - r % 5 END AS fold FROM level_preds JOIN
    (SELECT user_id, row_number() OVER (ORDER BY count(*) DESC, user_id) - 1 AS r FROM events GROUP BY user_id) USING (user_id)"""
TIMED = """SELECT *, CASE WHEN i < greatest(1, least(n - 1, floor(n * CAST(0.8 AS DOUBLE)))) THEN 'train' ELSE 'val' END AS part
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM level_preds)"""


@query(
    "regime_report",
    sql(
        "level_preds",
        f"""SELECT 'unseen_user' AS regime, slice, CAST(sum(n) AS BIGINT) AS n, {r6('avg(mae_v)', 'mae_v')}, {r6('avg(r_v)', 'r_v')} FROM per_fold GROUP BY slice
            UNION ALL SELECT 'seen_user', slice, count(*), {r6('avg(abs(v - v_pred))', 'x1')}, {r6('corr(v, v_pred)', 'x2')} FROM (SELECT *, unnest(['all', CASE WHEN flag THEN 'words' ELSE 'essays' END]) AS slice FROM timed WHERE part = 'val') GROUP BY slice""",
        folded=FOLD_ROWS,
        per_fold="SELECT fold, slice, count(*) AS n, avg(abs(v - v_pred)) AS mae_v, corr(v, v_pred) AS r_v FROM (SELECT *, unnest(['all', CASE WHEN flag THEN 'words' ELSE 'essays' END]) AS slice FROM folded) GROUP BY ALL",
        timed=TIMED,
    ),
)
def _(t: Tables):
    """Stored predictions under both regimes: per group fold and on the held-out ends."""
    folds = splits.group_folds(t.raw("events"), "user_id", 5).select("user_id", "fold")
    unseen = metrics.with_slices(join_one_row_per_key(t.level_preds, folds, ["user_id"]), "flag", "words", "essays")
    unseen = metrics.regression_errors(unseen, ["v"], ["fold", "slice"]).withColumn("regime", F.lit("unseen_user"))
    unseen = aggregates.fold_means(unseen, ["regime", "slice"], ["mae_v", "r_v"])
    held = windows.time_split(Timeline(t.level_preds, "user_id", EVENTS.order)).result().where("part = 'val'")
    seen = metrics.regression_errors(metrics.with_slices(held, "flag", "words", "essays"), ["v"], ["slice"])
    seen = seen.withColumn("regime", F.lit("seen_user"))
    return metrics.union_columns(["regime", "slice", "n", "mae_v", "r_v"], unseen, seen)


@query("regime_report_tfidf")
def _(t: Tables):
    """TF-IDF ridge of both targets in both regimes: five group folds of sources, and held-out ends."""
    rows = t.labelled.select("doc_id", "source", "text", "flag", "quality", "toxic")
    parts = []
    for regime, folds, dealt in (
        (comparison.UNSEEN, 5, comparison.unseen_folds(rows, "source", 5)),
        (comparison.SEEN, 1, comparison.seen_fold(rows, "source", ["doc_id"])),
    ):
        scored, _ = text_ridge.cross_fitted(dealt, "fold", folds, ["quality", "toxic"], min_df=2)
        parts.append(scored.withColumns({"model": F.lit("tfidf"), "regime": F.lit(regime)}))
    return comparison.comparison(parts[0].unionByName(parts[1]), ["quality", "toxic"], "flag")


@query(
    "delta_score_with_exclusions",
    sql(
        "anchor_preds user_split",
        f"""SELECT count(*) AS n, {CORR}, {r6('(' + safe_r('dv', 'dv_pred') + ' + ' + safe_r('da', 'da_pred') + ') / 2', 'primary_score')},
            count(DISTINCT user_id) AS n_scored, (SELECT count(*) FROM user_split) - count(DISTINCT user_id) AS n_excluded FROM anchored WHERE dv < 10""",
        anchored=ANCHORS,
    ),
)
def _(t: Tables):
    return metrics.score_with_exclusions(_anchored(t).where("dv < 10"), t.raw("events").select("user_id"), "user_id", ["dv", "da"])


HALF_PRED = """SELECT user_id, avg(v) FILTER (half = 2) - avg(v) FILTER (half = 1) AS v, avg(a) FILTER (half = 2) - avg(a) FILTER (half = 1) AS a,
    arg_max(v, (ts, event_id)) FILTER (half = 1) - avg(v) FILTER (half = 1) AS v_pred, arg_max(a, (ts, event_id)) FILTER (half = 1) - avg(a) FILTER (half = 1) AS a_pred
    FROM halves GROUP BY user_id"""


@query(
    "user_level_score",
    sql(
        "halves",
        "SELECT count(*) AS n, "
        + ", ".join(f"{r6(safe_r(c, c + '_pred'), f'r_{c}')}, {r6(f'avg(abs({c} - {c}_pred))', f'mae_{c}')}" for c in ("v", "a"))
        + f", {r6('(' + safe_r('v', 'v_pred') + ' + ' + safe_r('a', 'a_pred') + ') / 2', 'primary_score')} FROM changes",
        changes=HALF_PRED,
    ),
)
def _(t: Tables):
    p = profiles.half_profile(t.halves, EVENTS)
    c = profiles.half_change(t.halves, EVENTS).withColumnsRenamed({"v_half_change": "v", "a_half_change": "a"})
    guess = p.select("user_id", *[(F.col(x + "_last") - F.col(x + "_mean")).alias(x + "_pred") for x in ("v", "a")])
    return metrics.correlation_errors(c.join(guess, "user_id"), ["v", "a"])


@query(
    "model_comparison",
    sql("level_preds scored_steps", f"SELECT 'affine' AS model, count(*) AS n, {r6('avg(abs(v - v_pred))', 'mae')} FROM level_preds UNION ALL SELECT 'two_lags', count(*), {r6('avg(abs(dv - dv_pred))', 'x')} FROM scored_steps WHERE {OK}"),
)
def _(t: Tables):
    level = metrics.regression_errors(t.level_preds, ["v"]).withColumnRenamed("mae_v", "mae")
    delta = metrics.delta_errors(t.scored_steps.where(EVENTS.eligible()), ["dv"]).withColumnRenamed("mae_dv", "mae")
    return metrics.compare_models({"affine": level, "two_lags": delta}, ["n", "mae"])


HUBER = "CASE WHEN abs({c} - {c}_pred) < 5 THEN 0.5 * ({c} - {c}_pred) ** 2 / 5 ELSE abs({c} - {c}_pred) - 2.5 END"


@query(
    "weighted_losses",
    sql(
        "level_preds",
        " UNION ALL ".join(
            f"SELECT '{k}' AS kind, {r6(f'avg({v})', 'loss_v')}, {r6(f'avg({a})', 'loss_a')}, {r6(f'0.7 * avg({v}) + 0.3 * avg({a})', 'loss')} FROM level_preds"
            for k, v, a in (("mse", "(v - v_pred) ** 2", "(a - a_pred) ** 2"), ("huber", HUBER.format(c="v"), HUBER.format(c="a")))
        ),
    ),
)
def _(t: Tables):
    weights = {"v": 0.7, "a": 0.3}
    rows = [metrics.weighted_loss(t.level_preds, weights, k, 5.0).withColumn("kind", F.lit(k)) for k in ("mse", "huber")]
    return rows[0].unionByName(rows[1])


