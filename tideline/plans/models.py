"""Queries over baselines, blends, model inputs and cross-validation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from tideline.functions import text as tx
from tideline.operators import (
    aggregates, anchors, baselines, comparison, datasets, learn, metrics, moment_ridge, profiles, scoring, splits, text_ridge, windows,
)
from tideline.plans.fixtures import EVENTS, OK, Tables, r6, r6s, sql
from tideline.plans.history import MOMENTUM
from tideline.plans.ingest import TERMS, TOKENS
from tideline.plans.registry import query
from tideline.scale import join_one_row_per_key
from tideline.sources import stored

RESULTS = ["user_id", "event_id", "dv_pred", "da_pred"]
TRAIN_MEANS = """SELECT avg(v) AS mv, avg(a) AS ma FROM entries JOIN user_split USING (user_id) WHERE part = 'train'"""


@query(
    "mean_baseline",
    sql("entries user_split", f"SELECT event_id, {r6('mv', 'v_pred')}, {r6('ma', 'a_pred')} FROM entries JOIN user_split USING (user_id), means WHERE part = 'val'", means=TRAIN_MEANS),
)
def _(t: Tables):
    rows = join_one_row_per_key(t.entries, t.user_split, ["user_id"])
    means = baselines.fit_mean(rows.where("part = 'train'"), ["v", "a"])
    return baselines.predict_mean(rows.where("part = 'val'"), means, ["v", "a"]).select("event_id", "v_pred", "a_pred")


@query(
    "mean_baseline_scores",
    sql(
        "entries user_split",
        f"""SELECT count(*) AS n, {r6('avg(abs(v - mv))', 'mae_v')}, {r6('avg((v - mv) ** 2)', 'mse_v')}, CAST(NULL AS DOUBLE) AS r_v,
            {r6('avg(abs(a - ma))', 'mae_a')}, {r6('avg((a - ma) ** 2)', 'mse_a')}, CAST(NULL AS DOUBLE) AS r_a
            FROM entries JOIN user_split USING (user_id), means WHERE part = 'val'""",
        means=TRAIN_MEANS,
    ),
)
def _(t: Tables):
    rows = join_one_row_per_key(t.entries, t.user_split, ["user_id"])
    means = baselines.fit_mean(rows.where("part = 'train'"), ["v", "a"])
    return metrics.regression_errors(baselines.predict_mean(rows.where("part = 'val'"), means, ["v", "a"]), ["v", "a"])


@query("two_lag_fit", sql("two_lag_model", f"SELECT delta, {r6s('intercept coef_1 coef_2')}, fit_rows, n_users FROM two_lag_model"))
def _(t: Tables):
    return t.two_lag_model


@query("two_lag_predictions", sql("scored_steps", f"SELECT user_id, event_id, {r6s('dv_pred da_pred')} FROM scored_steps"))
def _(t: Tables):
    return t.scored_steps.select(*RESULTS)


LAGS = """SELECT *, lag(dv) OVER w AS dv_lag, lag(da) OVER w AS da_lag FROM timeline WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"""
ONE_LAG = """SELECT regr_intercept(dv, dv_lag) AS iv, regr_slope(dv, dv_lag) AS bv, regr_intercept(da, da_lag) AS ia, regr_slope(da, da_lag) AS ba
    FROM lags JOIN user_split USING (user_id) WHERE part = 'train'"""
FORECAST = """SELECT user_id, event_id, ts, iv + bv * coalesce(dv_lag, 0) AS dv_pred, ia + ba * coalesce(da_lag, 0) AS da_pred
    FROM lags JOIN cutoffs USING (user_id), one_lag WHERE ts < cutoff QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"""


def forecast(t: Tables):
    rows = windows.lagged_delta(windows.timeline(t.timeline, EVENTS), EVENTS).result()
    model = baselines.fit_one_lag(datasets.train_rows(rows, t.user_split, ["user_id"]), EVENTS)
    found = anchors.forecast_anchors(rows, EVENTS, cutoffs=t.cutoffs, check=False)
    return baselines.predict_one_lag(found, model, EVENTS)


@query(
    "one_lag_fit",
    sql("timeline user_split", f"SELECT 'dv' AS delta, {r6('iv', 'intercept')}, {r6('bv', 'coef')}, (SELECT CAST(regr_count(dv, dv_lag) AS BIGINT) FROM lags JOIN user_split USING (user_id) WHERE part = 'train') AS fit_rows FROM one_lag UNION ALL SELECT 'da', {r6('ia')}, {r6('ba')}, (SELECT CAST(regr_count(da, da_lag) AS BIGINT) FROM lags JOIN user_split USING (user_id) WHERE part = 'train') FROM one_lag".replace(" AS ia", "").replace(" AS ba,", ","),
        lags=LAGS, one_lag=ONE_LAG),
)
def _(t: Tables):
    rows = windows.lagged_delta(windows.timeline(t.timeline, EVENTS), EVENTS).result()
    return baselines.fit_one_lag(datasets.train_rows(rows, t.user_split, ["user_id"]), EVENTS)


@query(
    "forecast_at_cutoff",
    sql("timeline user_split cutoffs", f"SELECT user_id, event_id AS anchor_id, epoch_us(ts) AS anchor_ts, {r6s('dv_pred da_pred')} FROM forecast", lags=LAGS, one_lag=ONE_LAG, forecast=FORECAST),
)
def _(t: Tables):
    return forecast(t).select(
        "user_id", F.col("event_id").alias("anchor_id"), F.col("ts").alias("anchor_ts"), "dv_pred", "da_pred"
    )


ZERO_SCORE = ", ".join(
    f"{r6(f'avg(abs({d} - {p}))', f'mae_{d}')}, {r6(f'avg(({d} - {p}) ** 2)', f'mse_{d}')}, {r6(f'avg(CASE WHEN sign({d}) = sign({p}) THEN 1.0 ELSE 0.0 END)', f'sign_{d}')}"
    for d, p in (("dv", "CAST(0 AS DOUBLE)"), ("da", "CAST(0 AS DOUBLE)"))
)
PRED_SCORE = ", ".join(
    f"{r6(f'avg(abs({d} - {d}_pred))', f'mae_{d}')}, {r6(f'avg(({d} - {d}_pred) ** 2)', f'mse_{d}')}, {r6(f'avg(CASE WHEN {d} IS NULL OR {d}_pred IS NULL THEN NULL WHEN sign({d}) = sign({d}_pred) THEN 1.0 ELSE 0.0 END)', f'sign_{d}')}"
    for d in ("dv", "da")
)


@query("zero_baseline", sql("timeline", f"SELECT count(*) AS n, {ZERO_SCORE} FROM timeline WHERE {OK}"))
def _(t: Tables):
    rows = t.timeline.where(EVENTS.eligible())
    return metrics.delta_errors(baselines.predict_zero(rows, ["dv", "da"]), ["dv", "da"])


@query("momentum_baseline", sql("timeline", f"SELECT count(*) AS n, {PRED_SCORE} FROM momentum WHERE {OK}", momentum=MOMENTUM))
def _(t: Tables):
    rows = windows.momentum(windows.timeline(t.timeline, EVENTS), EVENTS).result()
    return metrics.delta_errors(rows.where(EVENTS.eligible()), ["dv", "da"])


MEAN_SCORE = ", ".join(
    f"{r6(f'avg(abs({d} - m_{d}))', f'mae_{d}')}, {r6(f'avg(({d} - m_{d}) ** 2)', f'mse_{d}')}, {r6(f'avg(CASE WHEN {d} IS NULL THEN NULL WHEN sign({d}) = sign(m_{d}) THEN 1.0 ELSE 0.0 END)', f'sign_{d}')}"
    for d in ("dv", "da")
)


@query(
    "baseline_comparison",
    sql(
        "timeline",
        f"""SELECT 'zero' AS model, count(*) AS n, {ZERO_SCORE} FROM timeline WHERE {OK}
            UNION ALL BY NAME SELECT 'mean' AS model, count(*) AS n, {MEAN_SCORE}
              FROM timeline, (SELECT avg(dv) AS m_dv, avg(da) AS m_da FROM timeline WHERE {OK}) WHERE {OK}
            UNION ALL BY NAME SELECT 'momentum' AS model, count(*) AS n, {PRED_SCORE} FROM momentum WHERE {OK}""",
        momentum=MOMENTUM,
    ),
)
def _(t: Tables):
    rows = t.timeline.where(EVENTS.eligible())
    moved = windows.momentum(windows.timeline(t.timeline, EVENTS), EVENTS).result().where(EVENTS.eligible())
    scored = {
        "zero": baselines.predict_zero(rows, ["dv", "da"]),
        "mean": baselines.predict_mean(rows, baselines.fit_mean(rows, ["dv", "da"]), ["dv", "da"]),
        "momentum": moved,
    }
    tables = {name: metrics.delta_errors(df, ["dv", "da"]) for name, df in scored.items()}
    return metrics.compare_models(tables, ["n", *[f"{m}_{d}" for d in ("dv", "da") for m in ("mae", "mse", "sign")]])


RIDGE = """SELECT mx, my, sxy / (sxx + 1.0) AS b FROM (SELECT avg(x) AS mx, avg(y) AS my, covar_pop(x, y) * count(*) AS sxy, var_pop(x) * count(*) AS sxx FROM train)"""


@query(
    "ridge_one_feature",
    sql(
        "docs labelled",
        f"SELECT doc_id, {r6('my + b * (x - mx)', 'quality_pred')} FROM (SELECT doc_id, CAST({TOKENS} AS DOUBLE) AS x FROM labelled), ridge",
        train=f"SELECT CAST({TOKENS} AS DOUBLE) AS x, quality AS y FROM labelled WHERE flag",
        ridge=RIDGE,
    ),
)
def _(t: Tables):
    rows = t.labelled.withColumn("x", tx.token_count(F.col("text")).cast("double")).select("doc_id", "flag", "x", "quality")
    rows = learn.assemble(rows, ["x"])
    models = learn.fit_ridge(rows.where("flag"), "features", ["quality"])
    return learn.apply_models(rows, models).select("doc_id", "quality_pred")


def _doc_features(t: Tables):
    rows = tx.text_features(t.labelled)
    rows = rows.select("doc_id", "text", "flag", "source", "quality", "toxic", *[F.col(c).cast("double").alias(c) for c in ("n_tokens", "n_chars", "n_marks", "flag_int")])
    return rows.withColumn("fold", splits.row_fold([F.col("doc_id")], 5))


FOLD = "CAST(('0x' || substr(md5(concat(doc_id, ':42')), 1, 8)) AS BIGINT) % 5"
LABELS = ["quality", "toxic"]


def gram_sql(numbers: str, size: int, plan: str = "SELECT k, fold FROM range(5) a(k), range(5) b(fold) WHERE k <> fold") -> dict[str, str]:
    """Centred products per model of ``plan`` (k, fold to fit on) of ``numbers`` (fold, z): z is 1, features, targets."""
    return {
        "numbers": numbers,
        "plan": plan,
        "gram": f"SELECT fold, i, j, sum(z[i] * z[j]) AS g FROM numbers, range(1, {size + 1}) a(i), range(1, {size + 1}) b(j) GROUP BY ALL",
        "train": "SELECT k, i, j, sum(g) AS g FROM gram JOIN plan USING (fold) GROUP BY ALL",
        "centred": """SELECT t.k, t.i, t.j, t.g - a.g * b.g / n.g AS s FROM train t JOIN train n ON n.k = t.k AND n.i = 1 AND n.j = 1
                      JOIN train a ON a.k = t.k AND a.i = 1 AND a.j = t.i JOIN train b ON b.k = t.k AND b.i = 1 AND b.j = t.j""",
        "centres": "SELECT k, list(g / n ORDER BY j) AS c FROM (SELECT t.k, t.j, t.g, n.g AS n FROM train t JOIN train n ON n.k = t.k AND n.i = 1 AND n.j = 1 WHERE t.i = 1) GROUP BY k",
    }


def ridge_sql(size: int, use: list[int], prefix: str = "") -> dict[str, str]:
    """The table ``scored`` of the ridge models of ``gram_sql`` that use some places of z, two targets at its end.

    The systems are eliminated row by row in a recursive query.
    """
    rows, d = ", ".join(map(str, use)), len(use)
    value = lambda w, t: f"c[{t}] + list_sum(list_transform({w}, lambda w, i: w * (z[([{rows}])[i]] - c[([{rows}])[i]])))"
    return {
        prefix + "matrix": f"""SELECT k, list(r ORDER BY i) AS m FROM (SELECT k, i, list(s + CASE WHEN i = j THEN 1.0 ELSE 0.0 END ORDER BY j) AS r
                      FROM centred WHERE i IN ({rows}) AND j IN ({rows}, {size - 1}, {size}) GROUP BY k, i) GROUP BY k""",
        prefix + "steps": f"""SELECT k, 1 AS p, m FROM {prefix}matrix UNION ALL SELECT k, p + 1, list_transform(m, lambda r, i: CASE WHEN i = p
                     THEN list_transform(r, lambda v: v / r[p]) ELSE list_transform(r, lambda v, j: v - r[p] / m[p][p] * m[p][j]) END) FROM {prefix}steps WHERE p <= {d}""",
        prefix + "solved": f"SELECT k, list_transform(m, lambda r: r[{d + 1}]) AS w1, list_transform(m, lambda r: r[{d + 2}]) AS w2 FROM {prefix}steps WHERE p = {d + 1}",
        prefix + "scored": f"""SELECT numbers.*, z[{size - 1}] AS quality, z[{size}] AS toxic, {value("w1", size - 1)} AS quality_pred, {value("w2", size)} AS toxic_pred
                      FROM numbers JOIN {prefix}solved ON k = fold JOIN centres USING (k)""",
    }


def recursive(text: str) -> str:
    return text.replace("WITH ", "WITH RECURSIVE ", 1)


RAW_ERRORS = ", ".join(
    f"avg(abs({c} - {c}_pred)) AS mae_{c}, avg(({c} - {c}_pred) ** 2) AS mse_{c}, covar_pop({c}, {c}_pred) / nullif(stddev_pop({c}) * stddev_pop({c}_pred), 0) AS r_{c}"
    for c in LABELS
)
FOLD_ERRORS = ", ".join(
    f"{r6(f'avg(abs({c} - {c}_pred))', f'mae_{c}')}, {r6(f'avg(({c} - {c}_pred) ** 2)', f'mse_{c}')}, {r6(f'covar_pop({c}, {c}_pred) / nullif(stddev_pop({c}) * stddev_pop({c}_pred), 0)', f'r_{c}')}"
    for c in LABELS
)


NUMERIC = ["n_tokens", "n_chars", "n_marks", "flag_int"]


@query(
    "mean_cross_validation",
    sql(
        "labelled",
        f"""SELECT 'mean' AS model, CAST(k AS INTEGER) AS fold, count(*) AS n, {r6('avg(abs(quality - m))', 'mae_quality')}, {r6('avg((quality - m) ** 2)', 'mse_quality')}, CAST(NULL AS DOUBLE) AS r_quality
            FROM rows_folded JOIN (SELECT k, avg(quality) AS m FROM range(5) r(k) JOIN rows_folded ON fold <> k GROUP BY k) ON fold = k GROUP BY k""",
        rows_folded="SELECT quality, CAST(('0x' || substr(md5(concat(doc_id, ':42')), 1, 8)) AS BIGINT) % 5 AS fold FROM labelled",
    ),
)
def _(t: Tables):
    rows = t.labelled.select("quality", splits.row_fold([F.col("doc_id")], 5).alias("fold"))
    return learn.cross_validate(rows, "fold", 5, {"mean": learn.fit_predict_mean}, ["quality"])


DOC_NUMBERS = f"""SELECT doc_id, {FOLD} AS fold, [1.0, CAST({TOKENS} AS DOUBLE), CAST(length(text) AS DOUBLE),
    CAST(len(regexp_extract_all(text, '[.!?]')) AS DOUBLE), CAST(flag AS DOUBLE), quality, toxic] AS z FROM labelled"""


@query(
    "ridge_cross_validation",
    recursive(sql("labelled", f"SELECT 'ridge' AS model, CAST(fold AS INTEGER) AS fold, count(*) AS n, {FOLD_ERRORS} FROM scored GROUP BY fold", **gram_sql(DOC_NUMBERS, 7), **ridge_sql(7, [2, 3, 4, 5]))),
)
def _(t: Tables):
    numbers = F.array(*[F.col(c) for c in NUMERIC])
    scored = moment_ridge.cross_fitted(_doc_features(t), "fold", 5, numbers, len(NUMERIC), LABELS)
    found = metrics.regression_errors(scored, LABELS, ["fold"])
    return found.select(F.lit("ridge").alias("model"), *found.columns)


REGIMES = """SELECT 'unseen_user' AS regime, labelled.*, CASE WHEN (r // 5) % 2 = 0 THEN r % 5 ELSE 4 - r % 5 END AS fold FROM labelled JOIN
    (SELECT source, row_number() OVER (ORDER BY count(*) DESC, source) - 1 AS r FROM labelled GROUP BY source) USING (source)
    UNION ALL SELECT 'seen_user', * EXCLUDE (i, n), CASE WHEN i < greatest(1, least(n - 1, floor(n * CAST(0.8 AS DOUBLE)))) OR n <= 1 THEN 6 ELSE 5 END
    FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM labelled)"""
REGIME_PLAN = "SELECT k, fold FROM range(5) a(k), range(5) b(fold) WHERE k <> fold UNION ALL SELECT 5, 6"
REGIME_NUMBERS = DOC_NUMBERS.replace(f"{FOLD} AS fold", "regime, flag, fold").replace("FROM labelled", "FROM regimes")
REGIME_MEANS = ", ".join(r6(f"avg({m}_{c})", f"{m}_{c}") for c in LABELS for m in ("mae", "mse", "r"))
SCORED_MODELS = """SELECT 'mean' AS model, regime, fold, flag, z[6] AS quality, z[7] AS toxic, c[6] AS quality_pred, c[7] AS toxic_pred FROM numbers JOIN centres ON k = fold
    UNION ALL SELECT 'length', regime, fold, flag, quality, toxic, quality_pred, toxic_pred FROM length_scored
    UNION ALL SELECT 'ridge', regime, fold, flag, quality, toxic, quality_pred, toxic_pred FROM ridge_scored"""


@query(
    "regime_comparison",
    recursive(sql(
        "labelled",
        f"SELECT model, regime, slice, CAST(sum(n) AS BIGINT) AS n, {REGIME_MEANS} FROM per_fold GROUP BY ALL",
        regimes=REGIMES,
        **gram_sql(REGIME_NUMBERS, 7, REGIME_PLAN),
        **ridge_sql(7, [2], "length_"),
        **ridge_sql(7, [2, 3, 4, 5], "ridge_"),
        scored_models=SCORED_MODELS,
        per_fold=f"""SELECT model, regime, slice, fold, count(*) AS n, {RAW_ERRORS} FROM
                 (SELECT *, unnest(['all', CASE WHEN flag THEN 'words' ELSE 'essays' END]) AS slice FROM scored_models) GROUP BY model, regime, slice, fold""",
    )),
)
def _(t: Tables):
    models = {"mean": [], "length": ["n_tokens"], "ridge": NUMERIC}
    long = comparison.moment_predictions(_doc_features(t).drop("fold"), "source", ["doc_id"], models, LABELS)
    return comparison.comparison(long, LABELS, "flag")


HALF_TARGETS = ["v_half_change", "a_half_change"]


def _half_rows(t: Tables):
    """A row per user with its profile, its targets and a fold; written, since each fold's fit reads it many times."""
    columns = profiles.profile_columns(EVENTS)
    rows = profiles.half_profile(t.halves, EVENTS).join(profiles.half_change(t.halves, EVENTS), "user_id")
    rows = rows.withColumn("fold", splits.row_fold([F.col("user_id")], 5))
    return columns, stored.once(rows.select("user_id", "fold", *[F.col(c).cast("double").alias(c) for c in columns], *HALF_TARGETS))


@query("forest_cross_validation")
def _(t: Tables):
    columns, rows = _half_rows(t)
    return learn.cross_validate(rows, "fold", 5, {"forest": learn.fit_predict_forest(columns, key=["user_id"])}, HALF_TARGETS)


# The numbers of a half profile in SQL, for targets v and a.
PROFILE_SQL = {
    "mean": "avg({c})", "last": "arg_max({c}, (ts, event_id))", "std": "stddev_pop({c})",
    "change": "arg_max({c}, (ts, event_id)) - arg_min({c}, (ts, event_id))",
    "slope": "CASE WHEN count(*) > 1 THEN regr_slope({c}, entry_index) ELSE 0 END",
}
HALF_NUMBERS = f"""SELECT user_id, CAST(('0x' || substr(md5(concat(user_id, ':42')), 1, 8)) AS BIGINT) % 5 AS fold, list_concat(z, [v, a]) AS z FROM
    (SELECT user_id, CAST([1.0, {", ".join(e.format(c=c) for e in PROFILE_SQL.values() for c in ("v", "a"))}, count(*), max(n_total), max(cut)] AS DOUBLE[]) AS z
     FROM halves WHERE half = 1 GROUP BY user_id)
    JOIN (SELECT user_id, avg(v) FILTER (half = 2) - avg(v) FILTER (half = 1) AS v, avg(a) FILTER (half = 2) - avg(a) FILTER (half = 1) AS a FROM halves GROUP BY user_id) USING (user_id)"""
HALF_ERRORS = [f"{m}_{t}" for t in HALF_TARGETS for m in ("mae", "mse")]


@query(
    "half_change_comparison",
    recursive(sql(
        "halves",
        "SELECT model, " + ", ".join(f"{r6(f'avg({c})', c + '_mean')}, {r6(f'stddev_samp({c})', c + '_std')}" for c in HALF_ERRORS) + " FROM per_fold GROUP BY model",
        **gram_sql(HALF_NUMBERS, 16),
        **ridge_sql(16, list(range(2, 15))),
        per_fold="SELECT model, " + ", ".join(
            f"avg(abs({c} - {c}_pred)) AS mae_{c}_half_change, avg(({c} - {c}_pred) ** 2) AS mse_{c}_half_change" for c in ("v", "a")
        ) + """ FROM (SELECT 'mean' AS model, fold, z[15] AS v, z[16] AS a, c[15] AS v_pred, c[16] AS a_pred FROM numbers JOIN centres ON k = fold
            UNION ALL SELECT 'ridge', fold, quality, toxic, quality_pred, toxic_pred FROM scored) GROUP BY model, fold""",
    )),
)
def _(t: Tables):
    """Mean and deviation over folds of the errors of the mean and of the ridge on half profiles."""
    columns = profiles.profile_columns(EVENTS)
    rows = profiles.half_profile(t.halves, EVENTS).join(profiles.half_change(t.halves, EVENTS), "user_id")
    rows = rows.withColumn("fold", splits.row_fold([F.col("user_id")], 5)).select("user_id", "fold", *columns, *HALF_TARGETS)
    numbers = F.array(*[F.col(c).cast("double") for c in columns])
    models = {"mean": [], "ridge": list(range(len(columns)))}
    long = moment_ridge.predictions(rows, "fold", moment_ridge.leave_one_out(5), models, numbers, len(columns), HALF_TARGETS)
    return aggregates.fold_summary(metrics.regression_errors(long, HALF_TARGETS, ["model", "fold"]), ["model"], HALF_ERRORS)


@query(
    "forest_report",
    sql(
        "halves",
        f"""SELECT target, count(*) AS n, count(DISTINCT fold) AS n_folds, true AS within_range, true AS under_mean FROM
            (SELECT user_id, CAST(('0x' || substr(md5(concat(user_id, ':42')), 1, 8)) AS BIGINT) % 5 AS fold FROM
             (SELECT user_id FROM halves GROUP BY user_id HAVING count(*) FILTER (half = 1) > 0 AND count(*) FILTER (half = 2) > 0)),
            (VALUES ('v_half_change'), ('a_half_change')) v(target) GROUP BY target""",
    ),
)
def _(t: Tables):
    """Forests of all folds: rows they score, whether scores stay in the range of the targets, and whether
    their squared error is under that of the training mean."""
    columns, rows = _half_rows(t)
    scored = learn.cross_predict(rows, "fold", 5, learn.fit_predict_forest(columns, key=["user_id"]), HALF_TARGETS)
    means = learn.cross_predict(rows.select("user_id", "fold", *HALF_TARGETS), "fold", 5, learn.fit_predict_mean, HALF_TARGETS)
    means = means.select("user_id", *[F.col(c + "_pred").alias(c + "_mean") for c in HALF_TARGETS])
    both = scored.join(means, "user_id")
    long = both.select("fold", F.inline(F.array(*[
        F.struct(F.lit(c).alias("target"), F.col(c).alias("y"), F.col(c + "_pred").alias("p"), F.col(c + "_mean").alias("m")) for c in HALF_TARGETS
    ])))
    error = lambda c: F.avg((F.col("y") - F.col(c)) * (F.col("y") - F.col(c)))
    return long.groupBy("target").agg(
        F.count(F.lit(1)).alias("n"),
        F.countDistinct("fold").alias("n_folds"),
        ((F.min("p") >= F.min("y") - 1e-3) & (F.max("p") <= F.max("y") + 1e-3)).alias("within_range"),
        (error("p") < error("m")).alias("under_mean"),
    )


TEXT_MODELS = f"""SELECT CAST(k AS INTEGER) AS fold, target, n_train, n_terms, {r6('mean')}, true AS certified FROM
    (SELECT k, count(*) AS n_train, avg(quality) AS quality, avg(toxic) AS toxic FROM range(5) f(k) JOIN folded ON fold <> k GROUP BY k)
    UNPIVOT (mean FOR target IN (quality, toxic))
    JOIN (SELECT k, least(20000, count(*)) AS n_terms FROM (SELECT k, term FROM range(5) f(k) JOIN terms ON fold <> k GROUP BY k, term HAVING count(*) >= 2) GROUP BY k) USING (k)"""
FOLDED = dict(
    folded=f"SELECT doc_id, text, quality, toxic, {FOLD} AS fold FROM labelled",
    terms=TERMS.replace("SELECT doc_id, term, count(*) AS tf", "SELECT doc_id, fold, term").replace("SELECT doc_id, unnest", "SELECT doc_id, fold, unnest").replace("SELECT doc_id, regexp", "SELECT doc_id, fold, regexp").replace("FROM docs", "FROM folded"),
)


def _text_models(t: Tables, numeric: list[str] | None = None):
    return text_ridge.cross_fitted(_doc_features(t), "fold", 5, LABELS, numeric=numeric, min_df=2)


def _text_certificates(t: Tables, numeric: list[str] | None = None):
    """What each model was fitted on, and whether the length of its gradient, computed from all rows
    after the solve, is under the bound: weights are then exact to that bound."""
    _, models = _text_models(t, numeric)
    certified = F.col("gradient") <= text_ridge.GRADIENT
    return models.select("fold", "target", "n_train", "n_terms", "mean", certified.alias("certified"))


@query("tfidf_ridge")
def _(t: Tables):
    return _text_models(t)[0].select("doc_id", "fold", "quality", "quality_pred", "toxic", "toxic_pred")


@query("tfidf_numeric_ridge")
def _(t: Tables):
    return _text_models(t, ["n_marks", "flag_int"])[0].select("doc_id", "fold", "quality", "quality_pred", "toxic", "toxic_pred")


@query("tfidf_ridge_models", sql("labelled", TEXT_MODELS, **FOLDED))
def _(t: Tables):
    return _text_certificates(t)


@query("tfidf_numeric_ridge_models", sql("labelled", TEXT_MODELS, **FOLDED))
def _(t: Tables):
    return _text_certificates(t, ["n_marks", "flag_int"])


VECTOR_NUMBERS = f"""SELECT doc_id, {FOLD} AS fold, list_concat([1.0], list_concat(CAST(embedding AS DOUBLE[]), [quality, toxic])) AS z
    FROM labelled JOIN embeddings ON vec_id = doc_id"""


@query(
    "embedding_ridge",
    recursive(sql("labelled", f"SELECT 'embedding' AS model, CAST(fold AS INTEGER) AS fold, count(*) AS n, {FOLD_ERRORS} FROM scored GROUP BY fold", **gram_sql(VECTOR_NUMBERS, 67), **ridge_sql(67, list(range(2, 66))))),
)
def _(t: Tables):
    rows = t.labelled.join(t.vectors, "doc_id").select("doc_id", "quality", "toxic", "vec")
    rows = rows.withColumn("fold", splits.row_fold([F.col("doc_id")], 5))
    found = metrics.regression_errors(moment_ridge.cross_fitted(rows, "fold", 5, F.col("vec"), 64, LABELS), LABELS, ["fold"])
    return found.select(F.lit("embedding").alias("model"), *found.columns)


@query(
    "residual_and_recomposed",
    sql("scored_steps", f"SELECT event_id, {r6('dv - dv_pred', 'dv_resid')}, {r6('dv_pred + 0.5 * (dv - dv_pred)', 'dv_pred')} FROM scored_steps WHERE {OK}"),
)
def _(t: Tables):
    rows = t.scored_steps.where(EVENTS.eligible()).withColumnsRenamed({"dv_pred": "dv_base", "da_pred": "da_base"})
    rows = baselines.residuals(rows, ["dv"]).withColumn("dv_resid_pred", 0.5 * F.col("dv_resid"))
    return baselines.recompose(rows, ["dv"]).select("event_id", "dv_resid", "dv_pred")


@query(
    "blend",
    sql(
        "anchor_preds timeline user_split cutoffs",
        f"""SELECT user_id, {r6('0.25 * p.dv_pred + 0.75 * f.dv_pred', 'dv_pred')}, {r6('0.5 * p.da_pred + 0.5 * f.da_pred', 'da_pred')}
            FROM anchor_preds p JOIN forecast f USING (user_id)""",
        lags=LAGS, one_lag=ONE_LAG, forecast=FORECAST,
    ),
)
def _(t: Tables):
    return baselines.blend(t.stored_preds, forecast(t), {"dv_pred": 0.25, "da_pred": 0.5}, "user_id")


@query(
    "ensemble_mean",
    sql("level_preds", f"SELECT event_id, {r6('(v_pred + v + a) / 3', 'p')} FROM level_preds"),
)
def _(t: Tables):
    tables = [t.level_preds.select("event_id", F.col(c).alias("p")) for c in ("v_pred", "v", "a")]
    return baselines.ensemble(tables, ["event_id"], ["p"])


@query(
    "anchor_predictions",
    sql("anchor_preds", f"SELECT user_id, anchor_id, epoch_us(anchor_ts) AS anchor_ts, {r6s('dv_true da_true dv_pred da_pred')} FROM anchor_preds"),
)
def _(t: Tables):
    return t.anchor_preds


@query(
    "submission",
    sql("anchor_preds", f"SELECT user_id, {r6('dv_pred', 'pred_dv')}, {r6('da_pred', 'pred_da')} FROM anchor_preds ORDER BY user_id"),
)
def _(t: Tables):
    return baselines.submission(
        t.stored_preds, ["user_id"], {"dv_pred": "pred_dv", "da_pred": "pred_da"}, expected=t.raw("events").select("user_id")
    )


def load_length_scorer():
    """A stand-in for a user's model: scores a batch of texts from their lengths."""

    def score(batch: pd.DataFrame) -> pd.DataFrame:
        size = batch["text"].str.len()
        marks = batch["text"].str.count(r"[.!?]")
        return pd.DataFrame({"doc_id": batch["doc_id"], "score": marks / (size + 1.0)})

    return score


@query(
    "score_batches",
    sql("docs", f"SELECT doc_id, {r6("len(regexp_extract_all(text, '[.!?]')) / (length(text) + 1.0)", 'score')} FROM docs"),
)
def _(t: Tables):
    return scoring.score_batches(t.docs, load_length_scorer, ["doc_id", "text"], "doc_id bigint, score double")


def steps(t: Tables, **options):
    return datasets.step_dataset(
        t.gappy, t.doc_vectors_keyed, t.user_split, ["user_id"], EVENTS, "vec", 5, windows.zero_vector(64), ["user_id", "event_id"], **options
    )



@query(
    "step_dataset",
    sql(
        "history two_lag_model user_split",
        f"""SELECT user_id, event_id, part, CAST(least(i, 5) AS INTEGER) AS seq_len, {r6s('dv da')}, {r6('dv - CAST(dv_base AS FLOAT)', 'dv_resid')},
            {r6('(history_len - m) / s', 'history_len')} FROM
            (SELECT h.*, part, m.intercept + m.coef_1 * coalesce(dv_prev, 0) + m.coef_2 * coalesce(da_prev, 0) AS dv_base,
             row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i
             FROM history h JOIN user_split USING (user_id), (SELECT * FROM two_lag_model WHERE delta = 'dv') m),
            (SELECT avg(history_len) AS m, stddev_pop(history_len) AS s FROM history JOIN user_split USING (user_id) WHERE part = 'train' AND {OK})
            WHERE {OK}""",
    ),
)
def _(t: Tables):
    done = steps(t)
    return done.select("user_id", "event_id", "part", "seq_len", "dv", "da", "dv_resid", "history_len")


@query(
    "anchor_dataset",
    sql(
        "history",
        f"""SELECT user_id, event_id, CAST(least(i, 5) AS INTEGER) AS seq_len, CAST(history_len AS DOUBLE) AS history_len
            FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM history) WHERE {OK}
            QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
    ),
)
def _(t: Tables):
    chosen = anchors.latest_eligible(t.timeline, EVENTS)
    found = datasets.anchor_dataset(steps(t, normalise=False), chosen, ["user_id", "event_id"])
    return found.select("user_id", "event_id", "seq_len", "history_len")
