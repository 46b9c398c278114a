"""Queries over joins, set operations, aggregates and top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.functions.quantiles import exact_quantiles
from tideline.operators import aggregates, anchors, baselines, joins, metrics, profiles, windows
from tideline.plans.fixtures import EVENTS, SOURCES, Tables, r6, r6s, sql
from tideline.plans.registry import query
from tideline.scale import join_one_row_per_key

LATEST = "QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"


@query(
    "join_one_to_one",
    sql("entries timeline", f"SELECT user_id, event_id, {r6('e.v', 'v')}, {r6('t.dv', 'dv')} FROM entries e JOIN timeline t USING (user_id, event_id)"),
)
def _(t: Tables):
    left = t.entries.select("user_id", "event_id", "v")
    return joins.one_to_one(left, t.timeline.select("user_id", "event_id", "dv"), ["user_id", "event_id"])


@query(
    "join_full_coverage",
    sql("docs doc_rows", f"SELECT d.doc_id, d.source, len(vec) AS dim, {r6('CAST(vec[1] AS DOUBLE)', 'first')} FROM doc_rows r JOIN docs d USING (doc_id)"),
)
def _(t: Tables):
    have = t.docs.join(t.vectors.select("doc_id"), "doc_id", "left_semi").select("doc_id", "source")
    found = joins.full_coverage(have, t.vectors, ["doc_id"])
    return found.select("doc_id", "source", F.size("vec").cast("long").alias("dim"), F.col("vec")[0].alias("first"))


@query("join_missing_keys", sql("docs", "SELECT doc_id FROM docs WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)"))
def _(t: Tables):
    return t.docs.select("doc_id").join(t.vectors.select("doc_id"), "doc_id", "left_anti")


@query(
    "join_many_to_one_cutoff",
    sql("entries cutoffs", "SELECT user_id, event_id, epoch_us(cutoff) AS cutoff, ts < cutoff AS is_before FROM entries JOIN cutoffs USING (user_id)"),
)
def _(t: Tables):
    joined = joins.many_to_one(t.entries.select("user_id", "event_id", "ts"), t.cutoffs, ["user_id"])
    return joined.select("user_id", "event_id", "cutoff", (F.col("ts") < F.col("cutoff")).alias("is_before"))


@query(
    "join_left_attributes",
    sql(
        "",
        f"""SELECT c_custkey, c_mktsegment, n_orders, {r6('mean_price')} FROM customer LEFT JOIN
            (SELECT o_custkey AS c_custkey, count(*) AS n_orders, avg(o_totalprice) AS mean_price FROM orders GROUP BY 1) USING (c_custkey)""",
    ),
)
def _(t: Tables):
    orders = t.raw("orders").groupBy(F.col("o_custkey").alias("c_custkey"))
    attributes = orders.agg(F.count(F.lit(1)).alias("n_orders"), F.avg("o_totalprice").alias("mean_price"))
    return joins.one_to_one(t.raw("customer").select("c_custkey", "c_mktsegment"), attributes, ["c_custkey"], "left")


@query(
    "join_marker_rows",
    sql("entries", f"SELECT user_id AS who, event_id AS what, epoch_us(ts) AS ts, {r6('v')} FROM entries {LATEST}"),
)
def _(t: Tables):
    newest = anchors.latest_row(t.raw("events").select("user_id", "ts", "event_id"), EVENTS)
    markers = newest.select(F.col("user_id").alias("who"), F.col("event_id").alias("what"))
    found = joins.marker_rows(markers, t.entries, {"who": "user_id", "what": "event_id"})
    return found.select("who", "what", "ts", "v")


@query(
    "join_aligned",
    sql("anchor_preds", f"SELECT user_id, {r6('dv_pred')}, anchor_id FROM anchor_preds"),
)
def _(t: Tables):
    p = t.stored_preds
    return joins.aligned(p.select("user_id", "dv_pred"), p.select("user_id", "anchor_id"), ["user_id"])


ASOF = f"SELECT user_id, event_id, epoch_us(ts) AS ts, {r6s('v a')} FROM entries JOIN cutoffs USING (user_id) WHERE ts {{op}} cutoff {LATEST}"


@query("asof_before_cutoff", sql("entries cutoffs", ASOF.format(op="<")))
def _(t: Tables):
    return anchors.last_before(t.entries, t.cutoffs, EVENTS).select("user_id", "event_id", "ts", "v", "a")


@query("asof_up_to_cutoff", sql("entries cutoffs", ASOF.format(op="<=")))
def _(t: Tables):
    found = anchors.last_before(t.entries, t.cutoffs, EVENTS, inclusive=True)
    return found.select("user_id", "event_id", "ts", "v", "a")


@query(
    "asof_earliest_of_several",
    sql(
        "entries",
        f"""SELECT user_id, event_id, {r6('v')} FROM entries JOIN
            (SELECT user_id, min(ts) AS cutoff FROM entries WHERE event_type = 'purchase' GROUP BY user_id) USING (user_id)
            WHERE ts < cutoff {LATEST}""",
    ),
)
def _(t: Tables):
    cut = t.entries.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("cutoff"))
    return anchors.last_before(t.entries, cut, EVENTS, check=False).select("user_id", "event_id", "v")


@query(
    "asof_users_without_row",
    sql(
        "entries",
        """SELECT user_id FROM (SELECT user_id, min(ts) AS cutoff FROM entries WHERE event_type = 'purchase' GROUP BY user_id) c
           WHERE NOT EXISTS (SELECT 1 FROM entries e WHERE e.user_id = c.user_id AND e.ts < c.cutoff)""",
    ),
)
def _(t: Tables):
    cut = t.entries.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("cutoff"))
    return anchors.entities_without_row_before(t.entries, cut, EVENTS)


@query(
    "history_up_to_anchor",
    sql(
        "entries cutoffs",
        f"""SELECT user_id, event_id, CAST(back AS INTEGER) AS back, {r6('v')} FROM (SELECT *, row_number() OVER
            (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) - 1 AS back
            FROM entries JOIN cutoffs USING (user_id) WHERE ts <= cutoff) WHERE back < 5""",
    ),
)
def _(t: Tables):
    found = anchors.history_up_to(t.entries, t.cutoffs, EVENTS, 5, "cutoff")
    return found.select("user_id", "event_id", "back", "v")


@query("semi_join_users", sql("entries user_split", "SELECT user_id, event_id FROM entries WHERE user_id IN (SELECT user_id FROM user_split WHERE part = 'val')"))
def _(t: Tables):
    wanted = t.user_split.where("part = 'val'").select("user_id")
    return join_one_row_per_key(t.entries.select("user_id", "event_id"), wanted, ["user_id"], "left_semi")


@query(
    "key_differences",
    sql(
        "",
        """SELECT doc_id, CASE WHEN vec_id IS NULL THEN 'missing' ELSE 'extra' END AS side
           FROM (SELECT coalesce(d.doc_id, e.vec_id) AS doc_id, d.doc_id AS mine, e.vec_id FROM labels d FULL JOIN embeddings e ON e.vec_id = d.doc_id)
           WHERE mine IS NULL OR vec_id IS NULL""",
    ),
)
def _(t: Tables):
    return joins.key_differences(t.raw("labels"), t.vectors, ["doc_id"])


@query(
    "labels_of_users",
    sql(
        "halves",
        f"""SELECT user_id, {r6('avg(v) FILTER (half = 2) - avg(v) FILTER (half = 1)', 'v_half_change')},
            {r6('avg(a) FILTER (half = 2) - avg(a) FILTER (half = 1)', 'a_half_change')} FROM halves
            WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase')
            GROUP BY user_id HAVING count(*) FILTER (half = 1) > 0""",
    ),
)
def _(t: Tables):
    users = t.raw("events").where("event_type = 'purchase'").select("user_id").distinct()
    labels = profiles.half_change(t.halves, EVENTS)
    users = users.join(labels.select("user_id"), "user_id", "left_semi")
    return joins.full_coverage(users, labels, ["user_id"])


@query(
    "rederivation_mismatches",
    sql(
        "entries",
        f"""SELECT user_id, event_id, {r6('w', 'v')} FROM (SELECT user_id, event_id, v,
            CASE WHEN event_id % 97 = 5 THEN v + 1 ELSE v END AS w FROM entries) WHERE w IS DISTINCT FROM v""",
    ),
)
def _(t: Tables):
    changed = F.when(F.col("event_id") % 97 == 5, F.col("v") + 1).otherwise(F.col("v"))
    claims = t.entries.select("user_id", "event_id", changed.alias("v"))
    return joins.mismatches(claims, t.entries, ["user_id", "event_id"], ["v"])


@query(
    "half_means",
    sql(
        "halves",
        f"""SELECT user_id, {r6('avg(v) FILTER (half = 1)', 'v_mean_1')}, {r6('avg(v) FILTER (half = 2)', 'v_mean_2')},
            {r6('avg(a) FILTER (half = 1)', 'a_mean_1')}, {r6('avg(a) FILTER (half = 2)', 'a_mean_2')} FROM halves GROUP BY user_id
            HAVING count(*) FILTER (half = 1) > 0 AND count(*) FILTER (half = 2) > 0""",
    ),
)
def _(t: Tables):
    return joins.pair_means(t.halves, "user_id", "half", ["v", "a"])


@query(
    "union_reports",
    sql(
        "entries labelled",
        f"""SELECT 'events' AS model, {r6('avg(v)', 'v')}, CAST(NULL AS DOUBLE) AS quality FROM entries
            UNION ALL SELECT 'documents', NULL, {r6('avg(quality)')} FROM labelled""".replace("AS avg(quality)", ""),
    ),
)
def _(t: Tables):
    return joins.union_reports(
        t.entries.agg(F.lit("events").alias("model"), F.avg("v").alias("v")),
        t.labelled.agg(F.lit("documents").alias("model"), F.avg("quality").alias("quality")),
    )


@query("intersect_keys", sql("", "SELECT doc_id FROM labels INTERSECT SELECT vec_id FROM embeddings"))
def _(t: Tables):
    return t.raw("labels").select("doc_id").intersect(t.vectors.select("doc_id"))


@query("duplicate_keys", sql("", "SELECT text, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1"))
def _(t: Tables):
    return joins.duplicate_keys(t.raw("documents"), ["text"])


# --- aggregates ------------------------------------------------------------------


@query("group_counts", sql("docs", "SELECT source, count(*) AS n_rows, count(DISTINCT lang) AS n_keys FROM docs GROUP BY source"))
def _(t: Tables):
    return aggregates.group_counts(t.docs, "source", "lang")


@query("user_means", sql("entries", f"SELECT user_id, {r6('avg(v)', 'v_mean')}, {r6('avg(a)', 'a_mean')}, count(*) AS n_rows FROM entries GROUP BY user_id"))
def _(t: Tables):
    return aggregates.entity_means(t.entries, "user_id", ["v", "a"])


@query(
    "describe",
    sql(
        "gappy",
        " UNION ALL ".join(
            f"""SELECT '{c}' AS name, count({c}) AS n, {r6(f'avg({c})', 'mean')}, {r6(f'stddev_samp({c})', 'std')}, {r6(f'min({c})', '"min"')}, {r6(f'max({c})', '"max"')},
            {r6(f'quantile_cont({c}, 0.25)', 'q25')}, {r6(f'quantile_cont({c}, 0.5)', 'q50')}, {r6(f'quantile_cont({c}, 0.75)', 'q75')} FROM gappy"""
            for c in ("v", "a", "dv", "da")
        ),
    ),
)
def _(t: Tables):
    return aggregates.describe(t.gappy, ["v", "a", "dv", "da"])


@query(
    "histogram",
    sql(
        "entries",
        f"""SELECT CAST(b AS INTEGER) AS bin, {r6('lo + b * (hi - lo) / 30', 'left_edge')}, count(v) AS n
            FROM range(30) r(b) CROSS JOIN (SELECT min(v) AS lo, max(v) AS hi FROM entries)
            LEFT JOIN entries ON least(floor((v - lo) / ((hi - lo) / 30)), 29) = b GROUP BY b, lo, hi""",
    ),
)
def _(t: Tables):
    return aggregates.histogram(t.entries, "v", 30)


@query("value_counts", sql("labelled", "SELECT toxic_flag, count(*) AS n FROM (SELECT toxic = 1 AS toxic_flag FROM docs LEFT JOIN labels USING (doc_id)) GROUP BY toxic_flag"))
def _(t: Tables):
    joined = t.docs.join(t.raw("labels"), "doc_id", "left")
    return aggregates.value_counts(joined.select((F.col("toxic") == 1).alias("toxic_flag")), "toxic_flag")


SUMMARY = ", ".join(
    [
        "count(*) AS n",
        "count(*) FILTER (x IS NULL OR isnan(x)) AS nan_count",
        "count(*) FILTER (isinf(x)) AS inf_count",
        *[r6(f"{f}(x)", a) for f, a in (("avg", "mean"), ("stddev_pop", "std"), ("min", '"min"'), ("max", '"max"'))],
        r6("max(abs(x))", "abs_max"),
        *[r6(f"quantile_cont(x, {p})", n) for n, p in aggregates.SUMMARY_QUANTILES.items()],
        r6("quantile_cont(abs(x), 0.99)", "abs_p99"),
    ]
)


@query("array_summary", sql("gappy", f"SELECT event_type, {SUMMARY} FROM (SELECT event_type, dv AS x FROM gappy) GROUP BY event_type"))
def _(t: Tables):
    return aggregates.value_summary(t.gappy, "dv", ["event_type"])


@query(
    "prediction_summary",
    sql(
        "anchor_preds",
        f"""SELECT target, kind, {SUMMARY},
            CASE WHEN kind <> 'resid' THEN round(avg(CASE WHEN x < lo THEN 1.0 ELSE 0.0 END) + 1.3e-9, 6) END AS frac_below,
            CASE WHEN kind <> 'resid' THEN round(avg(CASE WHEN x > hi THEN 1.0 ELSE 0.0 END) + 1.3e-9, 6) END AS frac_above
            FROM long_rows GROUP BY target, kind""",
        long_rows=" UNION ALL ".join(
            f"SELECT '{c}' AS target, '{k}' AS kind, {x} AS x, {lo} AS lo, {hi} AS hi FROM anchor_preds"
            for c, lo, hi in (("dv", -40, 40), ("da", -2, 2))
            for k, x in (("pred", f"{c}_pred"), ("true", f"{c}_true"), ("resid", f"{c}_pred - {c}_true"))
        ),
    ),
)
def _(t: Tables):
    return aggregates.prediction_summary(
        t.stored_preds,
        {"dv": "dv_pred", "da": "da_pred"},
        {"dv": "dv_true", "da": "da_true"},
        {"dv": (-40, 40), "da": (-2, 2)},
    )


@query("prediction_table_sizes", sql("level_preds", "SELECT count(*) AS n_rows, count(DISTINCT user_id) AS n_users FROM level_preds"))
def _(t: Tables):
    return aggregates.table_sizes(t.level_preds, "user_id")


@query(
    "group_quantiles",
    sql("", f"SELECT o_custkey, {r6('quantile_cont(o_totalprice, 0.1)', 'p10')}, {r6('quantile_cont(o_totalprice, 0.9)', 'p90')} FROM orders GROUP BY o_custkey"),
)
def _(t: Tables):
    return exact_quantiles(t.raw("orders"), ["o_custkey"], "o_totalprice", {"p10": 0.1, "p90": 0.9})


FOLDS = "(CAST(('0x' || substr(md5(concat(event_id, ':42')), 1, 8)) AS BIGINT) % 5)"


def _fold_errors(t: Tables):
    from tideline.operators.splits import row_fold

    rows = t.level_preds.withColumn("fold", row_fold([F.col("event_id")], 5))
    return metrics.regression_errors(rows, ["v", "a"], ["fold"])


@query(
    "fold_mean_and_deviation",
    sql(
        "level_preds",
        f"""SELECT 'affine' AS model, {r6('avg(mae_v)', 'mae_v_mean')}, {r6('stddev_samp(mae_v)', 'mae_v_std')},
            {r6('avg(mse_a)', 'mse_a_mean')}, {r6('stddev_samp(mse_a)', 'mse_a_std')} FROM folds""",
        folds=f"SELECT {FOLDS} AS fold, avg(abs(v - v_pred)) AS mae_v, avg((a - a_pred) ** 2) AS mse_a FROM level_preds GROUP BY 1",
    ),
)
def _(t: Tables):
    return aggregates.fold_summary(_fold_errors(t).withColumn("model", F.lit("affine")), ["model"], ["mae_v", "mse_a"])


@query(
    "fold_means_skip_null",
    sql(
        "level_preds",
        f"SELECT 'unseen' AS regime, {r6('avg(r_v)', 'r_v')}, {r6('avg(none)', 'none')}, CAST(sum(n) AS BIGINT) AS n FROM folds",
        folds=f"SELECT {FOLDS} AS fold, count(*) AS n, CASE WHEN {FOLDS} <> 2 THEN corr(v, v_pred) END AS r_v, CAST(NULL AS DOUBLE) AS none FROM level_preds GROUP BY 1",
    ),
)
def _(t: Tables):
    rows = _fold_errors(t).withColumns(
        {"regime": F.lit("unseen"), "r_v": F.when(F.col("fold") != 2, F.col("r_v")), "none": F.lit(None).cast("double")}
    )
    return aggregates.fold_means(rows, ["regime"], ["r_v", "none"])


@query(
    "first_row_and_first_known",
    sql(
        "gappy",
        f"""SELECT user_id, {r6('arg_min(v, (ts, event_id)) FILTER (v IS NOT NULL)', 'first_v')}, {r6('arg_min(dv, (ts, event_id)) FILTER (dv IS NOT NULL)', 'first_dv')},
            arg_min(event_id, (ts, event_id)) AS first_id FROM gappy GROUP BY user_id""",
    ),
)
def _(t: Tables):
    known = anchors.first_known(t.gappy, EVENTS, ["v", "dv"]).withColumnsRenamed({"v": "first_v", "dv": "first_dv"})
    first = anchors.earliest_row(t.gappy, EVENTS).select("user_id", F.col("event_id").alias("first_id"))
    return known.join(first, "user_id")


VEC = """SELECT {key}, pos, avg(CAST(x AS DOUBLE)) AS x FROM (SELECT {key}, unnest(vec) AS x, unnest(range(len(vec))) AS pos FROM {src}) GROUP BY ALL"""


@query(
    "vector_mean_pool",
    sql("doc_rows", f"SELECT source, CAST(pos AS INTEGER) AS pos, {r6('x')} FROM pooled", pooled=VEC.format(key="source", src="doc_rows")),
)
def _(t: Tables):
    pooled = profiles.pooled_vectors(t.doc_rows, SOURCES, "vec", "mean")
    return pooled.select("source", F.posexplode("pooled").alias("pos", "x"))


@query(
    "vector_mean_last_pool",
    sql(
        "doc_rows",
        f"""SELECT source, CAST(pos AS INTEGER) AS pos, {r6('x')} FROM (SELECT * FROM pooled UNION ALL
            SELECT source, 64 + unnest(range(len(vec))) AS pos, CAST(unnest(vec) AS DOUBLE) AS x
            FROM (SELECT source, arg_max(vec, doc_id) AS vec FROM doc_rows GROUP BY source))""",
        pooled=VEC.format(key="source", src="doc_rows"),
    ),
)
def _(t: Tables):
    pooled = profiles.pooled_vectors(t.doc_rows, SOURCES, "vec", "mean_last")
    return pooled.select("source", F.posexplode("pooled").alias("pos", "x"))


@query(
    "vector_last_pool",
    sql("doc_rows", f"SELECT source, {r6('CAST(vec[1] AS DOUBLE)', 'x1')}, {r6('CAST(vec[64] AS DOUBLE)', 'x64')} FROM (SELECT source, arg_max(vec, doc_id) AS vec FROM doc_rows GROUP BY source)"),
)
def _(t: Tables):
    pooled = profiles.pooled_vectors(t.doc_rows, SOURCES, "vec", "last")
    return pooled.select("source", F.col("pooled")[0].alias("x1"), F.col("pooled")[63].alias("x64"))


PROFILE = ", ".join(
    [
        "user_id",
        *[
            p
            for c in ("v", "a")
            for p in (
                r6(f"avg({c})", f"{c}_mean"),
                r6(f"arg_max({c}, (ts, event_id))", f"{c}_last"),
                r6(f"stddev_pop({c})", f"{c}_std"),
                r6(f"arg_max({c}, (ts, event_id)) - arg_min({c}, (ts, event_id))", f"{c}_change"),
                r6(f"CASE WHEN count(*) > 1 THEN regr_slope({c}, entry_index) ELSE 0 END", f"{c}_slope"),
            )
        ],
        "count(*) AS n_half1",
        "max(n_total) AS n_total",
        "max(cut) AS cut",
        "epoch_us(arg_max(ts, (ts, event_id))) AS last_ts",
        "arg_max(event_id, (ts, event_id)) AS last_id",
    ]
)


@query("half_profile", sql("halves", f"SELECT {PROFILE} FROM halves WHERE half = 1 GROUP BY user_id"))
def _(t: Tables):
    return profiles.half_profile(t.halves, EVENTS)


DOC_HALVES = """SELECT *, CASE WHEN row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 < count(*) OVER (PARTITION BY source) // 2 THEN 1 ELSE 2 END AS half
    FROM (SELECT d.source, d.doc_id, d.vec, l.quality, l.toxic FROM doc_rows d JOIN labelled l USING (doc_id))"""


def doc_halves(t: Tables):
    rows = t.doc_rows.join(t.labelled.select("doc_id", "quality", "toxic"), "doc_id")
    return windows.halves(windows.timeline(rows, SOURCES)).result()


@query(
    "profile_dataset",
    sql(
        "doc_rows labelled",
        f"""SELECT source, {r6('avg(quality)', 'quality_mean')}, {r6('avg(toxic)', 'toxic_mean')}, {r6('avg(CAST(vec[1] AS DOUBLE))', 'x1')},
            {r6('avg(CAST(vec[64] AS DOUBLE))', 'x64')}, n_docs FROM doc_halves JOIN (SELECT source, count(*) AS n_docs FROM docs GROUP BY source) USING (source)
            WHERE half = 1 GROUP BY source, n_docs""",
        doc_halves=DOC_HALVES,
    ),
)
def _(t: Tables):
    labels = t.docs.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"))
    found = profiles.profile_dataset(doc_halves(t), labels, SOURCES, "vec")
    return found.select(
        "source", "quality_mean", "toxic_mean", F.col("pooled")[0].alias("x1"), F.col("pooled")[63].alias("x64"), "n_docs"
    )


@query(
    "label_audit",
    sql(
        "halves",
        f"""SELECT count(*) FILTER (d IS NOT NULL) AS n_compared, count(*) FILTER (d IS NULL) AS n_insufficient,
            {r6('coalesce(max(abs(d - l)), 0)', 'max_diff_v')}, count(*) FILTER (abs(d - l) > 1e-6) AS n_mismatch_v,
            {r6('coalesce(max(abs(e - e)), 0)', 'max_diff_a')}, count(*) FILTER (abs(e - e) > 1e-6) AS n_mismatch_a
            FROM (SELECT user_id, d, e, CASE WHEN user_id % 10 = 3 THEN d + 0.5 ELSE d END AS l FROM
              (SELECT user_id, avg(v) FILTER (half = 2) - avg(v) FILTER (half = 1) AS d,
                      avg(a) FILTER (half = 2) - avg(a) FILTER (half = 1) AS e FROM halves GROUP BY user_id))""",
    ),
)
def _(t: Tables):
    stored = profiles.half_change(t.halves, EVENTS)
    wrong = F.when(F.col("user_id") % 10 == 3, F.col("v_half_change") + 0.5).otherwise(F.col("v_half_change"))
    return profiles.label_audit(t.halves, stored.withColumn("v_half_change", wrong), EVENTS)


@query(
    "norm_stats",
    sql(
        "halves",
        f"""SELECT 'v' AS name, {r6('avg(v)', 'mean')}, {r6('stddev_pop(v)', 'std')} FROM halves WHERE half = 1
            UNION ALL SELECT 'cut', {r6('avg(cut)', 'mean')}, {r6('CASE WHEN stddev_pop(cut) = 0 THEN 1 ELSE stddev_pop(cut) END', 'std')} FROM halves WHERE half = 1""",
    ),
)
def _(t: Tables):
    return profiles.fit_norm_stats(t.halves.where("half = 1"), ["v", "cut"])


@query(
    "norm_applied",
    sql(
        "halves",
        f"""SELECT event_id, {r6('(v - mv) / sv', 'v')}, {r6('(a - ma) / sa', 'a')} FROM halves,
            (SELECT avg(v) AS mv, stddev_pop(v) AS sv, avg(a) AS ma, stddev_pop(a) AS sa FROM halves WHERE half = 1)""",
    ),
)
def _(t: Tables):
    stats = profiles.fit_norm_stats(t.halves.where("half = 1"), ["v", "a"])
    return profiles.apply_norm_stats(t.halves.select("event_id", "v", "a"), stats, ["v", "a"])


@query(
    "least_squares_moments",
    sql("lagged", f"SELECT delta, {r6s('intercept coef')}, fit_rows FROM (SELECT 'dv' AS delta, regr_intercept(dv, dv_lag) AS intercept, regr_slope(dv, dv_lag) AS coef, CAST(regr_count(dv, dv_lag) AS BIGINT) AS fit_rows FROM lags UNION ALL SELECT 'da', regr_intercept(da, da_lag), regr_slope(da, da_lag), CAST(regr_count(da, da_lag) AS BIGINT) FROM lags)",
        lags="SELECT *, lag(dv) OVER w AS dv_lag, lag(da) OVER w AS da_lag FROM timeline WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"),
)
def _(t: Tables):
    rows = windows.lagged_delta(windows.timeline(t.timeline, EVENTS), EVENTS).result()
    return baselines.fit_one_lag(rows, EVENTS)


# --- order and top-k ----------------------------------------------------------------


@query("sorted_rows", sql("entries", f"SELECT user_id, event_id, {r6('v')} FROM entries ORDER BY user_id, ts, event_id"))
def _(t: Tables):
    return t.entries.orderBy("user_id", "ts", "event_id").select("user_id", "event_id", "v")


@query("top_users", sql("", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10"))
def _(t: Tables):
    return aggregates.top_entities(t.raw("events"), "user_id", 10)


@query(
    "best_fold",
    sql("level_preds", f"SELECT CAST(fold AS INTEGER) AS fold, {r6('mae_v')} FROM folds ORDER BY folds.mae_v, fold LIMIT 1",
        folds=f"SELECT {FOLDS} AS fold, avg(abs(v - v_pred)) AS mae_v FROM level_preds GROUP BY 1"),
)
def _(t: Tables):
    return aggregates.best_row(_fold_errors(t), "mae_v", "fold").select("fold", "mae_v")


@query(
    "best_day_by_type",
    sql("entries", f"SELECT event_type, day, {r6('score')} FROM days QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY days.score DESC, day) = 1",
        days="SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, avg(v) AS score FROM entries GROUP BY ALL"),
)
def _(t: Tables):
    days = t.entries.groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.avg("v").alias("score"))
    return aggregates.best_row(days, "score", "day", ["event_type"], largest=True)


