"""Queries over entity timelines: history columns, sequences, anchors and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.functions.expressions import micros
from tideline.operators import anchors, datasets, splits, windows
from tideline.plans.fixtures import BEFORE, EVENTS, OK, SEED, SOURCES, TALKS, Tables, r6, r6s, sql
from tideline.plans.registry import query
from tideline.timeline import SumBefore, Timeline

W = "WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"
B = f"WINDOW b AS (PARTITION BY user_id ORDER BY ts, event_id {BEFORE})"


@query("previous_eligible_delta", sql("lagged", f"SELECT user_id, event_id, {r6s('dv_prev da_prev')} FROM lagged"))
def _(t: Tables):
    return t.lagged.select("user_id", "event_id", "dv_prev", "da_prev")


@query(
    "lagged_delta",
    sql("timeline", f"SELECT user_id, event_id, {r6('lag(dv) OVER w', 'dv_lag')}, {r6('lag(da) OVER w', 'da_lag')} FROM timeline {W}"),
)
def _(t: Tables):
    rows = windows.lagged_delta(windows.timeline(t.timeline, EVENTS), EVENTS).result()
    return rows.select("user_id", "event_id", "dv_lag", "da_lag")


MOMENTUM = f"""SELECT *, CASE WHEN row_number() OVER w = 1 THEN 0 ELSE lag(dv) OVER w END AS dv_pred,
    CASE WHEN row_number() OVER w = 1 THEN 0 ELSE lag(da) OVER w END AS da_pred FROM timeline {W}"""


@query("momentum_predictions", sql("timeline", f"SELECT user_id, event_id, {r6s('dv_pred da_pred')} FROM momentum", momentum=MOMENTUM))
def _(t: Tables):
    rows = windows.momentum(windows.timeline(t.timeline, EVENTS), EVENTS).result()
    return rows.select("user_id", "event_id", "dv_pred", "da_pred")


@query(
    "previous_state",
    sql("gappy", f"SELECT user_id, event_id, {r6('last_value(v IGNORE NULLS) OVER b', 'v_prev_state')}, {r6('last_value(a IGNORE NULLS) OVER b', 'a_prev_state')} FROM gappy {B}"),
)
def _(t: Tables):
    rows = windows.previous_state(windows.timeline(t.gappy, EVENTS), EVENTS).result()
    return rows.select("user_id", "event_id", "v_prev_state", "a_prev_state")


@query("half_split", sql("halves", "SELECT user_id, event_id, entry_index, n_total, cut, half FROM halves"))
def _(t: Tables):
    return t.halves.select("user_id", "event_id", "entry_index", "n_total", "cut", "half")


@query("gap_seconds", sql("history", f"SELECT user_id, event_id, {r6('gap_prev_seconds')} FROM history"))
def _(t: Tables):
    tl = windows.history_features(windows.timeline(t.gappy, EVENTS), EVENTS, ema=False)
    return tl.result().select("user_id", "event_id", "gap_prev_seconds")


@query(
    "running_count_and_mean",
    sql("history", f"SELECT user_id, event_id, history_len, {r6s('dv_mean_prev da_mean_prev')} FROM history"),
)
def _(t: Tables):
    tl = windows.history_features(windows.timeline(t.gappy, EVENTS), EVENTS, ema=False)
    return tl.result().select("user_id", "event_id", "history_len", "dv_mean_prev", "da_mean_prev")


@query(
    "exponential_average",
    sql("history", f"SELECT user_id, event_id, {r6s('dv_ema_prev da_ema_prev')} FROM history"),
)
def _(t: Tables):
    tl = windows.timeline(t.gappy, EVENTS).ema(
        windows.EMA_ALPHA, EVENTS.eligible(), dv_ema_prev=F.col("dv"), da_ema_prev=F.col("da")
    )
    zero = F.lit(0.0)
    return tl.result().select(
        "user_id",
        "event_id",
        F.coalesce("dv_ema_prev", zero).alias("dv_ema_prev"),
        F.coalesce("da_ema_prev", zero).alias("da_ema_prev"),
    )


HISTORY_COLUMNS = "dv_prev da_prev v_prev_state a_prev_state gap_prev_seconds dv_mean_prev da_mean_prev dv_ema_prev da_ema_prev"


@query("history_features", sql("history", f"SELECT user_id, event_id, history_len, {r6s(HISTORY_COLUMNS)} FROM history"))
def _(t: Tables):
    return t.history.select("user_id", "event_id", "history_len", *HISTORY_COLUMNS.split())


@query(
    "history_anchors",
    sql(
        "history",
        f"""SELECT user_id, event_id, epoch_us(ts) AS ts, history_len, {r6s('dv da')}, {r6s(HISTORY_COLUMNS)} FROM history WHERE {OK}
            QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
    ),
)
def _(t: Tables):
    rows = anchors.latest_eligible(t.history, EVENTS)
    return rows.select("user_id", "event_id", "ts", "history_len", "dv", "da", *HISTORY_COLUMNS.split())


SLOTS = ", ".join(
    r6(f"CASE WHEN len(l) >= {5 - i} THEN l[len(l) - {4 - i}] ELSE 0 END", f"s{i}") for i in range(5)
)


@query(
    "sequences",
    sql(
        "entries",
        f"""SELECT user_id, event_id, CAST(len(l) AS INTEGER) AS seq_len, {SLOTS} FROM (SELECT user_id, event_id,
            list(v) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 4 PRECEDING) AS l FROM entries)""",
    ),
)
def _(t: Tables):
    rows = t.entries.withColumn("pair", F.array("v", "a"))
    zero = F.array_repeat(F.lit(0.0), 2)
    done = windows.sequences(windows.timeline(rows, EVENTS), "pair", 5, zero).result()
    return done.select("user_id", "event_id", "seq_len", *[F.col("seq")[i][0].alias(f"s{i}") for i in range(5)])


NORMS = ", ".join(
    r6(f"CASE WHEN len(l) >= {5 - i} THEN l[len(l) - {4 - i}] ELSE 0 END", f"s{i}") for i in range(5)
)


@query(
    "vector_sequences",
    sql(
        "doc_rows",
        f"""SELECT source, doc_id, CAST(len(l) AS INTEGER) AS seq_len, {NORMS} FROM (SELECT source, doc_id,
            list(list_sum(list_transform(vec, lambda x: CAST(x AS DOUBLE) * x))) OVER (PARTITION BY source ORDER BY doc_id ROWS 4 PRECEDING) AS l FROM doc_rows)""",
    ),
)
def _(t: Tables):
    tl = windows.sequences(windows.timeline(t.doc_rows, SOURCES), "vec", 5, windows.zero_vector(64))
    total = lambda v: F.aggregate(v.cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x)
    return tl.result().select("source", "doc_id", "seq_len", *[total(F.col("seq")[i]).alias(f"s{i}") for i in range(5)])


@query(
    "latest_eligible_row",
    sql(
        "timeline",
        f"""SELECT user_id, event_id, epoch_us(ts) AS ts, {r6s('dv da')} FROM timeline WHERE {OK}
            QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
    ),
)
def _(t: Tables):
    return anchors.latest_eligible(t.timeline, EVENTS).select("user_id", "event_id", "ts", "dv", "da")


@query(
    "latest_row_of_flagged",
    sql(
        "entries",
        f"""SELECT user_id, event_id, {r6('v')} FROM entries WHERE user_id IN (SELECT user_id FROM entries WHERE a > 97)
            QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
    ),
)
def _(t: Tables):
    markers = t.entries.select("user_id", F.when(F.col("a") > 97, " Yes").otherwise("no").alias("is_forecast"))
    return anchors.forecast_anchors(t.entries, EVENTS, markers=markers).select("user_id", "event_id", "v")


@query(
    "first_and_last_marker",
    sql(
        "entries",
        """SELECT user_id, arg_min(event_id, (ts, event_id)) AS first_id, arg_max(event_id, (ts, event_id)) AS last_id
           FROM entries WHERE event_type = 'purchase' GROUP BY user_id""",
    ),
)
def _(t: Tables):
    rows = t.entries.where("event_type = 'purchase'").select("user_id", "ts", "event_id")
    first = anchors.earliest_row(rows, EVENTS).select("user_id", F.col("event_id").alias("first_id"))
    last = anchors.latest_row(rows, EVENTS).select("user_id", F.col("event_id").alias("last_id"))
    return first.join(last, "user_id")


@query(
    "anchors_by_row_key",
    sql(
        "entries",
        f"""SELECT user_id, event_id, epoch_us(ts) AS ts, {r6('v')} FROM entries WHERE event_type = 'view'
            QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
    ),
)
def _(t: Tables):
    markers = t.entries.where("event_type = 'view'").select("user_id", "ts", "event_id")
    found = anchors.forecast_anchors(t.entries, EVENTS, markers=markers)
    return found.select("user_id", "event_id", "ts", "v")


@query(
    "trajectories",
    sql(
        "scored_steps",
        f"""SELECT user_id, event_id, {r6('coalesce(sum(dv) OVER r, 0)', 'dv_path')}, {r6('sum(dv_pred) OVER r', 'dv_pred_path')}
            FROM scored_steps WINDOW r AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""",
    ),
)
def _(t: Tables):
    rows = windows.trajectories(windows.timeline(t.scored_steps, EVENTS), ["dv", "dv_pred"]).result()
    return rows.select("user_id", "event_id", "dv_path", "dv_pred_path")


@query(
    "entry_index",
    sql("", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS entry_index FROM orders"),
)
def _(t: Tables):
    rows = t.raw("orders").select("o_custkey", "o_orderdate", "o_orderkey")
    return windows.entry_index(Timeline(rows, "o_custkey", ["o_orderdate", "o_orderkey"])).result().drop("o_orderdate")


TIME_SPLIT = """SELECT o_custkey, o_orderkey, CASE WHEN n <= 1 OR i < greatest(1, least(n - 1, floor(n * CAST(0.8 AS DOUBLE)))) THEN 'train' ELSE 'val' END AS part
    FROM (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))"""


@query("time_split", sql("", TIME_SPLIT))
def _(t: Tables):
    rows = t.raw("orders").select("o_custkey", "o_orderdate", "o_orderkey")
    return windows.time_split(Timeline(rows, "o_custkey", ["o_orderdate", "o_orderkey"])).result().drop("o_orderdate")


@query(
    "time_split_by_step",
    sql(
        "",
        """SELECT conv_id, turn, CASE WHEN n <= 1 OR i < greatest(1, least(n - 1, floor(n * CAST(0.8 AS DOUBLE)))) THEN 'train' ELSE 'val' END AS part
           FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)""",
    ),
)
def _(t: Tables):
    rows = t.raw("conversations").select("conv_id", F.col("turn").alias("step"))
    return windows.time_split(Timeline(rows, TALKS.entity, [windows.time_order(rows)])).result().withColumnRenamed("step", "turn")


F32 = "CAST(CAST(coalesce({c}, 0) AS FLOAT) AS DOUBLE)"


@query(
    "feature_block",
    sql(
        "history two_lag_model",
        "SELECT user_id, event_id, "
        + ", ".join(
            r6(F32.format(c=c), c)
            for c in "dv_prev da_prev gap_prev_seconds dv_mean_prev da_mean_prev dv_ema_prev da_ema_prev v a v_prev_state a_prev_state dv_base da_base".split()
        )
        + ", CAST(history_len AS DOUBLE) AS history_len, "
        + ", ".join(f"CAST({c} IS NULL AS DOUBLE) AS {c}_missing" for c in "dv_prev da_prev v a v_prev_state a_prev_state".split())
        + """ FROM (SELECT h.*, m.intercept + m.coef_1 * coalesce(dv_prev, 0) + m.coef_2 * coalesce(da_prev, 0) AS dv_base,
              k.intercept + k.coef_1 * coalesce(dv_prev, 0) + k.coef_2 * coalesce(da_prev, 0) AS da_base
              FROM history h, (SELECT * FROM two_lag_model WHERE delta = 'dv') m, (SELECT * FROM two_lag_model WHERE delta = 'da') k)""",
    ),
)
def _(t: Tables):
    rows = datasets.feature_block(t.history, t.two_lag_model, EVENTS)
    flags = [c for c in datasets.feature_columns(EVENTS) if c.endswith("_missing") or c == "history_len"]
    plain = [c for c in datasets.feature_columns(EVENTS) if c not in flags]
    return rows.select("user_id", "event_id", *[F.col(c).cast("double").alias(c) for c in plain], *flags)


@query(
    "large_timeline_history",
    sql(
        "",
        f"""SELECT o_custkey, o_orderkey, {r6('lag(o_totalprice) OVER w', 'prev_price')}, {r6('coalesce(sum(o_totalprice) OVER b, 0)', 'spent_before')},
            epoch_us(lag(o_orderdate) OVER w) AS prev_at FROM orders
            WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), b AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey {BEFORE})""",
    ),
)
def _(t: Tables):
    from tideline.timeline import Lag

    rows = t.raw("orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    tl = Timeline(rows, "o_custkey", ["o_orderdate", "o_orderkey"]).running(
        prev_price=Lag(F.col("o_totalprice")), spent_before=SumBefore(F.col("o_totalprice")), prev_at=Lag(F.col("o_orderdate"))
    )
    return tl.result().select(
        "o_custkey", "o_orderkey", "prev_price", F.round("spent_before", 2).alias("spent_before"), micros(F.col("prev_at")).alias("prev_at")
    )


# --- splits ------------------------------------------------------------------------


@query("group_split", sql("user_split", "SELECT user_id, part FROM user_split"))
def _(t: Tables):
    return t.user_split


@query(
    "group_split_large",
    sql(
        "",
        """SELECT o_custkey, CASE WHEN r <= ceil(CAST(0.2 AS DOUBLE) * n) THEN 'val' ELSE 'train' END AS part
           FROM (SELECT o_custkey, row_number() OVER (ORDER BY md5(concat(o_custkey, ':43')), o_custkey) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT o_custkey FROM orders))""",
    ),
)
def _(t: Tables):
    return splits.group_split(t.raw("orders"), "o_custkey", 43)


@query(
    "shuffled_group_split",
    sql(
        "",
        """SELECT user_id, CASE WHEN r <= floor(CAST(0.8 AS DOUBLE) * n) THEN 'train' ELSE 'val' END AS part
           FROM (SELECT user_id, row_number() OVER (ORDER BY md5(concat(user_id, ':42')), user_id) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT user_id FROM events))""",
    ),
)
def _(t: Tables):
    return splits.shuffled_group_split(t.raw("events"), "user_id", SEED)


GROUP_FOLDS = """SELECT o_custkey, CAST(CASE WHEN (r // 5) % 2 = 0 THEN r % 5 ELSE 4 - r % 5 END AS INTEGER) AS fold, n AS n_rows
    FROM (SELECT o_custkey, n, row_number() OVER (ORDER BY n DESC, o_custkey) - 1 AS r FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1))"""


@query("group_folds", sql("", GROUP_FOLDS))
def _(t: Tables):
    return splits.group_folds(t.raw("orders"), "o_custkey", 5)


@query("group_fold_sizes", sql("", "SELECT fold, count(*) AS n_groups, CAST(sum(n_rows) AS BIGINT) AS n_rows FROM folds GROUP BY fold", folds=GROUP_FOLDS))
def _(t: Tables):
    folds = splits.group_folds(t.raw("orders"), "o_custkey", 5)
    return folds.groupBy("fold").agg(F.count(F.lit(1)).alias("n_groups"), F.sum("n_rows").alias("n_rows"))


HASH = "CAST(('0x' || substr(md5(concat({k}, ':42')), 1, 8)) AS BIGINT)"


@query("row_folds", sql("", f"SELECT doc_id, CAST({HASH.format(k='doc_id')} % 5 AS INTEGER) AS fold FROM documents"))
def _(t: Tables):
    return t.raw("documents").select("doc_id", splits.row_fold([F.col("doc_id")], 5).alias("fold"))


@query("row_split", sql("", f"SELECT event_id, CASE WHEN {HASH.format(k='event_id')} < 858993459 THEN 'val' ELSE 'train' END AS part FROM events"))
def _(t: Tables):
    return t.raw("events").select("event_id", splits.row_part([F.col("event_id")]).alias("part"))


SPLIT_SUMMARY = """SELECT CAST(sum(t) AS BIGINT) AS n_train, CAST(sum(v) AS BIGINT) AS n_val, count(*) FILTER (t > 1 OR v > 1) AS n_repeated,
    count(*) FILTER (t > 0 AND v > 0) AS n_in_both, sum(t) > 0 AND sum(v) > 0 AND count(*) FILTER (t > 1 OR v > 1) = 0 AND count(*) FILTER (t > 0 AND v > 0) = 0 AS valid
    FROM (SELECT {k}, count(*) FILTER (part = 'train') AS t, count(*) FILTER (part = 'val') AS v FROM {s} GROUP BY {k})"""


@query("split_summary", sql("user_split", SPLIT_SUMMARY.format(k="user_id", s="user_split")))
def _(t: Tables):
    return splits.split_summary(t.user_split, ["user_id"])


@query("split_summary_rows", sql("", SPLIT_SUMMARY.format(k="o_orderkey", s="parts"), parts=TIME_SPLIT))
def _(t: Tables):
    rows = t.raw("orders").select("o_custkey", "o_orderdate", "o_orderkey")
    parts = windows.time_split(Timeline(rows, "o_custkey", ["o_orderdate", "o_orderkey"])).result()
    return splits.split_summary(parts, ["o_orderkey"])


@query(
    "entities_in_both_parts",
    sql("", "SELECT o_custkey FROM parts GROUP BY o_custkey HAVING count(DISTINCT part) > 1", parts=TIME_SPLIT),
)
def _(t: Tables):
    rows = t.raw("orders").select("o_custkey", "o_orderdate", "o_orderkey")
    parts = windows.time_split(Timeline(rows, "o_custkey", ["o_orderdate", "o_orderkey"])).result()
    return splits.entities_in_both_parts(parts, "o_custkey")
