"""The given tables in the roles the operators expect, in Spark and in SQL.

The two forms of each table sit side by side: a method of :class:`Tables` and a named
common table expression in :data:`CTES`.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.operators import baselines, datasets, splits, windows
from tideline.roles import Roles
from tideline.scale import join_one_row_per_key
from tideline.timeline import Next, RowsBefore, RowTotal, Timeline

EVENTS = Roles("user_id", "ts", "event_id", ("v", "a"), ("dv", "da"), "flag")
ORDERS = Roles("o_custkey", "o_orderdate", "o_orderkey", ("price", "price"), ("dv", "da"), "flag")
SOURCES = Roles("source", "doc_id", "doc_id", ("quality", "toxic"), ("dv", "da"), "flag")
TALKS = Roles("conv_id", "turn", "turn", ("n_tokens", "n_chars"), ("dv", "da"), "flag")
SEED = 42
TIE_SHIFT = 1.3e-9


class Tables:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def entries(self) -> DataFrame:
        """events: two targets, a flag, no deltas yet."""
        return self.raw("events").select(
            "user_id",
            "ts",
            "event_id",
            "event_type",
            (F.col("event_type") == "view").alias("flag"),
            F.col("value").alias("v"),
            F.get_json_object("props", "$.k").cast("double").alias("a"),
        )

    @cached_property
    def timeline(self) -> DataFrame:
        """Entries with deltas to the next row, unknown on sign-ups and last rows."""
        known = F.col("event_type") != "signup"
        tl = Timeline(self.entries, "user_id", EVENTS.order).running(_v=Next(F.col("v")), _a=Next(F.col("a")))
        tl = tl.map(dv=F.when(known, F.col("_v") - F.col("v")), da=F.when(known, F.col("_a") - F.col("a")))
        return tl.result().drop("_v", "_a")

    @cached_property
    def gappy(self) -> DataFrame:
        """The timeline with targets unknown on errors."""
        seen = F.col("event_type") != "error"
        return self.timeline.withColumns({t: F.when(seen, F.col(t)) for t in ("v", "a")})

    @cached_property
    def history(self) -> DataFrame:
        return datasets.history_block(self.gappy, EVENTS)

    @cached_property
    def user_split(self) -> DataFrame:
        return splits.group_split(self.raw("events"), "user_id", SEED, 0.2)

    @cached_property
    def lagged(self) -> DataFrame:
        """Timeline with the previous eligible deltas."""
        return windows.previous_eligible_delta(windows.timeline(self.timeline, EVENTS), EVENTS).result()

    @cached_property
    def two_lag_model(self) -> DataFrame:
        return baselines.fit_two_lags(datasets.train_rows(self.lagged, self.user_split, ["user_id"]), EVENTS)

    @cached_property
    def scored_steps(self) -> DataFrame:
        """Every row with its two-lag prediction."""
        return baselines.predict_two_lags(self.lagged, self.two_lag_model, EVENTS)

    @cached_property
    def anchor_preds(self) -> DataFrame:
        return baselines.anchor_predictions(self.scored_steps, EVENTS)

    @cached_property
    def stored_preds(self) -> DataFrame:
        """Anchor predictions as one stage hands them to the next."""
        return self.anchor_preds

    @cached_property
    def cutoffs(self) -> DataFrame:
        """Per user the time of the row at position floor(0.8 n)."""
        tl = Timeline(self.raw("events").select("user_id", "ts", "event_id"), "user_id", EVENTS.order)
        rows = tl.running(_i=RowsBefore(), _n=RowTotal()).result()
        return rows.where(F.col("_i") == F.floor(F.lit(0.8) * F.col("_n"))).select("user_id", F.col("ts").alias("cutoff"))

    @cached_property
    def halves(self) -> DataFrame:
        return windows.halves(windows.timeline(self.entries, EVENTS)).result()

    @cached_property
    def level_preds(self) -> DataFrame:
        """Row-level predictions of both targets, made from the row itself."""
        return self.entries.withColumns(
            {
                "v_pred": F.col("v") * 0.7 + F.col("event_id") % 17,
                "a_pred": F.col("a") * 0.6 + F.col("event_id") % 13,
            }
        )

    @cached_property
    def docs(self) -> DataFrame:
        return self.raw("documents").select("doc_id", "text", "source", "lang", (F.col("lang") == "en").alias("flag"))

    @cached_property
    def labelled(self) -> DataFrame:
        """Documents with row-level labels as two targets."""
        marks = self.raw("labels").select(
            "doc_id", F.col("quality").cast("double").alias("quality"), F.col("toxic").cast("double").alias("toxic")
        )
        return self.docs.join(marks, "doc_id")

    @cached_property
    def vectors(self) -> DataFrame:
        return self.raw("embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"))

    @cached_property
    def doc_rows(self) -> DataFrame:
        """Documents that have a vector, as timelines of their sources."""
        return self.docs.select("source", "doc_id", "flag").join(self.vectors, "doc_id")

    @cached_property
    def doc_vectors_keyed(self) -> DataFrame:
        """One vector per event of the timeline: the document vector with the same id
        modulo the number of vectors, keyed by event."""
        n = self.raw("embeddings").agg(F.count(F.lit(1))).scalar()
        keyed = self.raw("events").select("user_id", "event_id", (F.col("event_id") % n).alias("doc_id"))
        return join_one_row_per_key(keyed, self.vectors, ["doc_id"]).drop("doc_id")


K = "CAST(json_extract_string(props, '$.k') AS DOUBLE)"
OK = "(dv IS NOT NULL AND da IS NOT NULL)"
BEFORE = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
EMA = "list_reduce(list({c}) OVER (PARTITION BY user_id, ok ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), lambda x, y: 0.7 * x + 0.3 * y)"

# name -> (names it builds on, body)
CTES: dict[str, tuple[list[str], str]] = {
    "entries": (
        [],
        f"SELECT user_id, ts, event_id, event_type, event_type = 'view' AS flag, value AS v, {K} AS a FROM events",
    ),
    "timeline": (
        ["entries"],
        """SELECT *, CASE WHEN event_type <> 'signup' THEN lead(v) OVER w - v END AS dv,
           CASE WHEN event_type <> 'signup' THEN lead(a) OVER w - a END AS da
           FROM entries WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
    ),
    "gappy": (
        ["timeline"],
        """SELECT * REPLACE (CASE WHEN event_type <> 'error' THEN v END AS v,
           CASE WHEN event_type <> 'error' THEN a END AS a) FROM timeline""",
    ),
    "lagged": (
        ["timeline"],
        f"""SELECT *, CASE WHEN {OK} THEN lag(dv) OVER w END AS dv_prev, CASE WHEN {OK} THEN lag(da) OVER w END AS da_prev
            FROM timeline WINDOW w AS (PARTITION BY user_id, {OK} ORDER BY ts, event_id)""",
    ),
    "history": (
        ["gappy"],
        f"""SELECT * EXCLUDE (ok, ev, ea, bts),
            CASE WHEN ok THEN lag(dv) OVER e END AS dv_prev, CASE WHEN ok THEN lag(da) OVER e END AS da_prev,
            last_value(v IGNORE NULLS) OVER b AS v_prev_state, last_value(a IGNORE NULLS) OVER b AS a_prev_state,
            coalesce((epoch_us(ts) - epoch_us(bts)) / 1e6, 0.0) AS gap_prev_seconds,
            CAST(coalesce(sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER b, 0) AS BIGINT) AS history_len,
            coalesce(avg(CASE WHEN ok THEN dv END) OVER b, 0.0) AS dv_mean_prev,
            coalesce(avg(CASE WHEN ok THEN da END) OVER b, 0.0) AS da_mean_prev,
            coalesce(last_value(ev IGNORE NULLS) OVER b, 0.0) AS dv_ema_prev,
            coalesce(last_value(ea IGNORE NULLS) OVER b, 0.0) AS da_ema_prev
            FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS bts,
                  CASE WHEN ok THEN {EMA.format(c="dv")} END AS ev, CASE WHEN ok THEN {EMA.format(c="da")} END AS ea
                  FROM (SELECT *, {OK} AS ok FROM gappy))
            WINDOW b AS (PARTITION BY user_id ORDER BY ts, event_id {BEFORE}),
                   e AS (PARTITION BY user_id, ok ORDER BY ts, event_id)""",
    ),
    "user_split": (
        [],
        """SELECT user_id, CASE WHEN r <= ceil(CAST(0.2 AS DOUBLE) * n) THEN 'val' ELSE 'train' END AS part
           FROM (SELECT user_id, row_number() OVER (ORDER BY md5(concat(user_id, ':42')), user_id) AS r,
                 count(*) OVER () AS n FROM (SELECT DISTINCT user_id FROM events))""",
    ),
    "moments": (
        ["lagged", "user_split"],
        """SELECT count(*) AS n, avg(dv_prev) AS m1, avg(da_prev) AS m2, var_pop(dv_prev) AS s11, var_pop(da_prev) AS s22,
           covar_pop(dv_prev, da_prev) AS s12, avg(dv) AS mv, avg(da) AS ma, covar_pop(dv_prev, dv) AS c1v,
           covar_pop(da_prev, dv) AS c2v, covar_pop(dv_prev, da) AS c1a, covar_pop(da_prev, da) AS c2a,
           (SELECT count(*) FROM user_split WHERE part = 'train') AS users
           FROM lagged JOIN user_split USING (user_id)
           WHERE part = 'train' AND dv_prev IS NOT NULL AND da_prev IS NOT NULL""",
    ),
    "two_lag_model": (
        ["moments"],
        """SELECT 'dv' AS delta, mv - b1 * m1 - b2 * m2 AS intercept, b1 AS coef_1, b2 AS coef_2, n AS fit_rows, users AS n_users
           FROM (SELECT *, (s22 * c1v - s12 * c2v) / (s11 * s22 - s12 * s12) AS b1,
                 (s11 * c2v - s12 * c1v) / (s11 * s22 - s12 * s12) AS b2 FROM moments)
           UNION ALL
           SELECT 'da', ma - b1 * m1 - b2 * m2, b1, b2, n, users
           FROM (SELECT *, (s22 * c1a - s12 * c2a) / (s11 * s22 - s12 * s12) AS b1,
                 (s11 * c2a - s12 * c1a) / (s11 * s22 - s12 * s12) AS b2 FROM moments)""",
    ),
    "scored_steps": (
        ["lagged", "two_lag_model"],
        """SELECT l.*, m.intercept + m.coef_1 * coalesce(dv_prev, 0) + m.coef_2 * coalesce(da_prev, 0) AS dv_pred,
           k.intercept + k.coef_1 * coalesce(dv_prev, 0) + k.coef_2 * coalesce(da_prev, 0) AS da_pred
           FROM lagged l, (SELECT * FROM two_lag_model WHERE delta = 'dv') m, (SELECT * FROM two_lag_model WHERE delta = 'da') k""",
    ),
    "anchor_preds": (
        ["scored_steps"],
        f"""SELECT user_id, event_id AS anchor_id, ts AS anchor_ts, dv AS dv_true, da AS da_true, dv_pred, da_pred
            FROM scored_steps WHERE {OK}
            QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
    ),
    "cutoffs": (
        [],
        """SELECT user_id, ts AS cutoff FROM (SELECT user_id, ts,
           row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n
           FROM events) WHERE i = floor(CAST(0.8 AS DOUBLE) * n)""",
    ),
    "halves": (
        ["entries"],
        """SELECT *, n_total // 2 AS cut, CASE WHEN entry_index < n_total // 2 THEN 1 ELSE 2 END AS half
           FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS entry_index,
                 count(*) OVER (PARTITION BY user_id) AS n_total FROM entries)""",
    ),
    "level_preds": (
        ["entries"],
        "SELECT *, v * 0.7 + event_id % 17 AS v_pred, a * 0.6 + event_id % 13 AS a_pred FROM entries",
    ),
    "docs": ([], "SELECT doc_id, text, source, lang, lang = 'en' AS flag FROM documents"),
    "labelled": (
        ["docs"],
        """SELECT d.*, CAST(quality AS DOUBLE) AS quality, CAST(toxic AS DOUBLE) AS toxic
           FROM docs d JOIN labels USING (doc_id)""",
    ),
    "doc_rows": (
        ["docs"],
        "SELECT source, doc_id, flag, embedding AS vec FROM docs JOIN embeddings ON vec_id = doc_id",
    ),
}


def sql(names: str, body: str, **more: str) -> str:
    """A query over named tables of CTES plus further ones given as keywords."""
    ordered: dict[str, str] = {}

    def add(name: str) -> None:
        if name not in ordered:
            needs, text = CTES[name]
            for n in needs:
                add(n)
            ordered[name] = text

    for name in names.split():
        add(name)
    ordered.update(more)
    if not ordered:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({t})" for n, t in ordered.items()) + "\n" + body


def r6(expression: str, alias: str | None = None) -> str:
    """Rounded output column. Means of prices often lie exactly between two roundings;
    the small shift on both sides keeps engines from resolving those ties differently.
    Adding 0 turns a negative zero into zero."""
    return f"round({expression} + {TIE_SHIFT}, 6) + 0.0 AS {alias or expression}"


def r6s(columns: str) -> str:
    return ", ".join(r6(c) for c in columns.split())
