"""Queries over typed input, row filters, value checks and text columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.functions import expressions, terms
from tideline.functions import text as tx
from tideline.functions.expressions import (
    digest_number,
    from_unit_scale,
    key_digest,
    lenient_bool,
    to_unit_scale,
)
from tideline.operators import filters, metrics, scoring, splits
from tideline.plans.fixtures import EVENTS, OK, SEED, Tables, r6, r6s, sql
from tideline.plans.registry import query
from tideline.scale import join_one_row_per_key
from tideline.sources import sinks, tables, vectors
from tideline.timeline import RowsBefore, Timeline

EVENT_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
BOUNDS = {"v": (0.0, 50.0), "a": (10.0, 80.0)}


@query(
    "load_typed",
    sql("", f"SELECT event_id, user_id, epoch_us(ts) AS ts, event_type, {r6('value')} FROM events"),
)
def _(t: Tables):
    loaded = tables.load_tables(t.spark, {"events": f"{t.folder}/events.parquet"}, {"events": EVENT_SCHEMA})["events"]
    return loaded.select("event_id", "user_id", "ts", "event_type", "value")


@query(
    "normalise_types",
    sql(
        "",
        f"""SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS customer, {r6('o_totalprice')},
            lower(trim(o_orderstatus)) IN ('true', '1', 't', 'yes', 'y') AS is_t,
            CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS priority FROM orders""",
    ),
)
def _(t: Tables):
    rows = t.raw("orders").select(
        "o_orderkey",
        F.col("o_custkey").cast("string").alias("customer"),
        F.col("o_totalprice").cast("string").alias("o_totalprice"),
        F.substring("o_orderpriority", 1, 1).alias("priority"),
        F.col("o_orderstatus").alias("is_t"),
    )
    typed = tables.normalise(rows, "o_orderkey bigint, customer string, o_totalprice double, priority int, is_t boolean")
    return typed.select("o_orderkey", "customer", "o_totalprice", "is_t", "priority")


@query(
    "number_tags",
    "SELECT l_discount, count(*) AS n, replace(replace(regexp_replace(CAST(CAST(l_discount - 0.05 AS DECIMAL(24, 6)) AS VARCHAR), '\\.?0+$', ''), '-', 'm'), '.', 'p') AS tag FROM lineitem GROUP BY l_discount",
)
def _(t: Tables):
    counted = t.raw("lineitem").groupBy("l_discount").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("tag", expressions.number_tags(F.col("l_discount") - 0.05))


@query(
    "vector_store_scan",
    sql("", f"SELECT vec_id, len(embedding) AS dim, {r6('list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE)))', 'total')} FROM embeddings"),
)
def _(t: Tables):
    store = vectors.load_vectors(t.spark, f"{t.folder}/embeddings.parquet", ["vec_id"], "embedding")
    total = F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda a, x: a + x)
    return store.select("vec_id", F.size("embedding").cast("long").alias("dim"), total.alias("total"))


@query(
    "dataset_summary",
    sql(
        "entries docs",
        """SELECT 'events' AS table_name, count(*) AS n_rows, count(DISTINCT user_id) AS n_entities,
           count(*) FILTER (flag) AS n_true, count(*) FILTER (NOT flag) AS n_false, count(*) FILTER (flag IS NULL) AS n_null FROM entries
           UNION ALL SELECT 'documents', count(*), count(DISTINCT source), count(*) FILTER (flag), count(*) FILTER (NOT flag), count(*) FILTER (flag IS NULL) FROM docs
           UNION ALL SELECT 'orders', count(*), count(DISTINCT o_custkey), 0, 0, count(*) FROM orders""",
    ),
)
def _(t: Tables):
    return tables.summary(
        {"events": t.entries, "documents": t.docs, "orders": t.raw("orders")},
        {"events": "user_id", "documents": "source", "orders": "o_custkey"},
        {"events": "flag", "documents": "flag", "orders": None},
    )


@query(
    "evaluation_log",
    sql(
        "level_preds",
        f"""SELECT 'r1' AS run_id, CAST(NULL AS VARCHAR) AS git_commit, CAST(42 AS BIGINT) AS seed, CAST(NULL AS VARCHAR) AS "timestamp",
            md5('r1:42') AS config_hash, 'levels' AS task, 'all_rows' AS regime, flag_slice AS slice, 'affine' AS model_tag,
            CAST(NULL AS DOUBLE) AS primary_score,
            {', '.join(f'CAST(NULL AS DOUBLE) AS {c}' for c in 'r_composite_valence r_within_valence r_between_valence r_composite_arousal r_within_arousal r_between_arousal r_delta_valence r_delta_arousal r_dispo_valence r_dispo_arousal'.split())},
            {r6('avg(abs(v - v_pred))', 'mae_valence')}, {r6('avg(abs(a - a_pred))', 'mae_arousal')},
            {r6('avg((v - v_pred) ** 2)', 'mse_valence')}, {r6('avg((a - a_pred) ** 2)', 'mse_arousal')},
            {', '.join(f'CAST(NULL AS DOUBLE) AS {c}' for c in 'mae_delta_valence mae_delta_arousal mae_dispo_valence mae_dispo_arousal'.split())}
            FROM (SELECT *, unnest(['all', CASE WHEN flag THEN 'words' ELSE 'essays' END]) AS flag_slice FROM level_preds)
            GROUP BY flag_slice""",
    ),
)
def _(t: Tables):
    sliced = metrics.with_slices(t.level_preds, "flag", "words", "essays")
    rows = metrics.regression_errors(sliced, ["v", "a"], ["slice"])
    rows = rows.withColumnsRenamed(
        {"mae_v": "mae_valence", "mae_a": "mae_arousal", "mse_v": "mse_valence", "mse_a": "mse_arousal"}
    ).withColumn("config_hash", key_digest(F.lit("r1"), F.lit(SEED)))
    return sinks.log_rows(rows, run_id="r1", seed=SEED, task="levels", regime="all_rows", model_tag="affine")


@query(
    "scores_known",
    sql("docs", "SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) AS has_score FROM docs"),
)
def _(t: Tables):
    return scoring.with_known_scores(t.docs.select("doc_id"), t.raw("labels"), ["doc_id"])


@query("reuse_stored_scores", sql("labelled", f"SELECT doc_id, {r6s('quality toxic')} FROM labelled"))
def _(t: Tables):
    wanted = t.labelled.select("doc_id")
    stored = t.labelled.select("doc_id", "quality", "toxic")
    return scoring.reuse_or_score(wanted, stored, ["doc_id"], lambda d: d.withColumns({"quality": F.lit(0.0), "toxic": F.lit(0.0)}))


# --- filters ---------------------------------------------------------------------


@query("eligible_rows", sql("timeline", f"SELECT user_id, event_id, {r6s('dv da')} FROM timeline WHERE {OK}"))
def _(t: Tables):
    return filters.eligible_rows(t.timeline, EVENTS).select("user_id", "event_id", "dv", "da")


@query(
    "drop_incomplete",
    sql("gappy", f"SELECT user_id, event_id, {r6s('v dv')} FROM gappy WHERE v IS NOT NULL AND dv IS NOT NULL"),
)
def _(t: Tables):
    return filters.drop_incomplete(t.gappy.select("user_id", "event_id", "v", "dv"), ["v", "dv"])


@query("first_half_rows", sql("halves", f"SELECT user_id, event_id, {r6('v')} FROM halves WHERE half = 1"))
def _(t: Tables):
    return filters.keep_where(t.halves, "half", 1).select("user_id", "event_id", "v")


@query(
    "rows_of_split",
    sql("entries user_split", f"SELECT user_id, event_id, {r6('v')} FROM entries JOIN user_split USING (user_id) WHERE part = 'val'"),
)
def _(t: Tables):
    return filters.rows_of_part(t.entries, t.user_split, ["user_id"], "val").select("user_id", "event_id", "v")


@query(
    "standard_forecast",
    sql(
        "anchor_preds",
        f"SELECT CAST(user_id AS VARCHAR) AS user_id, {r6('dv_pred', 'dv_model')}, {r6('da_pred', 'da_model')}, anchor_id, epoch_us(anchor_ts) AS anchor_ts FROM anchor_preds",
    ),
)
def _(t: Tables):
    return filters.standard_forecast(t.anchor_preds, "model")


@query(
    "range_report",
    sql(
        "gappy",
        " UNION ALL ".join(
            f"""SELECT '{c}' AS name, count(*) AS n, count(*) FILTER ({c} IS NULL) AS nulls, count(*) FILTER (isnan({c}) OR isinf({c})) AS non_finite,
                {r6(f'min({c})', '"min"')}, {r6(f'max({c})', '"max"')}, count(*) FILTER ({c} < {lo} OR {c} > {hi}) = 0 AS ok FROM gappy"""
            for c, lo, hi in (("v", 0, 500), ("a", 10, 80), ("dv", -400, 400))
        ),
    ),
)
def _(t: Tables):
    return filters.range_report(t.gappy, {"v": (0, 500), "a": (10, 80), "dv": (-400, 400)})


@query("clipped_predictions", sql("gappy", f"SELECT event_id, {r6('CASE WHEN v IS NOT NULL THEN least(greatest(v, 0), 50) END', 'v')}, {r6('CASE WHEN a IS NOT NULL THEN least(greatest(a, 10), 80) END', 'a')} FROM gappy"))
def _(t: Tables):
    return filters.clip_columns(t.gappy.select("event_id", "v", "a"), BOUNDS)


@query(
    "clip_report",
    sql(
        "gappy",
        " UNION ALL ".join(
            f"""SELECT '{c}' AS name, {r6(f'avg(CASE WHEN {c} < {lo} OR {c} > {hi} THEN 1.0 ELSE 0.0 END)', 'before_share')}, CAST(0 AS DOUBLE) AS after_share,
                CAST({lo} AS DOUBLE) AS low, CAST({hi} AS DOUBLE) AS high FROM gappy"""
            for c, (lo, hi) in BOUNDS.items()
        ),
    ),
)
def _(t: Tables):
    return filters.clip_report(t.gappy, BOUNDS)


@query(
    "unit_scale",
    sql("entries", f"SELECT event_id, {r6('2 * v - 2', 'wide')}, {r6('(a + 2) / 2', 'narrow')}, {r6('v', 'back')} FROM entries"),
)
def _(t: Tables):
    wide = to_unit_scale(F.col("v"))
    return t.entries.select(
        "event_id", wide.alias("wide"), from_unit_scale(F.col("a")).alias("narrow"), from_unit_scale(wide).alias("back")
    )


@query("first_rows", sql("docs", "SELECT doc_id, source FROM docs ORDER BY doc_id LIMIT 512"))
def _(t: Tables):
    return filters.first_rows(t.docs.select("doc_id", "source"), ["doc_id"], 512)


@query(
    "trial_split_rows",
    sql(
        "entries user_split",
        """SELECT user_id, event_id, part FROM (SELECT user_id, event_id FROM entries ORDER BY user_id, event_id LIMIT 512)
           JOIN user_split USING (user_id)""",
    ),
)
def _(t: Tables):
    keyed = join_one_row_per_key(t.entries.select("user_id", "event_id"), t.user_split, ["user_id"])
    return splits.trial_rows(t.entries, keyed, EVENTS, 512).select("user_id", "event_id", "part")


@query(
    "missing_flags",
    sql("gappy", "SELECT event_id, CAST(v IS NULL AS DOUBLE) AS v_missing, CAST(dv IS NULL AS DOUBLE) AS dv_missing FROM gappy"),
)
def _(t: Tables):
    return filters.missing_flags(t.gappy, ["v", "dv"]).select("event_id", "v_missing", "dv_missing")


@query(
    "finite_features",
    sql(
        "gappy",
        f"SELECT event_id, {r6('CAST(CAST(coalesce(v, 0) AS FLOAT) AS DOUBLE)', 'v')}, {r6('CAST(CAST(coalesce(dv, 0) AS FLOAT) AS DOUBLE)', 'dv')} FROM gappy",
    ),
)
def _(t: Tables):
    return filters.finite_features(t.gappy.select("event_id", "v", "dv"), ["v", "dv"])


@query("ablated_columns", sql("entries", f"SELECT event_id, CAST(0 AS DOUBLE) AS v, {r6('a')} FROM entries"))
def _(t: Tables):
    return filters.zero_columns(t.entries.select("event_id", "v", "a"), ["v"])


# --- text and scalar functions -----------------------------------------------------

WHITE = r"[\t-\r\x{1c}-\x{1f}\x{85}\p{Z}]+"
TOKENS = f"len(list_filter(regexp_split_to_array(text, '{WHITE}'), lambda x: x <> ''))"
MARKS = "len(regexp_extract_all(text, '[.!?]'))"


@query("token_counts", sql("docs", f"SELECT doc_id, CAST({TOKENS} AS INTEGER) AS n_tokens FROM docs"))
def _(t: Tables):
    return t.docs.select("doc_id", tx.token_count(F.col("text")).alias("n_tokens"))


@query("character_counts", sql("", "SELECT conv_id, turn, CAST(length(text) AS INTEGER) AS n_chars FROM conversations"))
def _(t: Tables):
    return t.raw("conversations").select("conv_id", "turn", tx.character_count(F.col("text")).alias("n_chars"))


@query("sentence_marks", sql("docs", f"SELECT doc_id, CAST({MARKS} AS INTEGER) AS n_marks FROM docs"))
def _(t: Tables):
    return t.docs.select("doc_id", tx.sentence_mark_count(F.col("text")).alias("n_marks"))


@query("flag_as_int", sql("docs", "SELECT doc_id, CAST(flag AS TINYINT) AS flag_int FROM docs"))
def _(t: Tables):
    return t.docs.select("doc_id", F.col("flag").cast("tinyint").alias("flag_int"))


@query(
    "text_features",
    sql(
        "docs",
        f"""SELECT doc_id, n_tokens, n_chars, n_marks, flag_int,
            {r6('coalesce((n_tokens - avg(n_tokens) OVER ()) / nullif(stddev_samp(n_tokens) OVER (), 0), 0)', 'n_tokens_z')},
            {r6('coalesce((n_chars - avg(n_chars) OVER ()) / nullif(stddev_samp(n_chars) OVER (), 0), 0)', 'n_chars_z')}
            FROM (SELECT doc_id, CAST({TOKENS} AS INTEGER) AS n_tokens, CAST(length(text) AS INTEGER) AS n_chars,
                  CAST({MARKS} AS INTEGER) AS n_marks, CAST(flag AS TINYINT) AS flag_int FROM docs)""",
    ),
)
def _(t: Tables):
    done = tx.text_features(t.docs)
    return done.select("doc_id", "n_tokens", "n_chars", "n_marks", "flag_int", "n_tokens_z", "n_chars_z")


@query(
    "short_text_features",
    sql("docs", f"SELECT doc_id, CAST(length(text) AS INTEGER) AS n_chars, CAST({TOKENS} AS INTEGER) AS n_tokens, CAST(flag AS TINYINT) AS flag_int FROM docs"),
)
def _(t: Tables):
    return tx.short_text_features(t.docs).select("doc_id", "n_chars", "n_tokens", "flag_int")


@query(
    "dataset_z_score",
    sql("entries", f"SELECT event_id, {r6('(v - avg(v) OVER ()) / stddev_samp(v) OVER ()', 'v_z')} FROM entries"),
)
def _(t: Tables):
    return tx.z_scores(t.entries, {"v": "v_z"}).select("event_id", "v_z")


@query(
    "sign_abs_square",
    sql("timeline", f"SELECT event_id, {r6('CAST(sign(dv) AS DOUBLE)', 'sign_dv')}, {r6('abs(dv)', 'abs_dv')}, {r6('dv * dv', 'sq_dv')} FROM timeline"),
)
def _(t: Tables):
    d = F.col("dv")
    return t.timeline.select(
        "event_id", F.signum(d).alias("sign_dv"), F.abs(d).alias("abs_dv"), F.pow(d, F.lit(2.0)).alias("sq_dv")
    )


@query(
    "dates_parsed",
    sql("", "SELECT event_id, epoch_us(ts) AS ts, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso FROM events"),
)
def _(t: Tables):
    text = t.raw("events").select("event_id", F.col("ts").cast("string").alias("text"))
    parsed = text.select("event_id", F.to_timestamp_ntz("text").alias("ts"))
    return parsed.select("event_id", "ts", F.date_format(F.col("ts"), "yyyy-MM-dd'T'HH:mm:ss").alias("iso"))


@query(
    "numbers_coerced",
    sql(
        "",
        """SELECT o_orderkey, TRY_CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS leading, TRY_CAST(o_orderstatus AS DOUBLE) AS status_number,
           lower(trim(o_orderstatus)) IN ('true', '1', 't', 'yes', 'y') AS is_true FROM orders""",
    ),
)
def _(t: Tables):
    return t.raw("orders").select(
        "o_orderkey",
        F.substring("o_orderpriority", 1, 1).try_cast("int").alias("leading"),
        F.col("o_orderstatus").try_cast("double").alias("status_number"),
        lenient_bool(F.col("o_orderstatus")).alias("is_true"),
    )


TERMS = r"""SELECT doc_id, term, count(*) AS tf FROM (
    SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term
    FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS w FROM docs)) GROUP BY ALL"""
VOCABULARY = "SELECT term, sum(tf) AS tf, count(*) AS df FROM terms GROUP BY term HAVING count(*) >= 2 ORDER BY sum(tf) DESC, term LIMIT 20000"


@query("term_counts", sql("docs", "SELECT * FROM terms", terms=TERMS))
def _(t: Tables):
    return terms.term_counts(t.docs, "doc_id")


@query(
    "top_terms",
    sql("docs", "SELECT term, CAST(tf AS BIGINT) AS tf, df FROM vocabulary", terms=TERMS, vocabulary=VOCABULARY),
)
def _(t: Tables):
    return terms.top_terms(terms.term_counts(t.docs, "doc_id"), 20_000, 2)


@query(
    "tfidf_weights",
    sql(
        "docs",
        f"SELECT doc_id, term, {r6('w / sqrt(sum(w * w) OVER (PARTITION BY doc_id))', 'weight')} FROM raw_weights",
        terms=TERMS,
        vocabulary=VOCABULARY,
        raw_weights="""SELECT doc_id, term, t.tf * (ln((1.0 + (SELECT count(*) FROM docs)) / (1.0 + v.df)) + 1.0) AS w
                       FROM terms t JOIN vocabulary v USING (term)""",
    ),
)
def _(t: Tables):
    n = t.raw("documents").agg(F.count(F.lit(1))).scalar()
    vocabulary = terms.top_terms(terms.term_counts(t.docs, "doc_id"), 20_000, 2)
    return terms.tfidf_weights(t.docs, vocabulary, n, "doc_id")


@query(
    "key_hash",
    sql("", "SELECT event_id, md5(concat(user_id, ':', event_id, ':42')) AS digest, CAST('0x' || substr(md5(concat(user_id, ':', event_id, ':42')), 1, 8) AS BIGINT) AS number FROM events"),
)
def _(t: Tables):
    digest = key_digest(F.col("user_id"), F.col("event_id"), F.lit(SEED))
    return t.raw("events").select("event_id", digest.alias("digest"), digest_number(digest).alias("number"))


@query(
    "array_pad_slice",
    sql(
        "",
        f"""SELECT vec_id, {r6('CAST(list_sum(list_slice(embedding, 1, 8)) AS DOUBLE)', 'head')}, len(list_concat([0.0, 0.0], embedding)) AS padded FROM embeddings""",
    ),
)
def _(t: Tables):
    v = F.col("embedding")
    padded = F.concat(F.array_repeat(F.lit(0.0).cast("float"), 2), v)
    head = F.aggregate(F.slice(v, 1, 8).cast("array<double>"), F.lit(0.0), lambda a, x: a + x)
    return t.raw("embeddings").select("vec_id", head.alias("head"), F.size(padded).cast("long").alias("padded"))


@query(
    "entry_positions",
    sql("", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position FROM conversations"),
)
def _(t: Tables):
    rows = t.raw("conversations").select("conv_id", "turn")
    return Timeline(rows, "conv_id", ["turn"]).running(position=RowsBefore()).result()


