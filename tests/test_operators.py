"""Operators on small hand-made tables: edge rows, raised errors and invariants."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tideline.functions import expressions as ex
from tideline.functions import terms
from tideline.functions import text as tx
from tideline.functions.quantiles import exact_quantiles
from tideline.operators import (
    aggregates,
    anchors,
    audits,
    baselines,
    datasets,
    filters,
    joins,
    forest,
    learn,
    metrics,
    profiles,
    scoring,
    splits,
    windows,
)
from tideline.roles import Roles
from tideline.scale import join_one_row_per_key
from tideline.sources import sinks, tables, vectors

R = Roles("user_id", "ts", "text_id", ("v", "a"), ("dv", "da"), "flag")
ROWS = [
    ("u1", 1, 1, 0.1, 0.0),
    ("u1", 2, 2, 0.2, 0.1),
    ("u1", 3, 3, None, None),
    ("u1", 4, 4, 0.05, -0.1),
    ("u1", 5, 5, 0.1, 0.2),
    ("u2", 1, 10, 0.0, 0.0),
    ("u2", 2, 11, 0.1, 0.0),
    ("u2", 3, 12, 0.1, 0.1),
    ("u2", 4, 13, None, None),
]


@pytest.fixture
def small(spark):
    rows = [(u, f"2025-01-0{d} 00:00:00", k, dv, da, float(d), -float(d)) for u, d, k, dv, da in ROWS]
    df = spark.createDataFrame(rows, "user_id string, t string, text_id long, dv double, da double, v double, a double")
    return df.withColumn("ts", F.col("t").cast("timestamp")).drop("t")


def column(df, name, key="text_id"):
    return {r[key]: r[name] for r in df.collect()}


# --- history and anchors ------------------------------------------------------------


def test_eligible_lag_skips_unknown_rows(small):
    rows = windows.previous_eligible_delta(windows.timeline(small, R), R).result()
    assert column(rows, "dv_prev") == {1: None, 2: 0.1, 3: None, 4: 0.2, 5: 0.05, 10: None, 11: 0.0, 12: 0.1, 13: None}


def test_plain_lag_keeps_unknown_rows(small):
    rows = windows.lagged_delta(windows.timeline(small, R), R).result()
    assert column(rows, "dv_lag") == {1: None, 2: 0.1, 3: 0.2, 4: None, 5: 0.05, 10: None, 11: 0.0, 12: 0.1, 13: 0.1}
    moved = windows.momentum(windows.timeline(small, R), R).result()
    assert column(moved, "dv_pred")[1] == 0.0 and column(moved, "dv_pred")[4] is None


def test_latest_eligible_anchor_per_user(small):
    assert column(anchors.latest_eligible(small, R), "text_id", "user_id") == {"u1": 5, "u2": 12}


def test_fit_and_predict_two_lags(small):
    rows = windows.previous_eligible_delta(windows.timeline(small, R), R).result()
    model = baselines.fit_two_lags(rows, R)
    assert {r["fit_rows"] for r in model.collect()} == {5}
    pdf = rows.where("dv_prev is not null").toPandas()
    x = np.column_stack([np.ones(len(pdf)), pdf["dv_prev"], pdf["da_prev"]])
    for d in ("dv", "da"):
        want = np.linalg.lstsq(x, pdf[d], rcond=None)[0]
        got = model.where(F.col("delta") == d).first()
        np.testing.assert_allclose([got["intercept"], got["coef_1"], got["coef_2"]], want, atol=1e-10)
    done = baselines.predict_two_lags(rows, model, R)
    assert done.where("dv_pred is null").count() == 0
    found = baselines.anchor_predictions(done, R)
    assert found.count() == 2 and set(found.columns) >= {"user_id", "anchor_id", "dv_pred", "da_pred"}


def test_collinear_lags_still_fit(spark):
    rows = spark.createDataFrame([("u", float(i), float(i), 2.0 * i, 2.0 * i) for i in range(5)], "user_id string, dv_prev double, da_prev double, dv double, da double")
    done = baselines.predict_two_lags(rows, baselines.fit_two_lags(rows, R), R)
    assert all(abs(r["dv"] - r["dv_pred"]) < 1e-9 for r in done.collect())


def test_history_does_not_see_the_row_or_its_future(small):
    columns = ["history_len", "dv_mean_prev", "dv_ema_prev", "dv_prev", "v_prev_state", "gap_prev_seconds"]
    before = datasets.history_block(small, R).where("text_id <= 4").select("text_id", *columns)
    late = F.col("text_id") >= 4
    changed = small.withColumns({c: F.when(late, 99.0).otherwise(F.col(c)) for c in ("v", "dv", "da")})
    after = datasets.history_block(changed, R).where("text_id <= 4").select("text_id", *columns)
    assert sorted(before.collect()) == sorted(after.collect())


def test_equal_times_are_ordered_by_tie(spark):
    rows = spark.createDataFrame([("u", 1, 2, 5.0), ("u", 1, 1, 3.0), ("u", 1, 3, 7.0)], "user_id string, ts long, text_id long, v double")
    done = windows.entry_index(windows.timeline(rows, R)).result()
    assert column(done, "entry_index") == {1: 0, 2: 1, 3: 2}
    assert anchors.latest_row(rows, R).first()["text_id"] == 3


def test_half_split_of_odd_even_and_single(spark):
    rows = spark.createDataFrame([(u, i, i) for u, n in (("a", 1), ("b", 4), ("c", 5)) for i in range(n)], "user_id string, ts long, text_id long")
    done = windows.halves(windows.timeline(rows, R)).result()
    sizes = {(r["user_id"], r["half"]): r["count"] for r in done.groupBy("user_id", "half").count().collect()}
    assert sizes == {("a", 2): 1, ("b", 1): 2, ("b", 2): 2, ("c", 1): 2, ("c", 2): 3}


def test_time_split_keeps_both_sides(spark):
    rows = spark.createDataFrame([(u, i, i) for u, n in (("a", 1), ("b", 2), ("c", 10)) for i in range(n)], "user_id string, ts long, text_id long")
    done = windows.time_split(windows.timeline(rows, R)).result()
    sizes = {(r["user_id"], r["part"]): r["count"] for r in done.groupBy("user_id", "part").count().collect()}
    assert sizes == {("a", "train"): 1, ("b", "train"): 1, ("b", "val"): 1, ("c", "train"): 8, ("c", "val"): 2}


def test_cutoff_is_strict_and_missing_users_raise(small, spark):
    cut = spark.createDataFrame([("u1", "2025-01-03"), ("u1", "2025-01-05"), ("u2", "2025-01-02")], "user_id string, c string")
    cut = cut.select("user_id", F.col("c").cast("timestamp").alias("cutoff"))
    assert column(anchors.last_before(small, cut, R), "text_id", "user_id") == {"u1": 2, "u2": 10}
    assert column(anchors.last_before(small, cut, R, inclusive=True), "text_id", "user_id") == {"u1": 3, "u2": 11}
    early = cut.withColumn("cutoff", F.lit("2025-01-01").cast("timestamp"))
    with pytest.raises(ValueError, match="no row before"):
        anchors.last_before(small, early, R)


def test_anchor_modes(small, spark):
    marked = spark.createDataFrame([("u1", "TRUE"), ("u2", "no")], "user_id string, is_forecast string")
    assert column(anchors.forecast_anchors(small, R, markers=marked), "text_id", "user_id") == {"u1": 5}
    keyed = spark.createDataFrame([("u1", 2), ("u2", 12)], "user_id string, anchor_id long")
    assert anchors.forecast_anchors(small, R, markers=keyed).count() == 2
    lost = spark.createDataFrame([("u1", 77)], "user_id string, anchor_id long")
    with pytest.raises(ValueError, match="marker without a row"):
        anchors.forecast_anchors(small, R, markers=lost)


def test_sequences_are_padded_on_the_left(small):
    rows = small.withColumn("vec", F.array(F.col("v").cast("float")))
    done = windows.sequences(windows.timeline(rows, R), "vec", 3, windows.zero_vector(1)).result()
    got = {r["text_id"]: ([x[0] for x in r["seq"]], r["seq_len"]) for r in done.collect()}
    assert got[1] == ([0.0, 0.0, 1.0], 1) and got[2] == ([0.0, 1.0, 2.0], 2) and got[5] == ([3.0, 4.0, 5.0], 3)


# --- joins and keys -----------------------------------------------------------------


def test_checked_joins_refuse_bad_keys(spark):
    one = spark.createDataFrame([(1, "a"), (2, "b")], "k long, x string")
    twice = spark.createDataFrame([(1, 1.0), (1, 2.0)], "k long, y double")
    part = spark.createDataFrame([(1, 1.0)], "k long, y double")
    for left, right in ((one, twice), (twice, one)):
        with pytest.raises(ValueError, match="duplicate"):
            joins.one_to_one(left, right, ["k"])
    with pytest.raises(ValueError, match="no single match"):
        joins.full_coverage(one, part, ["k"])
    with pytest.raises(ValueError, match="duplicate"):
        joins.many_to_one(one, twice, ["k"])
    with pytest.raises(ValueError, match="key sets differ"):
        joins.aligned(one, part, ["k"])
    assert joins.full_coverage(part, one, ["k"]).count() == 1


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_hot_key_join_equals_plain_join(spark, tiny_tasks, how):
    left = spark.range(200).select((F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id"))).alias("k"), F.col("id").alias("x"))
    right = spark.range(0, 150).select(F.col("id").alias("k"), (F.col("id") * 2).alias("y"))
    got = join_one_row_per_key(left, right, ["k"], how)
    assert sorted(got.collect()) == sorted(left.join(right, ["k"], how).collect())


def test_key_differences_and_mismatches(spark):
    a = spark.createDataFrame([(1, 1.0), (2, None), (3, 3.0)], "k long, x double")
    b = spark.createDataFrame([(2, None), (3, 4.0), (4, 4.0)], "k long, x double")
    assert column(joins.key_differences(a, b, ["k"]), "side", "k") == {1: "missing", 4: "extra"}
    assert sorted(r["k"] for r in joins.mismatches(a, b, ["k"], ["x"]).collect()) == [1, 3]


# --- filters, values, text ------------------------------------------------------------


def test_range_report_counts_non_finite(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (float("inf"),), (9.0,)], "x double")
    row = filters.range_report(df, {"x": (0, 5)}).first()
    assert (row["n"], row["nulls"], row["non_finite"], row["min"], row["max"], row["ok"]) == (5, 1, 2, 1.0, 9.0, False)
    with pytest.raises(ValueError, match="out of range"):
        filters.require_range(df, {"x": (0, 5)})


def test_non_finite_features_fail(spark):
    df = spark.createDataFrame([(1.0,), (float("inf"),)], "x double")
    with pytest.raises(Exception, match="not finite"):
        filters.finite_features(df, ["x"]).collect()


def test_text_counts_on_edge_texts(spark):
    texts = ["", "   ", "a  b\tc", "Hi! Ok? Yes.", "x y", "😀 z", None]
    df = spark.createDataFrame([(i, t, True) for i, t in enumerate(texts)], "id int, text string, flag boolean")
    done = tx.text_features(df)
    assert [column(done, "n_tokens", "id")[i] for i in range(7)] == [0, 0, 3, 3, 2, 2, 0]
    assert column(done, "n_chars", "id")[5] == 3
    assert column(done, "n_marks", "id")[3] == 3
    flat = tx.text_features(df.where("id = 0"))
    assert flat.first()["n_tokens_z"] == 0.0


def test_terms_are_words_and_neighbour_pairs(spark):
    df = spark.createDataFrame([(1, "The cat, a CAT sat"), (2, "x")], "id int, text string")
    got = {(r["id"], r["term"]): r["tf"] for r in terms.term_counts(df, "id").collect()}
    assert got == {(1, "the"): 1, (1, "cat"): 2, (1, "sat"): 1, (1, "the cat"): 1, (1, "cat cat"): 1, (1, "cat sat"): 1}


def test_bool_spellings_and_number_tags(spark):
    df = spark.createDataFrame([(" Yes ",), ("0",), (None,), ("T",)], "x string")
    assert [r[0] for r in df.select(ex.lenient_bool(F.col("x"))).collect()] == [True, False, False, True]
    assert ex.number_tag(0.25) == "0p25" and ex.number_tag(1.0) == "1"
    numbers = [0.25, 1.0, -0.5, 10.0, 0.0, 120.0]
    tags = spark.createDataFrame([(x,) for x in numbers], "x double").select(ex.number_tags(F.col("x"))).collect()
    assert [r[0] for r in tags] == [ex.number_tag(x) for x in numbers]


@pytest.mark.parametrize("hot", [False, True])
def test_exact_quantiles_equal_numpy(spark, request, hot):
    if hot:
        request.getfixturevalue("tiny_tasks")
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 600), "x": np.round(rng.normal(size=600), 2)})
    pdf.loc[::3, "x"] = 0.5
    probabilities = {"p01": 0.01, "p50": 0.5, "p99": 0.99}
    got = exact_quantiles(spark.createDataFrame(pdf), ["g"], "x", probabilities).toPandas().set_index("g").sort_index()
    want = pdf.groupby("g")["x"].quantile(list(probabilities.values())).unstack()
    np.testing.assert_allclose(got[list(probabilities)].to_numpy(), want.to_numpy(), atol=1e-12)
    total = exact_quantiles(spark.createDataFrame(pdf), [], "x", probabilities).first()
    np.testing.assert_allclose([total[p] for p in probabilities], np.quantile(pdf["x"], list(probabilities.values())))


def test_value_summary_of_unusual_values(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", float("nan")), ("a", float("-inf")), ("a", -3.0), ("b", None)], "g string, x double")
    rows = {r["g"]: r for r in aggregates.value_summary(df, "x", ["g"], {"a": (-2, 2)}).collect()}
    a, b = rows["a"], rows["b"]
    assert (a["n"], a["nan_count"], a["inf_count"], a["mean"], a["std"], a["abs_max"]) == (4, 1, 1, -1.0, 2.0, 3.0)
    assert (a["frac_below"], a["frac_above"]) == (0.5, 0.0)
    assert b["nan_count"] == 1 and b["mean"] is None


def test_histogram_of_a_constant(spark):
    df = spark.createDataFrame([(2.0,)] * 4, "x double")
    assert sum(r["n"] for r in aggregates.histogram(df, "x", 4).collect()) == 4


# --- metrics ----------------------------------------------------------------------------


def test_correlation_of_constant_and_tiny_groups(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.0, 3.0), ("b", 1.0, 1.0), ("c", 1.0, 2.0), ("c", 2.0, 4.0)], "g string, x double, y double")
    got = df.groupBy("g").agg(ex.safe_pearson(F.col("x"), F.col("y")).alias("r"), ex.pearson(F.col("x"), F.col("y")).alias("p"))
    assert column(got, "r", "g") == pytest.approx({"a": 0.0, "b": 0.0, "c": 1.0})
    assert column(got, "p", "g")["a"] is None


def test_composite_correlation_by_hand(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"u": np.repeat([1, 2, 3, 4], [5, 5, 5, 1]), "v": rng.normal(size=16)})
    pdf["v_pred"] = pdf["v"] * 0.5 + rng.normal(size=16)
    within = np.mean([np.corrcoef(g["v"], g["v_pred"])[0, 1] for _, g in pdf.groupby("u") if len(g) > 1])
    means = pdf.groupby("u")[["v", "v_pred"]].mean()
    between = np.corrcoef(means["v"], means["v_pred"])[0, 1]
    got = metrics.composite_correlations(spark.createDataFrame(pdf), "u", ["v"]).first()
    np.testing.assert_allclose([got["r_within_v"], got["r_between_v"], got["primary_score"]], [within, between, (within + between) / 2])


def test_sign_agreement_counts_zero_with_zero_only(spark):
    df = spark.createDataFrame([(0.0, 0.0), (1.0, 0.0), (-1.0, -2.0)], "dv double, dv_pred double")
    assert metrics.delta_errors(df, ["dv"]).first()["sign_dv"] == pytest.approx(2 / 3)


# --- profiles and normalisation -----------------------------------------------------------


def test_half_profile_matches_numpy(small):
    halves = windows.halves(windows.timeline(small.where("user_id = 'u1' or text_id <= 11"), R)).result()
    rows = {r["user_id"]: r for r in profiles.half_profile(halves, R).collect()}
    assert set(rows["u1"].asDict()) >= set(profiles.profile_columns(R))
    assert rows["u1"]["v_slope"] == pytest.approx(1.0) and rows["u1"]["v_std"] == pytest.approx(0.5)
    assert rows["u2"]["v_slope"] == 0.0 and rows["u2"]["v_std"] == 0.0 and rows["u2"]["n_half1"] == 1


def test_constant_column_is_scaled_by_one(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "x double, c double")
    stats = profiles.fit_norm_stats(df, ["x", "c"])
    assert sorted(tuple(r) for r in profiles.apply_norm_stats(df, stats, ["x", "c"]).collect()) == [(-1.0, 0.0), (1.0, 0.0)]


def test_vector_pooling(spark):
    df = spark.createDataFrame([("u", 1, 1, [1.0, 3.0]), ("u", 2, 2, [3.0, 5.0])], "user_id string, ts long, text_id long, vec array<float>")
    got = {p: profiles.pooled_vectors(df, R, "vec", p).first()["pooled"] for p in ("mean", "last", "mean_last")}
    assert got == {"mean": [2.0, 4.0], "last": [3.0, 5.0], "mean_last": [2.0, 4.0, 3.0, 5.0]}


# --- splits -----------------------------------------------------------------------------


def test_group_split_sizes_and_stability(spark):
    df = spark.range(137).select((F.col("id") % 137).alias("user_id"))
    split = splits.group_split(df, "user_id", 42)
    sizes = {r["part"]: r["count"] for r in split.groupBy("part").count().collect()}
    assert sizes == {"train": 109, "val": 28}
    again = splits.group_split(df.repartition(7), "user_id", 42)
    assert sorted(split.collect()) == sorted(again.collect())
    other = splits.group_split(df, "user_id", 43)
    assert sorted(split.collect()) != sorted(other.collect())
    assert splits.split_summary(split, ["user_id"], 137).first()["valid"]


def test_group_folds_are_even_and_fall_back(spark):
    df = spark.range(1000).select((F.col("id") % 40).alias("u"))
    sizes = [r["count"] for r in splits.group_folds(df, "u", 5).groupBy("fold").count().collect()]
    assert sizes == [8] * 5
    few = splits.group_folds(df.where("u < 3"), "u", 5)
    assert sorted(r["fold"] for r in few.collect()) == [-1, -1, 0]


def test_split_files_in_all_layouts(spark, tmp_path):
    layouts = {
        "positions": {"train_indices": [0, 1], "val_indices": [2]},
        "keys": {"train_ids": [7, 8], "val_ids": [9], "id_type": "text_id"},
        "untyped": {"train_ids": [0], "val_ids": [1]},
    }
    for name, payload in layouts.items():
        path = tmp_path / f"{name}.json"
        path.write_text(json.dumps(payload))
        got = splits.load_split(spark, str(path))
        assert got.where("part = 'val'").count() == 1
        assert got.first()["id_type"] == payload.get("id_type", "row_index")
    bad = tmp_path / "bad.json"
    bad.write_text("{\"a\": 1}")
    with pytest.raises(ValueError, match="not a split file"):
        splits.load_split(spark, str(bad))


def test_load_or_create_split_once(spark, tmp_path):
    path = str(tmp_path / "split")
    df = spark.range(20).select(F.col("id").alias("u"))
    first = splits.load_or_create(spark, path, lambda: splits.group_split(df, "u", 1)).collect()
    second = splits.load_or_create(spark, path, lambda: splits.group_split(df, "u", 2)).collect()
    assert sorted(first) == sorted(second)


# --- models ---------------------------------------------------------------------------


def ridge_exact(x, y, alpha):
    xc, yc = x - x.mean(0), y - y.mean()
    w = np.linalg.solve(xc.T @ xc + alpha * np.eye(x.shape[1]), xc.T @ yc)
    return x @ w + y.mean() - x.mean(0) @ w


def test_ridge_equals_closed_form(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 4)) * [1.0, 2.0, 0.5, 3.0]
    y = x @ [1.0, -2.0, 0.5, 0.0] + rng.normal(size=60)
    pdf = pd.DataFrame(x, columns=list("pqrs")).assign(y=y)
    rows = learn.assemble(spark.createDataFrame(pdf), list("pqrs"))
    got = learn.apply_models(rows, learn.fit_ridge(rows, "features", ["y"], 1.0)).toPandas()["y_pred"]
    np.testing.assert_allclose(got, ridge_exact(x, y, 1.0), atol=1e-6)


def test_forest_fits_a_step(spark):
    rows = learn.assemble(spark.createDataFrame([(float(i), float(i >= 10)) for i in range(20)], "x double, y double"), ["x"])
    got = learn.apply_models(rows, learn.fit_forest(rows, "features", ["y"], trees=10)).toPandas()
    # Resampled trees differ next to the step, so only the rows around it may be off.
    error = (got["y"] - got["y_pred"]).abs()
    assert error[(got["x"] < 8) | (got["x"] > 11)].max() < 1e-9 and error.mean() < 0.1


def test_forest_depends_on_rows_alone(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 3))
    rows = [(i, *map(float, r), float(r[0] * r[1] + rng.normal() / 5)) for i, r in enumerate(x)]
    df = learn.assemble(spark.createDataFrame(rows, "k long, p double, q double, r double, y double"), list("pqr"))
    ways = [df.repartition(2), df.repartitionByRange(7, F.desc("y"))]
    got = [learn.apply_models(df, learn.fit_forest(w, "features", ["y"], trees=10, key=["k"])).orderBy("k").toPandas() for w in ways]
    assert (got[0]["y_pred"] == got[1]["y_pred"]).all()
    assert ((got[0]["y_pred"] - got[0]["y"]) ** 2).mean() < got[0]["y"].var() / 2


def test_forest_takes_few_jobs_and_splits_large_nodes_alike(spark, monkeypatch):
    rng = np.random.default_rng(7)
    x = np.round(rng.normal(size=(600, 3)), 1)
    rows = [(i, *map(float, r), float(r[0] * r[1] + rng.normal() / 5)) for i, r in enumerate(x)]
    df = learn.assemble(spark.createDataFrame(rows, "k long, p double, q double, r double, y double"), list("pqr"))
    context = spark.sparkContext
    got = []
    for local in (50_000, 60):
        monkeypatch.setattr(forest, "LOCAL", local)
        context.setJobGroup(f"forest-{local}", "")
        models = learn.fit_forest(df, "features", ["y"], trees=5, key=["k"])
        context.setLocalProperty("spark.jobGroup.id", None)
        got.append(learn.apply_models(df, models).orderBy("k").toPandas())
    # a job for every level of the trees took over 30
    assert len(context.statusTracker().getJobIdsForGroup("forest-50000")) < 15
    assert len(models["y"].top) > 1 and (got[0]["y_pred"] == got[1]["y_pred"]).all()
    assert ((got[0]["y_pred"] - got[0]["y"]) ** 2).mean() < got[0]["y"].var() / 4


def test_forest_of_rows_that_fit_shuffles_no_bags(spark, monkeypatch):
    monkeypatch.setattr(forest, "_bags", None)  # a row for each tree that has it
    monkeypatch.setattr(forest, "_fallen", None)
    rows = spark.range(300).select(F.col("id").alias("k"), F.expr("id * 7 % 31").cast("double").alias("x"))
    df = learn.assemble(rows.withColumn("y", F.col("x") * F.col("x")), ["x"])
    got = learn.apply_models(df, learn.fit_forest(df, "features", ["y"], trees=10, key=["k"])).toPandas()
    assert len(got) == 300 and (got["y_pred"] - got["y"]).abs().mean() < 20


def test_forest_grows_alike_with_few_nodes_at_a_time_and_few_rows_a_node(monkeypatch):
    rng = np.random.default_rng(3)
    bins, w = rng.integers(0, 32, (3000, 4)).astype(np.int8), rng.integers(1, 4, 3000).astype(float)
    y = np.round(rng.normal(size=3000) * 4096) / 4096
    y[:500] = 0.5
    trees = []
    for nodes, few in ((1 << 20, 0), (2048, 12), (7, 12), (7, 0), (2048, 1 << 20)):
        monkeypatch.setattr(forest, "NODES", nodes)
        monkeypatch.setattr(forest, "FEW", few)
        trees.append(forest.grow(bins, y, w, 30))
    assert all(np.array_equal(a, b) for other in trees[1:] for a, b in zip(trees[0], other, strict=True))


def test_forest_grows_to_single_rows():
    y = np.array([3.0, 1.0, 2.0, 2.0])
    feature, cut, left, value = forest.grow(np.array([[0, 1], [1, 0], [2, 0], [2, 1]]), y, np.array([1.0, 2.0, 1.0, 1.0]), 30)
    assert value[0] == 1.8 and sorted(value[feature < 0]) == [1.0, 2.0, 3.0]
    assert (feature[left[feature >= 0]] >= -1).all() and forest.thresholds(np.array([1.0, 3.0, 3.0])) == [2.0]


def test_value_summary_equals_numpy(spark):
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=500), 1) * 10
    rows = [("a", float(v)) for v in x] + [("a", None), ("a", float("nan")), ("a", float("-inf")), ("b", None), (None, -2.0)]
    got = {r["g"]: r for r in aggregates.value_summary(spark.createDataFrame(rows, "g string, x double"), "x", ["g"], {"a": (-5, 5)}).collect()}
    a = got["a"]
    assert (a["n"], a["nan_count"], a["inf_count"]) == (503, 2, 1)
    want = [x.mean(), x.std(), x.min(), x.max(), np.abs(x).max(), np.quantile(x, 0.05), np.quantile(np.abs(x), 0.99), (x < -5).mean(), (x > 5).mean()]
    np.testing.assert_allclose([a[c] for c in ("mean", "std", "min", "max", "abs_max", "p05", "abs_p99", "frac_below", "frac_above")], want, atol=1e-9)
    assert (got["b"]["n"], got["b"]["nan_count"], got["b"]["mean"], got["b"]["p50"]) == (1, 1, None, None)
    assert (got[None]["p50"], got[None]["abs_p99"], got[None]["frac_below"]) == (-2.0, 2.0, None)
    whole = aggregates.value_summary(spark.createDataFrame([], "x double"), "x", [])
    assert [r["n"] for r in whole.collect()] == [0]


def test_describe_of_constants_and_unknowns(spark):
    df = spark.createDataFrame([(1.0, None, 2.0), (2.0, None, None), (4.0, None, None)], "p double, q double, r double")
    got = {r["name"]: r for r in aggregates.describe(df, ["p", "q", "r"]).collect()}
    assert got["p"]["std"] == pytest.approx(np.std([1, 2, 4], ddof=1)) and got["p"]["q25"] == 1.5
    assert (got["q"]["n"], got["q"]["mean"], got["r"]["n"], got["r"]["std"], got["r"]["q75"]) == (0, None, 1, None, 2.0)


def test_value_summary_reads_its_input_once(spark, tmp_path):
    spark.range(100).selectExpr("id % 3 AS g", "id * 1.0 AS x").write.parquet(str(tmp_path / "t"))
    plan = aggregates.value_summary(spark.read.parquet(str(tmp_path / "t")), "x", ["g"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_blend_and_ensemble_refuse_unequal_keys(spark):
    a = spark.createDataFrame([("u", 1.0), ("w", 2.0)], "user_id string, p double")
    b = spark.createDataFrame([("u", 3.0), ("w", 4.0)], "user_id string, p double")
    assert column(baselines.blend(a, b, {"p": 0.25}, "user_id"), "p", "user_id") == {"u": 2.5, "w": 3.5}
    with pytest.raises(ValueError, match="key sets differ"):
        baselines.blend(a, b.where("user_id = 'u'"), {"p": 0.5}, "user_id")
    with pytest.raises(ValueError, match="weight"):
        baselines.blend(a, b, {"p": 1.5}, "user_id")
    with pytest.raises(Exception, match="key sets differ"):
        baselines.ensemble([a, b.where("user_id = 'u'")], ["user_id"], ["p"]).collect()


def test_too_few_rows_for_a_one_lag_fit(small):
    rows = windows.lagged_delta(windows.timeline(small, R), R).result()
    with pytest.raises(Exception, match="too few rows"):
        baselines.fit_one_lag(rows, R).collect()
    assert baselines.fit_one_lag(rows, R, min_rows=2).count() == 2


def test_submission_checks(spark):
    p = spark.createDataFrame([(2, 1.0), (1, float("nan"))], "u long, p double")
    with pytest.raises(Exception, match="not finite"):
        baselines.submission(p, ["u"], {"p": "pred"}).collect()
    good = p.where("u = 2")
    assert baselines.submission(good, ["u"], {"p": "pred"}, good).columns == ["u", "pred"]


def test_batches_are_scored_and_reused(spark):
    df = spark.createDataFrame([(1, "ab"), (2, "abc")], "k long, text string")

    def load():
        return lambda batch: pd.DataFrame({"k": batch["k"], "score": batch["text"].str.len().astype(float)})

    def fresh(d):
        return scoring.score_batches(d, load, ["k", "text"], "k long, score double")

    assert column(fresh(df), "score", "k") == {1: 2.0, 2: 3.0}
    stored = spark.createDataFrame([(1, 9.0), (2, 9.0)], "k long, score double")
    assert column(scoring.reuse_or_score(df, stored, ["k"], fresh), "score", "k") == {1: 9.0, 2: 9.0}
    assert column(scoring.reuse_or_score(df, stored.where("k = 1"), ["k"], fresh), "score", "k") == {1: 2.0, 2: 3.0}


# --- sources and sinks ----------------------------------------------------------------


def test_csv_is_typed_and_bad_values_fail(spark, tmp_path):
    path = tmp_path / "users.csv"
    path.write_text("user_id,disposition_change_valence,disposition_change_arousal\n1,0.5,NaN\n2,,1\n")
    df = tables.load_tables(spark, {"users": str(path)})["users"]
    assert [tuple(r) for r in df.orderBy("user_id").collect()] == [(1, 0.5, None), (2, None, 1.0)]
    path.write_text("user_id,disposition_change_valence,disposition_change_arousal\nx,0.5,1\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        tables.load_tables(spark, {"users": str(path)})["users"].collect()
    with pytest.raises(ValueError, match="missing columns"):
        tables.normalise(df, tables.SCHEMAS["entries"], "entries")


def test_missing_tables_are_listed(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="nowhere"):
        tables.load_tables(spark, {"users": str(tmp_path / "nowhere.csv")})
    spark.range(3).write.parquet(str(tmp_path / "raw"))
    assert tables.first_available(spark, str(tmp_path / "processed"), str(tmp_path / "raw")).count() == 3


def test_sinks_refuse_to_overwrite(spark, tmp_path):
    df = spark.range(3)
    for write in (sinks.write_csv, sinks.write_parquet):
        path = str(tmp_path / write.__name__)
        write(df, path)
        with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
            write(df, path)
        write(df, path, overwrite=True)


def test_log_is_appended(spark, tmp_path):
    path = str(tmp_path / "log")
    assert sinks.read_log(spark, path).count() == 0
    row = spark.createDataFrame([(0.5, "all")], "mae_valence double, slice string")
    for run in ("r1", "r2"):
        sinks.append_log(row, path, run_id=run, task="levels", seed=42)
    log = sinks.read_log(spark, path)
    assert log.count() == 2 and len(log.columns) == 28
    found = audits.log_audit(log, log.columns, "levels", "r2", 42)
    assert audits.passed(found).first()["ok"]
    assert not audits.passed(audits.log_audit(log, log.columns, "levels", "r3", 42)).first()["ok"]


def test_vector_store_round_trip(spark, tmp_path):
    np.savez(tmp_path / "store.npz", embeddings=np.arange(6, dtype="float32").reshape(3, 2), user_id=np.array([1, 1, 2]), text_id=np.array([5, 6, 7]))
    rows = vectors.import_npz(spark, str(tmp_path / "store.npz"), ["user_id", "text_id"])
    vectors.save_vectors(rows, str(tmp_path / "store"), ["user_id", "text_id"], "vec")
    back = vectors.load_vectors(spark, str(tmp_path / "store"), ["user_id", "text_id"], "vec")
    assert column(back, "vec") == {5: [0.0, 1.0], 6: [2.0, 3.0], 7: [4.0, 5.0]}
    uneven = back.withColumn("vec", F.slice("vec", 1, F.when(F.col("text_id") == 5, 1).otherwise(2)))
    with pytest.raises(ValueError, match="uneven"):
        vectors.dimension(uneven, "vec")


def test_row_wise_columns_work_on_streams(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a b", True), (2, "c", False)], "id long, text string, flag boolean")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = tx.short_text_features(stream).writeStream.format("memory").queryName("short_text").start()
    query.processAllAvailable()
    query.stop()
    assert column(spark.table("short_text"), "n_tokens", "id") == {1: 2, 2: 1}
