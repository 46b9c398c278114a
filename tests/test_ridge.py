"""Ridge models of moments and of sparse texts against closed forms."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.functions.terms import term_counts, tfidf_weights, top_terms, with_term_counts
from tideline.operators import moment_ridge, text_ridge


def terms_of(text):
    w = re.findall(r"\w{2,}", (text or "").lower())
    return Counter(w) + Counter(" ".join(p) for p in zip(w, w[1:]))


def closed_form(x, y, alpha=1.0):
    """Weights and intercept of |y - xw - b|^2 + alpha |w|^2."""
    mx, my = x.mean(0), y.mean()
    w = np.linalg.solve((x - mx).T @ (x - mx) + alpha * np.eye(x.shape[1]), (x - mx).T @ (y - my))
    return w, my - mx @ w


def texts(n, seed):
    rng = np.random.default_rng(seed)
    words = [f"word{i}" for i in range(30)]
    rows = []
    for i in range(n):
        text = None if i == 3 else "" if i == 4 else " ".join(rng.choice(words, rng.integers(1, 25)))
        fold = None if i == 5 else -1 if i == 6 else int(rng.integers(0, 3))
        rows.append((i, fold, text, float(rng.normal()), float(rng.normal() * 50), float(rng.normal() + i % 2), float(i % 3)))
    return rows


def expected(rows, folds, numeric, size, min_df):
    """Held-out predictions by dense matrices: id -> two numbers, and the size of each vocabulary."""
    out, sizes = {}, []
    counts = [terms_of(r[2]) for r in rows]
    for k in range(folds):
        train = [i for i, r in enumerate(rows) if r[1] != k]
        tf, df = Counter(), Counter()
        for i in train:
            tf.update(counts[i])
            df.update(set(counts[i]))
        chosen = sorted((t for t in df if df[t] >= min_df), key=lambda t: (-tf[t], t))[:size]
        sizes.append(len(chosen))
        weight = np.array([np.log((1 + len(train)) / (1 + df[t])) + 1 for t in chosen])
        x = np.array([[c[t] for t in chosen] for c in counts]) * weight
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        x = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
        if numeric:
            x = np.hstack([x, np.array([[r[3], r[4]] for r in rows])])
        for t in (5, 6):
            w, b = closed_form(x[train], np.array([rows[i][t] for i in train]))
            for i, r in enumerate(rows):
                if r[1] == k:
                    out.setdefault(r[0], []).append(x[i] @ w + b)
    return out, sizes


@pytest.mark.parametrize("numeric,size,min_df", [(False, 1000, 1), (False, 40, 2), (True, 1000, 2)])
def test_text_ridge_equals_the_closed_form(spark, numeric, size, min_df):
    rows = texts(60, 3)
    df = spark.createDataFrame(rows, "id int, fold int, text string, p double, q double, y double, z double").repartition(3)
    scored, models = text_ridge.cross_fitted(df, "fold", 3, ["y", "z"], numeric=["p", "q"] if numeric else None, size=size, min_df=min_df)
    got = {r["id"]: (r["y_pred"], r["z_pred"]) for r in scored.collect()}
    want, sizes = expected(rows, 3, numeric, size, min_df)
    assert set(got) == set(want)
    assert max(abs(a - b) for i in got for a, b in zip(got[i], want[i], strict=True)) < 1e-6
    found = {(r["fold"], r["target"]): r for r in models.collect()}
    assert [found[k, "y"]["n_terms"] for k in range(3)] == sizes
    assert all(r["gradient"] <= text_ridge.GRADIENT for r in found.values())
    assert [found[k, "z"]["n_train"] for k in range(3)] == [sum(r[1] != k for r in rows) for k in range(3)]


def test_the_solve_takes_few_passes_and_keeps_its_terms_for_later_predictions(spark, monkeypatch):
    seen = {"passes": 0, "freed": 0}
    rng = np.random.default_rng(5)
    words = [f"word{i}" for i in range(60)]
    rows = [(i, i % 3, " ".join(rng.choice(words, 30)), float(rng.normal()), float(i % 7) * 100) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, fold int, text string, y double, p double")
    solve = text_ridge.Solve(df, "fold", 3, ["y"], "text", ["p"], 400, 2, 1.0)
    product = text_ridge.Solve.product
    monkeypatch.setattr(text_ridge.Solve, "product", lambda self, v: seen.update(passes=seen["passes"] + 1) or product(self, v))
    monkeypatch.setattr(type(solve.shared), "unpersist", lambda self, blocking=False: seen.update(freed=seen["freed"] + (self is solve.shared)))
    solve.solve()
    solve.close()
    # all columns are in the preconditioner, which differs from a model's matrix by the rows of its fold alone
    assert seen["passes"] <= 20
    assert seen["freed"] == 0
    assert solve.predictions().where(F.col("y_pred").isNotNull()).count() == len(rows)


def test_many_alike_columns_take_few_passes(spark, monkeypatch):
    passes = []
    product = text_ridge.Solve.product
    monkeypatch.setattr(text_ridge.Solve, "product", lambda self, v: passes.append(1) or product(self, v))
    rng = np.random.default_rng(11)
    phrases = [" ".join(f"w{i}x{j}" for j in range(12)) for i in range(80)]
    rows = [(i, i % 3, " ".join(phrases[p] for p in rng.integers(0, 80, 4)), float(rng.normal())) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, fold int, text string, y double")
    scored, models = text_ridge.cross_fitted(df, "fold", 3, ["y"])
    assert models.agg(F.max("gradient")).first()[0] <= text_ridge.GRADIENT
    assert len(passes) <= 25


def test_vocabularies_are_whole_however_few_terms_are_counted_per_fold(spark, monkeypatch):
    rows = texts(60, 3)
    df = spark.createDataFrame(rows, "id int, fold int, text string, p double, q double, y double, z double").repartition(3)
    want, sizes = expected(rows, 3, False, 40, 2)
    found, every = [], text_ridge.term_space
    monkeypatch.setattr(text_ridge, "term_space", lambda *given: found.append(1) or every(*given))
    for candidates in (1, 100):
        monkeypatch.setattr(text_ridge, "CANDIDATES", candidates)
        scored, models = text_ridge.cross_fitted(df, "fold", 3, ["y", "z"], size=40, min_df=2)
        assert all(abs(r["y_pred"] - want[r["id"]][0]) < 1e-6 for r in scored.collect())
        assert [r["n_terms"] for r in models.where("target = 'y'").orderBy("fold").collect()] == sizes
    assert len(found) == 1  # terms beyond the 40 most frequent could be in a vocabulary, those beyond 4,000 not


def test_a_fold_without_rows_to_fit_on_is_an_error(spark):
    df = spark.createDataFrame([(0, "some words", 1.0), (0, "more words", 2.0)], "fold int, text string, y double")
    with pytest.raises(ValueError, match="no rows"):
        text_ridge.cross_fitted(df, "fold", 1, ["y"])
    with pytest.raises(Exception, match="no rows"):
        moment_ridge.cross_fitted(df, "fold", 1, F.array(F.length("text")), 1, ["y"]).collect()


def test_moment_ridge_equals_the_closed_form(spark):
    rng = np.random.default_rng(1)
    n, d = 120, 6
    x, fold = rng.normal(size=(n, d)) * 5 + 3, rng.integers(-1, 4, n)
    y = x @ rng.normal(size=(d, 2)) + rng.normal(size=(n, 2))
    rows = [(i, None if fold[i] < 0 else int(fold[i]), x[i].tolist(), *y[i].tolist()) for i in range(n)]
    df = spark.createDataFrame(rows, "id int, fold int, x array<double>, y double, z double").repartition(5)
    models = {"all": list(range(d)), "some": [4, 1], "mean": []}
    long = moment_ridge.predictions(df, "fold", moment_ridge.leave_one_out(4), models, F.col("x"), d, ["y", "z"])
    got = {(r["model"], r["id"]): (r["y_pred"], r["z_pred"]) for r in long.collect()}
    assert len(got) == 3 * (fold >= 0).sum()
    for name, use in models.items():
        for k in range(4):
            train = fold != k
            for t in range(2):
                w, b = closed_form(x[train][:, use], y[train, t]) if use else (np.zeros(0), y[train, t].mean())
                for i in np.flatnonzero(fold == k):
                    assert abs(got[name, i][t] - (x[i, use] @ w + b)) < 1e-9


@pytest.mark.parametrize("bad", [None, float("nan"), float("inf")])
def test_moments_refuse_unknown_numbers(spark, bad):
    df = spark.createDataFrame([(0, [1.0, 2.0], 1.0), (1, [1.0, bad], 1.0)], "fold int, x array<double>, y double")
    with pytest.raises(Exception, match="null or not finite"):
        moment_ridge.fold_moments(df, "fold", F.col("x"), 2, ["y"]).collect()


def test_terms_are_counted_inside_rows(spark):
    rows = [(i, r[2]) for i, r in enumerate(texts(80, 8))] + [(100, "a bb bb bb a"), (101, "É éé. bb"), (101, "again again")]
    df = spark.createDataFrame(rows, "terms int, text string")
    found = with_term_counts(df.withColumnRenamed("terms", "row"), keep=True).collect()
    assert len(found) == len(rows)
    for r in found:
        assert dict(zip(r["terms"], r["times"], strict=True)) == dict(terms_of(r["text"]))


def test_weights_in_rows_have_unit_length(spark):
    rows = [(r[0], r[2]) for r in texts(50, 9)]
    df = spark.createDataFrame(rows, "id int, text string")
    vocabulary = top_terms(term_counts(df, "id"), 20, 2)
    got = {}
    for r in tfidf_weights(df, vocabulary, F.lit(len(rows)), "id").collect():
        got.setdefault(r["id"], {})[r["term"]] = r["weight"]
    df_of = {r["term"]: r["df"] for r in vocabulary.collect()}
    for i, text in rows:
        raw = {t: n * (np.log((1 + len(rows)) / (1 + df_of[t])) + 1) for t, n in terms_of(text).items() if t in df_of}
        norm = np.sqrt(sum(x * x for x in raw.values()))
        assert got.get(i, {}) == pytest.approx({t: x / norm for t, x in raw.items()})
