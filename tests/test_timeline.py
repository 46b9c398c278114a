import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tideline.timeline import Lag, Next, Previous, RowsBefore, RowTotal, SumBefore, Timeline, Total


def frame(n=400, seed=0):
    """One entity with a third of the rows, many equal timestamps, null values."""
    rng = np.random.default_rng(seed)
    user = np.where(np.arange(n) % 3 == 0, 7, rng.integers(10, 40, n))
    pdf = pd.DataFrame({"u": user, "t": rng.integers(0, 25, n), "k": np.arange(n), "x": rng.normal(size=n)})
    pdf.loc[rng.random(n) < 0.4, "x"] = np.nan
    return pdf


def reference(pdf, alpha):
    pdf = pdf.sort_values(["u", "t", "k"])
    g = pdf.groupby("u")["x"]
    out = pdf[["u", "t", "k"]].copy()
    out["prev"] = g.transform(lambda s: s.ffill().shift(1))
    out["lag"] = g.shift(1)
    out["lead"] = g.shift(-1)
    out["before"] = g.transform(lambda s: s.fillna(0).cumsum().shift(1).fillna(0))
    out["pos"] = pdf.groupby("u").cumcount()
    out["n"] = pdf.groupby("u")["k"].transform("size")
    out["total"] = g.transform("sum")
    out["ema"] = g.transform(lambda s: s.ewm(alpha=alpha, adjust=False, ignore_na=True).mean().ffill().shift(1))
    tails = {}
    for _, group in pdf.groupby("u"):
        ks = list(group["k"])
        for i, k in enumerate(ks):
            tails[k] = ks[max(0, i - 2) : i + 1]
    out["tail"] = [tails[k] for k in out["k"]]
    return out.set_index("k").sort_index()


def run(spark, pdf, alpha):
    df = spark.createDataFrame(pdf).withColumn("x", F.when(F.isnan("x"), None).otherwise(F.col("x")))
    x = F.col("x")
    tl = Timeline(df, "u", ["t", "k"]).running(
        prev=Previous(x), lag=Lag(x), lead=Next(x), before=SumBefore(x), pos=RowsBefore(), n=RowTotal(), total=Total(x)
    )
    tl = tl.ema(alpha, x.isNotNull(), ema=x).tails("tail", F.col("k"), 3)
    return tl, tl.result().toPandas().set_index("k").sort_index()


def check(got, want):
    assert list(got.index) == list(want.index)
    for c in ["prev", "lag", "lead", "before", "pos", "n", "total", "ema"]:
        np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), atol=1e-12, err_msg=c)
    assert [list(v) for v in got["tail"]] == list(want["tail"])


@pytest.mark.parametrize("alpha", [0.3, 0.97])
def test_plain(spark, alpha):
    pdf = frame()
    tl, got = run(spark, pdf, alpha)
    assert not tl.chunked
    check(got, reference(pdf, alpha))


@pytest.mark.parametrize("alpha,seed", [(0.3, 1), (0.05, 2), (0.97, 3)])
def test_hot_entity_is_cut(spark, tiny_tasks, alpha, seed):
    pdf = frame(seed=seed)
    tl, got = run(spark, pdf, alpha)
    assert tl.chunked
    assert tl.df.where("u = 7").select("_chunk").distinct().count() > 2
    check(got, reference(pdf, alpha))


def test_hot_entity_with_one_timestamp(spark, tiny_tasks):
    pdf = frame(seed=4)
    pdf.loc[pdf["u"] == 7, "t"] = 3
    tl, got = run(spark, pdf, 0.3)
    assert tl.df.where("u = 7").select("_chunk").distinct().count() > 2
    check(got, reference(pdf, 0.3))


def test_long_history_has_no_drift(spark):
    n = 3000
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"u": 1, "t": np.arange(n), "k": np.arange(n), "x": rng.normal(size=n)})
    _, got = run(spark, pdf, 0.3)
    check(got, reference(pdf, 0.3))
