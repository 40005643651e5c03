"""Distributed exact quantiles equal numpy, with a hot group, duplicates,
a coarse sketch that forces several rounds, infinities and denormals."""
import numpy as np
import pandas as pd
import pytest

from sinter.operators import quantiles
from sinter.operators.quantiles import exact_median, exact_medians, exact_quantiles


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    n = 6000
    g = np.where(rng.random(n) < 0.6, "hot", rng.choice(["a", "b", "c"], n))
    v = np.round(rng.lognormal(0, 2, n), 3)
    v[rng.random(n) < 0.2] = 7.0                        # many duplicates
    v[:5] = [1e12, -1e9, 3.5, 3.5, 0.0]                 # extreme outliers
    pdf = pd.DataFrame({"g": g, "v": v})
    return pdf, spark.createDataFrame(pdf)


@pytest.mark.parametrize("accuracy", [200, 10_000])
def test_quantiles_match_numpy(spark, data, accuracy, monkeypatch):
    pdf, sdf = data
    monkeypatch.setattr(quantiles, "ACCURACY", accuracy)
    monkeypatch.setattr(quantiles, "GRID", 16 if accuracy == 200 else 256)
    probs = [0.0, 0.1, 0.5, 0.9573, 1.0]
    got = exact_quantiles(sdf, ["g"], "v", probs=probs).toPandas()
    for _, r in got.iterrows():
        exp = np.quantile(pdf.v[pdf.g == r.g], r.p)
        assert r.q == pytest.approx(exp, rel=1e-12, abs=1e-12), (r.g, r.p)


def test_global_median_and_per_group_levels(spark, data):
    pdf, sdf = data
    m = exact_median(sdf, [], "v").first()["median"]
    assert m == pytest.approx(np.median(pdf.v))
    from pyspark.sql import functions as F
    lv = sdf.withColumn("lvl", F.when(F.col("g") == "hot", 0.95).otherwise(0.25))
    got = exact_quantiles(lv, ["g"], "v", prob_col="lvl").toPandas()
    for _, r in got.iterrows():
        assert r.q == pytest.approx(np.quantile(pdf.v[pdf.g == r.g], r.p))


def test_odd_values(spark):
    inf, tiny = float("inf"), 5e-324
    rows = [("i", v) for v in (-inf, 1.0, 2.0, inf, inf, float("nan"), None)]
    rows += [("d", k * tiny) for k in range(9)] + [("w", v) for v in (-1.7e308, 1.7e308, 0.0, 1.0)]
    rows += [("one", 3.0), ("none", None), (None, 1.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r.median for r in exact_median(df, ["g"], "v").collect()}
    assert got == {"i": 2.0, "d": 4 * tiny, "w": 0.5, "one": 3.0}


def test_columns_stay_wide(spark, data):
    pdf, sdf = data
    two = sdf.selectExpr("g", "v", "-v AS w", "CASE WHEN g = 'a' THEN v END AS x")
    got = exact_medians(two, ["g"], ["v", "w", "x"])
    for r in got.collect():
        part = pdf.v[pdf.g == r.g]
        assert (r.v, r.w) == pytest.approx((np.median(part), -np.median(part)))
        assert (r.x is None) == (r.g != "a")
