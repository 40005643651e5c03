"""Inductive conformal prediction (M9).

q_hat per group is the linear-interpolated quantile of the absolute
calibration residuals at level ceil((n + 1)(1 - alpha)) / n, a per-group
level column fed to ``quantiles.exact_quantiles`` (distributed selection:
no group's residuals are gathered in one task).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F


def conformal_level(n: int, alpha: float) -> float:
    level = math.ceil((n + 1) * (1 - alpha)) / n
    if level > 1:
        raise ValueError(
            f"calibration set of {n} rows is too small for alpha={alpha}: "
            f"level {level:.4f} > 1 (need n >= {math.ceil(1 / alpha) - 1})")
    return level


def q_hat(cal: DataFrame, by=("model",), y: str = "actual", p: str = "predicted",
          alpha: float = 0.05) -> DataFrame:
    """Per group: n_cal, level and q_hat from calibration rows."""
    from sinter.operators.quantiles import exact_quantiles
    by = list(by)
    lv = (cal.groupBy(*by).agg(F.count(F.lit(1)).alias("n_cal"))
          .withColumn("level", F.ceil((F.col("n_cal") + 1) * F.lit(1 - alpha)) / F.col("n_cal"))
          .checkpoint(eager=True))
    bad = lv.filter(F.col("level") > 1).limit(1).collect()
    if bad:
        n = bad[0]["n_cal"]
        raise ValueError(
            f"calibration set of {n} rows is too small for alpha={alpha}: level "
            f"{bad[0]['level']:.4f} > 1 (need n >= {math.ceil(1 / alpha) - 1})")
    if lv.isEmpty():
        raise ValueError("empty calibration set")
    resid = cal.select(*by, F.abs(F.col(y) - F.col(p)).alias("_res")).join(lv, by)
    q = exact_quantiles(resid, by, "_res", prob_col="level")
    return q.select(*by, F.col("n").alias("n_cal"), F.col("p").alias("level"),
                    F.col("q").alias("q_hat"))


def intervals(pred: DataFrame, qhat: DataFrame, by=("model",), p: str = "predicted") -> DataFrame:
    """predicted -/+ q_hat (one row per group; AQE broadcasts it at run
    time when it is under the size threshold, else it is a shuffle join)."""
    q = qhat.select(*by, "q_hat")
    return (pred.join(q, list(by), "left")
            .withColumns({"lower": F.col(p) - F.col("q_hat"), "upper": F.col(p) + F.col("q_hat")}))
