"""Prediction evaluation: global and per-bin metrics, series views
(A3-A8, A10, E1-E8, M12, M13).

Binning: the edges are ``linspace(min, max, bins)`` of the actual values
over all models (one scalar aggregate, then a literal array on the driver;
bins - 1 right-closed intervals, the global minimum falls in no bin). The
midpoint of an interval is computed from its edges rounded the way pandas
rounds interval labels (precision 3, raised until labels are distinct).
Per-(model, bin) metrics are then one grouped aggregate.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, functions as F

from sinter.functions import metrics as M
from sinter.functions.clean import col_
from sinter.operators.filters import ape_below


def metrics_table(df: DataFrame, by=("model",), y: str = "actual", p: str = "predicted",
                  lower: str | None = "lower", upper: str | None = "upper",
                  ape_threshold: float | None = None) -> DataFrame:
    """Global metrics per group, optionally after the F7 filter."""
    d = ape_below(df, ape_threshold, y, p)
    aggs = [F.count(F.lit(1)).alias("n"),
            M.mse(y, p).alias("mse"), M.rmse(y, p).alias("rmse"), M.mae(y, p).alias("mae"),
            M.r2(y, p).alias("r2"), M.mape_pct(y, p).alias("mape_pct"),
            M.mape_eps(y, p).alias("mape_eps")]
    if lower and upper and lower in df.columns and upper in df.columns:
        aggs.append(M.coverage(y, lower, upper).alias("coverage"))
    return d.groupBy(*by).agg(*aggs)


def filter_counts(df: DataFrame, ape_threshold: float, by=("model",), y: str = "actual",
                  p: str = "predicted") -> DataFrame:
    """Kept and dropped rows of the F7 filter (it hides the worst rows)."""
    keep = M.ape(y, p) < F.lit(ape_threshold)
    return df.groupBy(*by).agg(F.count_if(keep).alias("kept"),
                               F.count_if(~keep | keep.isNull()).alias("dropped"))


def value_range(df: DataFrame, col: str = "actual"):
    """A3: global (min, max) of a column - one scalar aggregate."""
    r = df.agg(F.min(col).alias("lo"), F.max(col).alias("hi")).first()
    return r["lo"], r["hi"]


def linspace_edges(lo: float, hi: float, bins: int) -> list[float]:
    """A4: ``bins`` equally spaced edges, last edge exactly ``hi``."""
    return [float(v) for v in np.linspace(lo, hi, bins)]


def _round_frac(x: float, precision: int) -> float:
    if not math.isfinite(x) or x == 0:
        return x
    frac, whole = math.modf(x)
    digits = (-int(math.floor(math.log10(abs(frac)))) - 1 + precision) if whole == 0 else precision
    return float(np.around(x, digits))


def label_edges(edges, precision: int = 3) -> list[float]:
    """Interval-label edges (pandas rule: round to ``precision``, more
    digits while two labels collide)."""
    for prec in range(precision, 20):
        levels = [_round_frac(e, prec) for e in edges]
        if len(set(levels)) == len(edges):
            return levels
    return [_round_frac(e, precision) for e in edges]


def assign_bins(df: DataFrame, edges, col: str = "actual", precision: int = 3) -> DataFrame:
    """Right-closed bin index (1..bins-1) and label midpoint; rows
    equal to the first edge (or outside) fall in no bin and are dropped."""
    labels = label_edges(edges, precision)
    mids = [0.5 * (labels[i] + labels[i + 1]) for i in range(len(edges) - 1)]
    e = F.array(*[F.lit(v) for v in edges])
    m = F.array(*[F.lit(v) for v in mids])
    idx = F.size(F.filter(e, lambda b: b < col_(col)))
    x = df.withColumn("bin_idx", idx)
    x = x.filter((F.col("bin_idx") >= 1) & (F.col("bin_idx") <= len(edges) - 1))
    return x.withColumn("bin_mid", F.element_at(m, F.col("bin_idx")))


def binned_metrics(df: DataFrame, bins: int = 10, by=("model",), y: str = "actual",
                   p: str = "predicted", min_rows: int = 2,
                   ape_threshold: float | None = None) -> DataFrame:
    """Metrics per (model, bin); bins with fewer than ``min_rows`` rows
    are left out (count them with ``skipped_bins``)."""
    d = ape_below(df, ape_threshold, y, p)
    lo, hi = value_range(d, y)
    if lo is None or lo == hi:  # nothing to bin: an empty frame of the same schema
        b = d.limit(0).withColumn("bin_mid", F.lit(0.0))
    else:
        b = assign_bins(d, linspace_edges(lo, hi, bins), y)
    g = b.groupBy(*by, "bin_mid").agg(
        F.count(F.lit(1)).alias("n"), M.r2(y, p).alias("r2"), M.mape_pct(y, p).alias("mape_pct"),
        M.rmse(y, p).alias("rmse"), M.mae(y, p).alias("mae"))
    return g.filter(F.col("n") >= min_rows)


def skipped_bins(df: DataFrame, bins: int = 10, by=("model",), y: str = "actual",
                 min_rows: int = 2) -> int:
    """How many (model, bin) groups have fewer than ``min_rows`` rows."""
    lo, hi = value_range(df, y)
    if lo is None or lo == hi:
        return 0
    b = assign_bins(df, linspace_edges(lo, hi, bins), y)
    return b.groupBy(*by, "bin_mid").count().filter(F.col("count") < min_rows).count()


def actual_vs_predicted(df: DataFrame, ts: str = "ts", y: str = "actual",
                        p: str = "predicted", model: str | None = None) -> DataFrame:
    """The series behind an actual-vs-predicted chart (order at the
    sink), of one model or of all with the model's name."""
    return df.filter(F.col("model") == model).select(ts, y, p) if model else df.select("model", ts, y, p)


def side_by_side(df: DataFrame, models, ts: str = "ts", value: str = "predicted",
                 every: str = "day", start: str | None = None, end: str | None = None) -> DataFrame:
    """Several models' predictions as columns per time bucket (mean
    within the bucket), optionally inside a date range (F9)."""
    from sinter.operators.filters import date_slice
    d = date_slice(df, ts, start, end) if start and end else df
    return (d.groupBy(F.date_trunc(every, ts).cast("timestamp_ntz").alias(ts))
            .pivot("model", list(models)).agg(F.avg(value)))


def side_by_side_rows(df: DataFrame, models, index=("ts",), y: str = "actual",
                      values=("predicted", "lower", "upper"), start: str | None = None,
                      end: str | None = None) -> DataFrame:
    """M13 row by row: for each ``index`` the actual value and every model's
    prediction and interval (``<value>_<model>``, null where a model has no
    row), optionally inside a date range (F9)."""
    from sinter.operators.filters import date_slice
    d = date_slice(df, index[0], start, end) if start and end else df
    return d.groupBy(*index).agg(F.max(y).alias(y), *[
        F.max(F.when(F.col("model") == m, F.col(v))).alias(f"{v}_{m}") for m in models for v in values])
