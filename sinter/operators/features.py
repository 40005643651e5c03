"""Feature preparation fitted on one split and applied to all rows (M1-M3).

Each ``fit_*`` is one aggregate over the training rows that returns a
small driver-side state (one number per column or one entry per level);
each ``apply_*`` is a narrow projection, so fit-on-train / apply-to-all
costs one pass plus one projection, with no join.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import Imputer, OneHotEncoder, StringIndexer
from pyspark.sql import Column, DataFrame, functions as F


def _train_rows(df: DataFrame, where: Column | None) -> DataFrame:
    return df.filter(where) if where is not None else df


def fit_standardiser(df: DataFrame, cols, where: Column | None = None) -> dict[str, tuple]:
    """M1: mean and population std per column on the training rows (nulls
    ignored, like the reference scaler's NaN handling)."""
    cols = list(cols)
    r = _train_rows(df, where).agg(
        *[F.avg(c).alias(f"m_{c}") for c in cols],
        *[F.stddev_pop(c).alias(f"s_{c}") for c in cols]).first()
    return {c: (r[f"m_{c}"], r[f"s_{c}"]) for c in cols}


def apply_standardiser(df: DataFrame, stats: dict[str, tuple], suffix: str = "") -> DataFrame:
    """M1: (x - mean) / std; a zero std divides by 1 (constant column -> 0)."""
    out = {}
    for c, (m, s) in stats.items():
        scale = 1.0 if (s is None or s == 0) else float(s)
        mean = 0.0 if m is None else float(m)
        out[f"{c}{suffix}"] = (F.col(c) - F.lit(mean)) / F.lit(scale)
    return df.withColumns(out)


def fit_means(df: DataFrame, cols, where: Column | None = None) -> dict[str, float]:
    """M2: column means on the training rows (all-null columns refused)."""
    cols = list(cols)
    r = _train_rows(df, where).agg(*[F.avg(c).alias(c) for c in cols]).first()
    empty = [c for c in cols if r[c] is None]
    if empty:
        raise ValueError(f"no training values in {empty}; drop all-null columns first")
    return {c: float(r[c]) for c in cols}


def apply_means(df: DataFrame, means: dict[str, float]) -> DataFrame:
    """M2: null (or NaN) -> the training mean."""
    return df.withColumns({c: F.coalesce(F.nanvl(F.col(c), F.lit(None).cast("double")),
                                         F.lit(m)) for c, m in means.items()})


def imputer(cols, out_cols=None) -> Imputer:
    """M2 as a Spark ML stage (mean strategy)."""
    cols = list(cols)
    return Imputer(strategy="mean", inputCols=cols, outputCols=list(out_cols or cols))


def fit_levels(df: DataFrame, col: str = "cluster", where: Column | None = None) -> list:
    """M3: the sorted distinct levels seen in training (regimes: a handful)."""
    rows = _train_rows(df, where).select(col).distinct().orderBy(col).collect()
    return [r[0] for r in rows if r[0] is not None]


def apply_one_hot(df: DataFrame, levels, col: str = "cluster", prefix: str | None = None) -> DataFrame:
    """M3: one 0/1 column per training level; an unseen level is all zeros."""
    prefix = prefix or col
    return df.withColumns({f"{prefix}_{v}": (F.col(col) == F.lit(v)).cast("double") for v in levels})


def one_hot_stages(col: str = "cluster", out: str = "cluster_vec"):
    """M3 as Spark ML stages: the index reserved for unseen labels is the
    one ``dropLast`` removes, so an unseen cluster encodes as all zeros
    (a direct ``OneHotEncoder`` would reject the -1 noise label)."""
    idx = StringIndexer(inputCol=col, outputCol=f"{col}_idx", handleInvalid="keep",
                        stringOrderType="alphabetAsc")
    ohe = OneHotEncoder(inputCols=[f"{col}_idx"], outputCols=[out], dropLast=True)
    return [idx, ohe]


def one_hot_pipeline(col: str = "cluster", out: str = "cluster_vec") -> Pipeline:
    return Pipeline(stages=one_hot_stages(col, out))
