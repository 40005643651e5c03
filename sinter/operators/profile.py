"""Grouped profiles and result tables.

``profile`` is one ``groupBy(...).agg(...)``: count / avg / stddev_samp are
partially aggregated map-side; exact medians come from
``quantiles.exact_medians``, all columns in the same passes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from sinter.functions.clean import round_half_even
from sinter.operators.schema import numeric_columns

STATS = ("count", "mean", "std", "median")


def profile(df: DataFrame, by: str = "cluster", cols=None, digits: int | None = 3,
            stats=STATS) -> DataFrame:
    """A1: count, mean, sample std and median of every numeric column per
    group, flat names ``<col>_<stat>``, rounded half-even to ``digits``.

    count / mean / std are partial aggregates; medians are selected over the
    wide columns, so no group's values are gathered in one task. Rows
    with a null group key are left out, as pandas ``groupby`` does."""
    from sinter.operators.quantiles import exact_medians
    cols = [c for c in (cols or numeric_columns(df)) if c != by]
    df = df.filter(F.col(by).isNotNull())

    def rnd(x):
        return round_half_even(x, digits) if digits is not None else x

    unknown = set(stats) - set(STATS)
    if unknown:
        raise ValueError(f"unknown statistics {sorted(unknown)}")

    def moments(c):
        made = {"count": F.count(c), "mean": F.avg(c), "std": F.stddev_samp(c)}
        return {k: made[k] for k in stats if k != "median"}

    if "median" in stats and cols:
        # the moments share the medians' first pass
        out = exact_medians(df, [by], cols, moments).withColumnsRenamed({c: f"{c}_median" for c in cols})
    else:
        out = df.groupBy(by).agg(*[a.alias(f"{c}_{k}") for c in cols for k, a in moments(c).items()])
    out = out.withColumns({f"{c}_{k}": rnd(F.col(f"{c}_{k}")) for c in cols for k in stats if k != "count"})
    order = [by] + [f"{c}_{s}" for c in cols for s in stats]
    return out.select(*order)


def period_stats(df: DataFrame, ts: str) -> DataFrame:
    """A2: rows and first / last date of a period."""
    return df.agg(F.count(F.lit(1)).alias("rows"),
                  F.to_date(F.min(ts)).alias("first_day"),
                  F.to_date(F.max(ts)).alias("last_day"))


def cluster_count(df: DataFrame, label: str = "cluster", by=()) -> DataFrame:
    """Number of clusters, noise (-1) excluded."""
    expr = F.count_distinct(F.when(F.col(label) != -1, F.col(label))).alias("n_clusters")
    return df.groupBy(*by).agg(expr) if by else df.agg(expr)


def distinct_models(df: DataFrame, model: str = "model") -> DataFrame:
    """A10: the distinct model list."""
    return df.select(model).distinct()


def rank_results(df: DataFrame, by=("model",), metric: str = "mape", tie_break=()) -> DataFrame:
    """Rank rows by metric inside each ``by`` group (1 = best), equal
    ones by ``tie_break``; without ``by``, over all results. The results
    table has one row per (model, dataset), so one group of it is small.
    """
    order = [F.col(metric).asc_nulls_last(), *tie_break]
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*(by or [F.lit(0)])).orderBy(*order)))


def block_medians(df: DataFrame, ts: str, key: str, value, every: str = "1 day",
                  keys=None, suffix: str = "") -> DataFrame:
    """Tumbling time blocks, one exact median column per key value
    (``<key><suffix>``); blocks without a value for a key are null."""
    from sinter.operators.quantiles import exact_median
    v = F.col(value) if isinstance(value, str) else value
    long = df.select(F.window(ts, every).start.cast("timestamp_ntz").alias("_blk"),
                     F.col(key).alias("_key"), v.alias("_v"))
    med = exact_median(long, ["_blk", "_key"], "_v")
    blocks = long.select("_blk").distinct()
    wide = med.groupBy("_blk").pivot("_key", list(keys) if keys else None).agg(F.first("median"))
    out = blocks.join(wide, "_blk", "left")
    names = list(keys) if keys else [c for c in wide.columns if c != "_blk"]
    return out.select(F.col("_blk").alias(ts), *[F.col(k).alias(f"{k}{suffix}") for k in names])
