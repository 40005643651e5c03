"""Row filters and cell masks.

All are narrow transformations (no shuffle); the ones that need a scalar
(first week, audit) compute it with one aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sinter.functions.metrics import ape


def drop_any_null(df: DataFrame, subset=None) -> DataFrame:
    """drop rows with a null in any (or the given) column."""
    return df.na.drop(how="any", subset=list(subset) if subset else None)


def month_between(df: DataFrame, ts: str, first: int, last: int) -> DataFrame:
    """month of year in [first, last], any year.

    ``month(ts)`` is not a pushable parquet predicate; tables written by
    ``sinks.write_labelled`` are partitioned by month so this prunes there.
    """
    m = F.month(F.col(ts))
    return df.filter(m.between(first, last))


def threshold_rows(df: DataFrame, rules: dict[str, float]) -> DataFrame:
    """a row is blanked (dropped) when any rule column <= its threshold.

    A null in a rule column also drops the row, like the reference's mask
    followed by ``dropna``.
    """
    cond = None
    for c, t in rules.items():
        part = F.col(c) > F.lit(t)
        cond = part if cond is None else cond & part
    return df.filter(cond) if cond is not None else df


def mask_non_positive(df: DataFrame, cols) -> DataFrame:
    """cells <= 0 become null."""
    return df.withColumns({c: F.when(F.col(c) > 0, F.col(c)) for c in cols})


def complete_case_audit(df: DataFrame, target: str, features) -> DataFrame:
    """counts of each step of the complete-case filter, one pass."""
    has_y = F.col(target).isNotNull()
    any_x_null = None
    for c in features:
        part = F.col(c).isNull()
        any_x_null = part if any_x_null is None else any_x_null | part
    return df.agg(
        F.count(F.lit(1)).alias("blocks"),
        F.count_if(has_y).alias("with_target"),
        F.count_if(~has_y).alias("without_target"),
        F.count_if(has_y & any_x_null).alias("dropped_null_sensor"),
        F.count_if(has_y & ~any_x_null).alias("kept"),
    )


def complete_cases(df: DataFrame, target: str, features) -> DataFrame:
    """rows with the target and every feature present."""
    return df.na.drop(how="any", subset=[target, *features])


def ape_below(df: DataFrame, threshold: float | None, y: str = "actual",
              p: str = "predicted") -> DataFrame:
    """optional filter on the per-row percentage error."""
    if threshold is None:
        return df
    return df.filter(ape(y, p) < F.lit(threshold))


def first_week(df: DataFrame, ts: str, days: int = 7) -> DataFrame:
    """F8: rows in [min(ts), min(ts) + days).

    The minimum is one scalar action; the slice is then a literal range
    filter, which reaches the parquet scan as a pushed predicate.
    """
    start = df.agg(F.min(ts)).first()[0]
    if start is None:
        return df.limit(0)
    lo = F.lit(start).cast(df.schema[ts].dataType)
    return df.filter((F.col(ts) >= lo) & (F.col(ts) < lo + F.expr(f"INTERVAL {int(days)} DAYS")))


def date_slice(df: DataFrame, ts: str, start: str, end: str) -> DataFrame:
    """start day 00:00 up to the whole end day included (pushable)."""
    kind = df.schema[ts].dataType
    lo = F.lit(start).cast(kind)
    hi = F.lit(end).cast(kind) + F.expr("INTERVAL 1 DAY")
    return df.filter((F.col(ts) >= lo) & (F.col(ts) < hi))
