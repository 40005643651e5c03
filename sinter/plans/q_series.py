"""Queries: ordered series, splits, blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from sinter.functions import clean as C
from sinter.operators import filters as FL, sequence as SQ, split as SP
from sinter.plans import fixtures as FX, oracle as O
from sinter.plans.catalog import register

SENS = FX.SENSORS


def _ffbf_sql():
    cols = []
    for s in SENS:
        m = f"CASE WHEN {s} > 0 THEN {s} END"
        cols.append(
            f"coalesce(last_value({m} IGNORE NULLS) OVER (ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), "
            f"first_value({m} IGNORE NULLS) OVER (ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS {s}")
    return O.with_(O.HOURLY_ZEROS) + "SELECT ts, " + ", ".join(cols) + " FROM hourly"


@register("ffill_bfill", _ffbf_sql(), covers=("F5", "W1", "W2", "W3"))
def ffill_bfill(spark, sf_dir):
    h = FX.hourly_sensors(spark, sf_dir, plant_zeros=True)
    h = FL.mask_non_positive(h, SENS)
    return SQ.fill(h, ["ts"], forward=SENS, backward=SENS)


def _interp_sql(partition: str = ""):
    over_p = f"PARTITION BY {partition} " if partition else ""
    return O.with_(O.IRREGULAR) + f"""
, k AS (
  SELECT event_id, ts, event_type, value,
    last_value(CASE WHEN value IS NOT NULL THEN {{'t': ts, 'v': value}} END IGNORE NULLS)
      OVER ({over_p}ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p,
    first_value(CASE WHEN value IS NOT NULL THEN {{'t': ts, 'v': value}} END IGNORE NULLS)
      OVER ({over_p}ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n
  FROM series)
SELECT event_id, ts, event_type, round(CASE
    WHEN value IS NOT NULL THEN value
    WHEN p IS NULL THEN NULL
    WHEN n IS NULL THEN p.v
    WHEN epoch_us(n.t) = epoch_us(p.t) THEN p.v
    ELSE p.v + (n.v - p.v) * ((epoch_us(ts) - epoch_us(p.t))::DOUBLE / (epoch_us(n.t) - epoch_us(p.t))::DOUBLE)
  END, 6) AS value
FROM k"""


@register("interpolate_time", _interp_sql(), covers=("W4",))
def interpolate_time(spark, sf_dir):
    s = FX.irregular_series(spark, sf_dir)
    s = SQ.interpolate_time(s, "ts", ["ts", "event_id"], ["value"])
    return s.withColumn("value", C.round6("value"))


@register("interpolate_time_by_type", _interp_sql("event_type"), covers=("W4",))
def interpolate_time_by_type(spark, sf_dir):
    s = FX.irregular_series(spark, sf_dir)
    s = SQ.interpolate_time(s, "ts", ["ts", "event_id"], ["value"], key="event_type")
    return s.withColumn("value", C.round6("value"))


def _lag_sql(diff: bool, partition: str = ""):
    over_p = f"PARTITION BY {partition} " if partition else ""
    cols = []
    for k in (1, 2, 4):
        lag = f"lag(value, {k}) OVER ({over_p}ORDER BY ts, event_id)"
        cols.append(f"round(value - {lag}, 6) AS value_diff{k}" if diff else f"{lag} AS value_lag{k}")
    return O.with_(O.IRREGULAR) + "SELECT event_id, ts, event_type, value, " + ", ".join(cols) + " FROM series"


@register("lags_global", _lag_sql(False), covers=("W5",))
def lags_global(spark, sf_dir):
    s = FX.irregular_series(spark, sf_dir)
    return SQ.lag(s, ["ts", "event_id"], ["value"], steps=(1, 2, 4))


@register("diffs_by_type", _lag_sql(True, "event_type"), covers=("W6",))
def diffs_by_type(spark, sf_dir):
    s = FX.irregular_series(spark, sf_dir)
    d = SQ.lag(s, ["ts", "event_id"], ["value"], steps=(1, 2, 4), key="event_type", diff=True)
    return d.withColumns({f"value_diff{k}": C.round6(f"value_diff{k}") for k in (1, 2, 4)})


_SPLIT_SQL = O.with_(O.IRREGULAR) + """
, r AS (SELECT event_id, ts, row_number() OVER (ORDER BY ts, event_id) AS row_number,
               count(*) OVER () AS n FROM series),
s AS (SELECT *, n - CAST(ceil(0.2 * n) AS BIGINT) AS n_train FROM r)
SELECT event_id, ts, row_number,
  CASE WHEN row_number > n_train THEN 'test'
       WHEN row_number > n_train - CAST(ceil(0.1 * n_train) AS BIGINT) THEN 'cal'
       ELSE 'train' END AS split
FROM s"""


def _chrono(spark, sf_dir):
    s = FX.irregular_series(spark, sf_dir).select("event_id", "ts")
    return SP.chrono_split(s, ["ts", "event_id"], test_frac=0.2, cal_frac=0.1, rn="row_number")


@register("chrono_split", _SPLIT_SQL, covers=("W7", "W8"))
def chrono_split(spark, sf_dir):
    return _chrono(spark, sf_dir)


@register("chrono_labels", O.with_(O.IRREGULAR) + """
, r AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS rn, count(*) OVER () AS n FROM series),
s AS (SELECT *, n - CAST(ceil(0.2 * n) AS BIGINT) AS n_train FROM r)
SELECT event_id, ts, event_type, value,
  CASE WHEN rn > n_train THEN 'test'
       WHEN rn > n_train - CAST(ceil(0.1 * n_train) AS BIGINT) THEN 'cal' ELSE 'train' END AS split
FROM s""", covers=("W7", "W8"))
def chrono_labels(spark, sf_dir):
    """The same split without row numbers: whole rows, labelled where they lie."""
    s = FX.irregular_series(spark, sf_dir)
    return SP.chrono_split(s, ["ts", "event_id"], test_frac=0.2, cal_frac=0.1)


@register("train_cap", f"SELECT * FROM ({_SPLIT_SQL}) x WHERE split <> 'train' OR row_number <= 5000",
          covers=("W10",))
def train_cap(spark, sf_dir):
    return SP.cap_rows(_chrono(spark, sf_dir), max_rows=5_000)


@register("seeded_split", """
WITH r AS (SELECT event_id, row_number() OVER (ORDER BY md5(CAST(event_id AS VARCHAR) || ':42'), event_id) AS rn,
                  count(*) OVER () AS n FROM events)
SELECT event_id, CASE WHEN rn <= CAST(ceil(0.3 * n) AS BIGINT) THEN 'test' ELSE 'train' END AS split FROM r""",
          covers=("W9",))
def seeded_split(spark, sf_dir):
    ev = FX.table(spark, sf_dir, "events").select("event_id")
    return SP.seeded_split(ev, "event_id", test_frac=0.3, seed=42)


@register("tail_rows", O.with_(O.IRREGULAR) + """
SELECT event_id, ts, value FROM series ORDER BY ts DESC, event_id DESC LIMIT 100""",
          covers=("W11", "S14"))
def tail_rows(spark, sf_dir):
    s = FX.irregular_series(spark, sf_dir)
    # a top-k report: the limit is the feature (TakeOrderedAndProject)
    return s.orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(100).select("event_id", "ts", "value")


@register("head_rows", O.with_(O.IRREGULAR) + """
SELECT event_id, ts, value FROM series ORDER BY ts, event_id LIMIT 5""", covers=("S14", "W1"))
def head_rows(spark, sf_dir):
    s = FX.irregular_series(spark, sf_dir)
    return s.orderBy("ts", "event_id").limit(5).select("event_id", "ts", "value")


@register("preview_shape", """
SELECT count(*) AS rows, 6 AS columns FROM events""", covers=("S14",))
def preview_shape(spark, sf_dir):
    ev = FX.table(spark, sf_dir, "events")
    return ev.agg(F.count(F.lit(1)).alias("rows")).withColumn("columns", F.lit(len(ev.columns)))


@register("daily_medians", O.with_(O.blocks("1 day")) + "SELECT * FROM blocks", covers=("W12",))
def daily_medians(spark, sf_dir):
    return FX.block_table(spark, sf_dir, every="1 day")
