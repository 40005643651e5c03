"""Test inputs derived from the driver tables (FIXTURES.md part B).

The driver tables are clean, so each builder plants its dirt with fixed
integer rules that DuckDB reproduces exactly (see ``sinter.plans.oracle``).
Every builder reads a whole table; the work grows with the scale factor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sinter.functions.clean import SENTINEL

# Planted-dirt rules and names used by both engines.
SENSORS = ("click", "error", "purchase", "signup", "view")
MODEL_BY_FLAG = {"A": "RandomForest", "N": "XGB", "R": "TabPFN"}
CLUSTER_BY_FLAG = {"A": 0, "N": 1, "R": 2}
STRIP_STEP = 0.3          # spacing of consecutive points along a strip
STRIP_SEGMENT = 25        # points per strip segment
STRIP_GAP = 5.0           # jump between segments
STRIP_NOISE_EVERY = 97    # every 97th event becomes a far noise point


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def decimal_text(x) -> Column:
    """A non-negative double with two decimals as text with a decimal comma
    (via DECIMAL(14,2), printed the same way by both engines)."""
    x = F.col(x) if isinstance(x, str) else x
    return F.replace(x.cast("decimal(14,2)").cast("string"), F.lit("."), F.lit(","))


def messy_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1: lineitem as a text sensor table.

    price: sentinel where l_orderkey % 17 = 0; quantity: blank where
    % 23 = 0; tax: '1d' (not a number for pandas/DuckDB) where % 31 = 0;
    ts_txt: 'sem data' where % 37 = 0.
    """
    li = table(spark, sf_dir, "lineitem")
    k = F.col("l_orderkey")
    return li.select(
        F.col("l_orderkey"), F.col("l_linenumber"),
        F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"),
        F.when(k % 37 == 0, F.lit("sem data"))
         .otherwise(F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss.SSSSSS")).alias("ts_txt"),
        F.when(k % 23 == 0, F.lit("   ")).otherwise(decimal_text("l_quantity")).alias("quantity"),
        F.when(k % 17 == 0, F.lit(SENTINEL)).otherwise(decimal_text("l_extendedprice")).alias("price"),
        decimal_text("l_discount").alias("discount"),
        F.when(k % 31 == 0, F.lit("1d")).otherwise(decimal_text("l_tax")).alias("tax"),
    )


def hourly_sensors(spark: SparkSession, sf_dir: str, plant_zeros: bool = False) -> DataFrame:
    """B2: one row per hour, one median column per event type (gaps = null)."""
    from sinter.operators.profile import block_medians
    ev = table(spark, sf_dir, "events")
    v = F.col("value")
    if plant_zeros:
        v = F.when(F.col("event_id") % 29 == 0, F.lit(0.0)).otherwise(v)
    return block_medians(ev, "ts", "event_type", v, "1 hour", keys=SENSORS)


def irregular_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, ts, value) with value null where event_id % 7 = 0."""
    ev = table(spark, sf_dir, "events")
    return ev.select("event_id", "ts", "event_type",
                     F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"))


def _model_of_flag() -> Column:
    m = F.col("l_returnflag")
    expr = None
    for flag, name in MODEL_BY_FLAG.items():
        expr = (F.when(m == flag, F.lit(name)) if expr is None
                else expr.when(m == flag, F.lit(name)))
    return expr.otherwise(F.lit("Outro"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A long prediction table (ts, model, actual, predicted, lower, upper)."""
    li = table(spark, sf_dir, "lineitem")
    pred = F.col("l_extendedprice") * (F.lit(1.0) + ((F.col("l_partkey") % 21) - 10) / F.lit(100.0))
    return (li.select(F.col("l_shipdate").alias("ts"), _model_of_flag().alias("model"),
                      F.col("l_orderkey"), F.col("l_linenumber"),
                      F.col("l_extendedprice").alias("actual"), pred.alias("predicted"))
            .withColumns({"lower": F.col("predicted") - 4000.0,
                          "upper": F.col("predicted") + 4000.0}))


def zero_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer balances as actuals with planted zeros (c_custkey % 50 = 0)."""
    cu = table(spark, sf_dir, "customer")
    actual = F.when(F.col("c_custkey") % 50 == 0, F.lit(0.0)).otherwise(F.col("c_acctbal"))
    pred = F.col("c_acctbal") * (F.lit(1.0) + ((F.col("c_custkey") % 11) - 5) / F.lit(100.0))
    return cu.select("c_custkey", F.col("c_mktsegment").alias("model"),
                     actual.alias("actual"), pred.alias("predicted"))


def planted_strips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B8 (re-aimed): planted 2-D clusters from every event.

    Four horizontal strips (event_id % 4); along a strip consecutive points
    are 0.3 apart with <= 0.2 jitter, broken into segments of 25 points by
    a 5.0 gap; every 97th event is moved far away as noise. Density stays
    constant as the table grows, so neighbour pairs grow linearly.
    """
    ev = table(spark, sf_dir, "events")
    i = F.col("event_id")
    j = (i / 4).cast("long")
    x = j * STRIP_STEP + (j / STRIP_SEGMENT).cast("long") * STRIP_GAP
    y = (i % 4) * 10.0 + ((i * 7919) % 1000) / 5000.0
    noise = i % STRIP_NOISE_EVERY == 0
    return ev.select(
        i.alias("row_id"),
        F.when(noise, F.lit(500.0) + i).otherwise(x).alias("x"),
        F.when(noise, F.lit(-500.0)).otherwise(y).alias("y"))


def planted_regression(spark: SparkSession, sf_dir: str, keep=()) -> DataFrame:
    """A label with signal in quantity, discount and the regime; columns
    named in ``keep`` stay."""
    li = table(spark, sf_dir, "lineitem")
    flag = F.col("l_returnflag")
    label = (2 * F.col("l_quantity") + 100 * F.col("l_discount")
             + F.when(flag == "R", F.lit(20.0)).otherwise(F.lit(0.0))
             + (F.col("l_partkey") % 11) - 5)
    cluster = F.when(flag == "A", 0).when(flag == "N", 1).otherwise(2)
    return li.select(
        F.xxhash64(*li.columns).alias("row_id"),
        F.col("l_shipdate").alias("ts"),
        F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"), cluster.alias("cluster"), label.cast("double").alias("label"), *keep)


def block_table(spark: SparkSession, sf_dir: str, every: str = "1 hour") -> DataFrame:
    """Block medians per sensor (``*_mediana``) plus a lab value
    (``purchase_laudo``, the purchase median) that is missing in blocks
    without a purchase."""
    from sinter.operators.profile import block_medians
    ev = table(spark, sf_dir, "events")
    blocks = block_medians(ev, "ts", "event_type", "value", every, keys=SENSORS)
    return blocks.select("ts", *[F.col(s).alias(f"{s}_mediana") for s in SENSORS if s != "purchase"],
                         F.col("purchase").alias("purchase_laudo"))


def event_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B4e: a prediction table with a unique time order (ts, event_id): one
    'model' per event type, predicted off by (user_id % 21 - 10) percent."""
    ev = table(spark, sf_dir, "events")
    pred = F.col("value") * (F.lit(1.0) + ((F.col("user_id") % 21) - 10) / F.lit(100.0))
    return ev.select("event_id", "ts", F.col("event_type").alias("model"),
                     F.col("value").alias("actual"), pred.alias("predicted"))
