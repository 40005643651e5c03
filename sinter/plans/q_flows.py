"""Queries: end-to-end flows and the remaining sinks (entry 1, entry 3,
M7, M11, S9, S10, S11, S12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sinter.functions import clean as C
from sinter.operators import cluster as CL, evaluate as EV, filters as FL, models as MD, profile as PR, \
    schema as SC, sequence as SQ, split as SP
from sinter.plans import fixtures as FX, oracle as O
from sinter.plans.catalog import register
from sinter.plans.pipelines import conformal_flow, period_rows, prepare, regimes_by_period
from sinter.plans.q_clean import MEASURES, _profile_sql, cleaned_lineitem
from sinter.plans.q_metrics import _global_sql
from sinter.session import scratch_path
from sinter.sources import delimited as D, sinks as K


def _sensor_text_table(spark, sf_dir):
    """B1 shaped like the reference export: 'inicio' text date, text
    measures, a text 'fim' that coerces to all-null."""
    m = FX.messy_lineitem(spark, sf_dir)
    return m.select(F.col("ts_txt").alias("inicio"), F.col("ts_txt").alias("fim"),
                    "flag", *MEASURES)


_PERIOD_COUNTS = O.with_(O.MESSY, O.CLEAN) + f"""
, pr AS (SELECT * FROM (VALUES ('mar_jun', 3, 6), ('ago_set', 8, 9)) v(period, a, b)),
pc AS (SELECT period, count(*) AS n FROM clean JOIN pr ON month(ts) BETWEEN a AND b
       WHERE {' AND '.join(f'{c} IS NOT NULL' for c in MEASURES)} GROUP BY period)"""


def _runs_check(spark, out, algo):
    """The runs table beside what the labelled rows and the profiles hold."""
    runs = spark.read.parquet(f"{out}/runs")
    data = spark.read.parquet(f"{out}/data").groupBy("period").agg(F.count(F.lit(1)).alias("n_labelled"))
    prof = None
    for tag in CL.PERIODS:
        one = spark.read.parquet(f"{out}/summary_{algo}_{tag}")
        one = one.groupBy("period").agg(F.sum("quantity_count").alias("n_profiled"))
        prof = one if prof is None else prof.unionByName(one)
    return (runs.join(data, "period").join(prof, "period")
            .select("algo", "period", "n_clusters", "n_rows", "n_labelled", "n_profiled"))


@register("regimes_kmeans_by_period", _PERIOD_COUNTS + """
SELECT 'kmeans' AS algo, period, 4 AS n_clusters, n AS n_rows, n AS n_labelled, n AS n_profiled FROM pc""", covers=("K9", "K1", "K7", "A1", "S8", "S9", "S11", "S12",
                                               "P4", "P7", "P10", "P18", "F11"))
def regimes_kmeans_by_period(spark, sf_dir):
    out = scratch_path(spark, "regime_outputs")
    regimes_by_period(spark, _sensor_text_table(spark, sf_dir), out, algo="kmeans", k=4)
    return _runs_check(spark, out, "kmeans")


def _late_sensor_table(spark, sf_dir):
    """The sensor table with one tag that reports from August on."""
    t = _sensor_text_table(spark, sf_dir)
    late = F.when(F.month(C.parse_ts_any("inicio")) >= 8, F.col("quantity"))
    return t.withColumn("late", late)


@register("late_sensor_profile", _PERIOD_COUNTS + f"""
, x AS (SELECT pr.period, clean.* FROM clean JOIN pr ON month(ts) BETWEEN a AND b
        WHERE {' AND '.join(f'{c} IS NOT NULL' for c in MEASURES)})
SELECT period, CASE period WHEN 'mar_jun' THEN {len(MEASURES)} ELSE {len(MEASURES) + 1} END AS n_features,
  count(*) AS n_rows, round(avg(price), 4) AS price_mean,
  round(CASE WHEN period = 'ago_set' THEN avg(quantity) END, 4) AS late_mean
FROM x GROUP BY period""", covers=("K9", "P4", "F1", "F11"))
def late_sensor_profile(spark, sf_dir):
    """Null columns are judged inside each period: a tag that is empty in
    one of them costs that period no row."""
    typed, numeric, date = prepare(_late_sensor_table(spark, sf_dir))
    out = None
    for tag, (rows, feats) in period_rows(typed, numeric, date).items():
        late = F.round(F.avg("late"), 4) if "late" in feats else F.lit(None).cast("double")
        one = rows.agg(F.lit(tag).alias("period"), F.lit(len(feats)).alias("n_features"), F.count(F.lit(1)).alias("n_rows"),
                       F.round(F.avg("price"), 4).alias("price_mean"), late.alias("late_mean"))
        out = one if out is None else out.unionByName(one)
    return out


@register("summary_sink", _profile_sql((3, 6)), covers=("S9", "A1"))
def summary_sink(spark, sf_dir):
    c = FL.drop_any_null(FL.month_between(cleaned_lineitem(spark, sf_dir), "ts", 3, 6), MEASURES)
    summary = PR.profile(c, by="flag", cols=MEASURES)
    path = scratch_path(spark, "summary_flag_mar_jun")
    K.write_table(summary, path, fmt="csv")
    return D.read_typed(spark, path, summary.schema, sep=",")


@register("metrics_sink", _global_sql(), covers=("S10", "A8"))
def metrics_sink(spark, sf_dir):
    from sinter.plans.q_metrics import _rounded
    t = _rounded(EV.metrics_table(FX.predictions(spark, sf_dir)))
    path = scratch_path(spark, "metrics_table")
    K.write_table(t, path, fmt="csv")
    return D.read_typed(spark, path, t.schema, sep=",")


@register("conformal_models", covers=("P8", "M5", "M7", "M9", "M10", "W7", "W8", "E2", "E4", "E7",
                                       "E8", "E9", "S7", "W4"))
def conformal_models(spark, sf_dir):
    h = FX.hourly_sensors(spark, sf_dir)
    h = FL.drop_any_null(SQ.interpolate_time(h, "ts", ["ts"], FX.SENSORS))
    feats = [s for s in FX.SENSORS if s != "purchase"]
    table, preds = conformal_flow(spark, h, "ts", "purchase", feats, grid="conformal")
    K.write_predictions(preds, scratch_path(spark, "predictions"))                    # S7
    return table


@register("union_train", O.with_(O.MESSY, O.CLEAN) + """
, u AS (SELECT count(*) AS n FROM clean WHERE ts IS NOT NULL AND price IS NOT NULL)
SELECT 'Linear' AS model, CAST(n - ceil(n * 0.3) AS BIGINT) AS n_train, CAST(ceil(n * 0.3) AS BIGINT) AS n_test,
  true AS beats_mean FROM u""", covers=("M11", "S4", "P2", "F2", "M8"))
def union_train(spark, sf_dir):
    c = cleaned_lineitem(spark, sf_dir)
    root = scratch_path(spark, "regime_outputs")
    a = FL.month_between(c, "ts", 1, 6).select("l_orderkey", "l_linenumber", "quantity", "discount",
                                               "tax", "price", F.lit(0).alias("cluster"))
    b = FL.month_between(c, "ts", 7, 12).select("l_orderkey", "l_linenumber", "quantity", "discount",
                                               "tax", "price", F.lit(1).alias("cluster_label"))
    paths = [f"{root}/labelled_kmeans_mar_jun", f"{root}/labelled_dbscan_ago_set"]
    for df, p in zip((a, b), paths):
        df.write.mode("overwrite").parquet(p)
    u = D.read_many(SC.alias_cluster(spark.read.parquet(p)) for p in paths)
    u = FL.drop_any_null(u, ["price"])                                                 # F2
    # a key per source row: order and line name it
    u = u.withColumn("row_key", F.col("l_orderkey") * 100 + F.col("l_linenumber"))
    s = SP.seeded_split(u, "row_key", test_frac=0.3, seed=42).checkpoint(eager=True)
    return MD.checkable(MD.compare(s, ("quantity", "discount", "tax"), label="price", cluster="cluster",
                                   specs={"Linear": MD.linear_model}), slack=0.01)

