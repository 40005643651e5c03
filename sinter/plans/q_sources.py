"""Queries: sources and sinks (S1-S13) over files Spark derives from the
driver tables and writes into the shared scratch folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from sinter.functions import clean as C
from sinter.operators import filters as FL, schema as SC
from sinter.plans import fixtures as FX, oracle as O
from sinter.plans.catalog import register
from sinter.plans.q_clean import cleaned_lineitem
from sinter.session import scratch_path
from sinter.sources import delimited as D, sinks as K

CSV_WRITE = {"header": "true", "ignoreLeadingWhiteSpace": "false",
             "ignoreTrailingWhiteSpace": "false",
             "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS"}


def _write_csv(df, path, sep=","):
    df.write.mode("overwrite").options(**CSV_WRITE, sep=sep).csv(path)
    return path


@register("text_scan", O.with_(O.MESSY) + """
SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey, CAST(l_linenumber AS VARCHAR) AS l_linenumber,
  flag, status, ts_txt, quantity, price, discount, tax FROM messy""", covers=("S1",))
def text_scan(spark, sf_dir):
    path = _write_csv(FX.messy_lineitem(spark, sf_dir), scratch_path(spark, "messy_txt"), sep=";")
    return D.read_text_table(spark, path, sep=";")


@register("indexed_scan", O.with_(O.PREDICTIONS) + """
SELECT model, ts, actual, predicted, lower, upper FROM preds""", covers=("S2", "S3"))
def indexed_scan(spark, sf_dir):
    p = FX.predictions(spark, sf_dir).checkpoint(eager=True)
    frames = []
    for m in [r["model"] for r in p.select("model").distinct().collect()]:   # one file set per model
        one = p.filter(F.col("model") == m).select(F.col("ts").alias(""), "actual", "predicted", "lower", "upper")
        path = _write_csv(one, scratch_path(spark, "predictions_model"))
        frames.append(SC.tag(D.read_indexed(spark, path), model=m))
    return D.read_many(frames)


_UNION_SQL = O.with_(O.MESSY, O.CLEAN) + """
SELECT 'KMEANS' AS method, 'mar_jun' AS period, 'XGB' AS model, 'padrao' AS dataset, CAST(l_orderkey AS DOUBLE) AS l_orderkey, flag,
  quantity, price, CAST(NULL AS DOUBLE) AS discount, 0.0 AS cluster
FROM clean WHERE month(ts) BETWEEN 1 AND 6
UNION ALL
SELECT 'DBSCAN', 'ago_set', 'Outro', 'IQR', CAST(l_orderkey AS DOUBLE), flag, quantity, CAST(NULL AS DOUBLE), discount, 1.0
FROM clean WHERE month(ts) BETWEEN 7 AND 12"""


@register("multi_file_union", _UNION_SQL, covers=("S4", "S6", "P2", "S2"))
def multi_file_union(spark, sf_dir):
    c = cleaned_lineitem(spark, sf_dir)
    # a parent folder whose name misleads: only the dataset's own name counts
    root = scratch_path(spark, "dbscan_ago_set_tabpfn")
    a = FL.month_between(c, "ts", 1, 6).select("l_orderkey", "flag", "quantity", "price",
                                               F.lit(0).alias("cluster"))
    b = FL.month_between(c, "ts", 7, 12).select("l_orderkey", "flag", "quantity", "discount",
                                               F.lit(1).alias("cluster_label"))
    pa = _write_csv(a, f"{root}/labelled_kmeans_mar_jun_xgb")
    pb = _write_csv(b, f"{root}/labelled_DBSCAN_ago_set_iqr_XGB")
    frames = [D.with_provenance(SC.alias_cluster(D.read_text_table(spark, p, sep=",")))
              for p in (pa, pb)]
    u = D.read_many(frames)
    nums = ["l_orderkey", "quantity", "price", "discount", "cluster"]
    return u.select("method", "period", "model", "dataset", *[C.clean_number(c).alias(c) if c in nums else F.col(c)
                                          for c in ("l_orderkey", "flag", *nums[1:])])


_JUNK = ["Relatorio de processo", "Gerado automaticamente", "Unidade: linha 1",
         "Periodo: completo", "---"]
EXPORT_ROWS = 1 << 18


def _preamble_files(spark, sf_dir):
    """One export per event month, cut into files of about ``EXPORT_ROWS``
    rows, each with its own preamble; every second month orders its columns
    differently."""
    ev = FX.table(spark, sf_dir, "events").withColumn("fk", F.month("ts"))
    most = max([r["count"] for r in ev.groupBy("fk").count().collect()], default=1)
    ev = ev.withColumn("cut", F.pmod(F.xxhash64("event_id"), F.lit(-(-most // EXPORT_ROWS))).cast("int"))
    names = ["event_id", "ts", "event_type", "value"]
    cells = [F.col("event_id").cast("string"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.col("event_type"),
             FX.decimal_text("value")]
    body = ev.select(
        "fk", "cut", F.lit(len(_JUNK) + 1).alias("ord"), F.when(F.col("fk") % 2 == 0, F.concat_ws(";", *cells))
        .otherwise(F.concat_ws(";", *cells[::-1])).alias("value"))
    lines = [(i, t) for i, t in enumerate(_JUNK)]
    head = (len(_JUNK), F.when(F.col("fk") % 2 == 0, F.lit(";".join(names))).otherwise(F.lit(";".join(names[::-1]))))
    pre = ev.select("fk", "cut").distinct().select(
        "fk", "cut",
        F.explode(F.array(*[F.struct(F.lit(i).alias("ord"), (t if i == len(_JUNK) else F.lit(t)).alias("value"))
                            for i, t in [*lines, head]])).alias("l")).select("fk", "cut", "l.ord", "l.value")
    path = scratch_path(spark, "preamble_export")
    (body.unionByName(pre).repartition("fk", "cut").sortWithinPartitions("fk", "cut", "ord")
     .select("fk", "cut", "value").write.partitionBy("fk", "cut").text(path))
    return path


@register("preamble_scan", f"""
SELECT CAST(event_id AS VARCHAR) AS event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, event_type,
  {O.dec_text('value')} AS value FROM events""", covers=("S5",))
def preamble_scan(spark, sf_dir):
    return D.read_with_preamble(spark, _preamble_files(spark, sf_dir), skip=len(_JUNK), sep=";").select(
        "event_id", "ts", "event_type", "value")


@register("rewrite_clean", O.with_(O.blocks("1 hour")) + "SELECT * FROM blocks", covers=("S13", "P4"))
def rewrite_clean(spark, sf_dir):
    b = FX.block_table(spark, sf_dir).withColumn("fim", F.lit(None).cast("double"))
    src = scratch_path(spark, "blocks_1h")
    b.write.parquet(src)
    return K.rewrite_clean(spark, src, scratch_path(spark, "blocks_1h_clean"))


@register("prediction_sink", O.with_(O.PREDICTIONS) + """
SELECT model, count(*) AS n, round(sum(predicted), 2) AS predicted_sum FROM preds GROUP BY model""",
          covers=("S7",))
def prediction_sink(spark, sf_dir):
    path = scratch_path(spark, "predictions")
    K.write_predictions(FX.predictions(spark, sf_dir), path)
    back = spark.read.parquet(path)
    return back.groupBy("model").agg(F.count(F.lit(1)).alias("n"),
                                     F.round(F.sum("predicted"), 2).alias("predicted_sum"))


@register("labelled_sink", O.with_(O.MESSY, O.CLEAN) + """
SELECT 'flag' AS algo, 'mar_jun' AS period, month(ts) AS month, flag, count(*) AS n
FROM clean WHERE month(ts) BETWEEN 3 AND 6 GROUP BY ALL""", covers=("S8", "S9", "F3"))
def labelled_sink(spark, sf_dir):
    c = FL.month_between(cleaned_lineitem(spark, sf_dir), "ts", 3, 6)
    c = SC.tag(c, algo="flag", period="mar_jun")
    path = scratch_path(spark, "labelled")
    K.write_labelled(c, path)
    back = spark.read.parquet(path).filter(F.col("month").between(3, 6))   # prunes month dirs
    return back.groupBy("algo", "period", "month", "flag").agg(F.count(F.lit(1)).alias("n"))
