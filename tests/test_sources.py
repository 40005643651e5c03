"""Readers and writers on files written by the tests."""
import os

from pyspark.sql import functions as F

from conftest import SMALL
from sinter.sources import delimited as D, sinks as K


def _write(path, lines):
    with open(path, "w") as f:
        f.write("\n".join(lines) + "\n")


def test_preamble_reader_multi_file_multi_block(spark, tmp_path):
    d = tmp_path / "export"
    d.mkdir()
    for i, n in enumerate([5, 400, 2000]):
        rows = [f"{i}-{j};{j},5;x" for j in range(n)]
        _write(d / f"part{i}.txt", [f"junk {k}" for k in range(5)] + ["id;valor;tag"] + rows)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")   # split files into blocks
    try:
        df = D.read_with_preamble(spark, str(d), skip=5, sep=";")
        assert df.columns == ["id", "valor", "tag"]
        assert df.count() == 2405
        assert df.filter(F.col("id").startswith("junk") | (F.col("id") == "id")).count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_provenance_and_union(spark, tmp_path):
    a = tmp_path / "labelled_kmeans_mar_jun.csv"
    b = tmp_path / "labelled_dbscan_ago_set.csv"
    _write(a, ["x,cluster", "1,0"])
    _write(b, ["x,y,cluster_label", "2,3,1"])
    from sinter.operators.schema import alias_cluster
    u = D.read_many([D.with_provenance(alias_cluster(D.read_text_table(spark, str(p), sep=",")))
                     for p in (a, b)])
    rows = {r["method"]: r for r in u.collect()}
    assert rows["KMEANS"]["period"] == "mar_jun" and rows["KMEANS"]["y"] is None
    assert rows["DBSCAN"]["cluster"] == "1" and rows["DBSCAN"]["period"] == "ago_set"


def test_indexed_reader(spark, tmp_path):
    p = tmp_path / "pred.csv"
    _write(p, [",actual,predicted", "2024-11-23 10:00:00,1.5,1.4", "bad,2.0,2.1"])
    df = D.read_indexed(spark, str(p))
    rows = df.orderBy("actual").collect()
    assert df.columns == ["ts", "actual", "predicted"]
    assert str(rows[0]["ts"]) == "2024-11-23 10:00:00" and rows[1]["ts"] is None


def test_runs_table_and_model_store(spark, tmp_path):
    runs = str(tmp_path / "runs")
    K.append_run(spark, runs, "dbscan", "mar_jun", {"eps": 0.5, "eps_source": "knee"}, 4, 100)
    K.append_run(spark, runs, "kmeans", "mar_jun", {"k": 4}, 4, 100)
    assert spark.read.parquet(runs).count() == 2
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml import Pipeline, PipelineModel
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.1), (3.0, 6.2)], "x double, y double")
    from sinter.operators.models import linear_model
    m = Pipeline(stages=[VectorAssembler(inputCols=["x"], outputCol="features"),
                         linear_model().setLabelCol("y")]).fit(df)
    K.save_model(m, str(tmp_path / "model"))
    assert PipelineModel.load(str(tmp_path / "model")).transform(df).count() == 3


def test_rewrite_refuses_same_path(spark, tmp_path):
    import pytest
    with pytest.raises(ValueError):
        K.rewrite_clean(spark, str(tmp_path / "a"), str(tmp_path / "a/"))


def test_provenance_of_a_plain_file_is_its_own_name(spark, tmp_path):
    plain = tmp_path / "dbscan_xgb_IQR_runs" / "labelled_kmeans_ago_set.csv"
    plain.parent.mkdir()
    plain.write_text("a\n1\n")
    r = D.with_provenance(D.read_text_table(spark, str(plain))).first()
    assert (r["method"], r["period"], r["model"], r["dataset"]) == ("KMEANS", "ago_set", "Outro", "padrao")
    # a written dataset is named by its folder, whatever lies above it
    written = str(tmp_path / "dbscan_runs" / "labelled_kmeans_mar_jun")
    spark.range(3).withColumn("k", F.lit(1)).write.partitionBy("k").parquet(written)
    assert {(x["method"], x["period"]) for x in D.with_provenance(spark.read.parquet(written)).collect()} == {("KMEANS", "mar_jun")}


def test_a_saved_pipeline_scores_the_same(spark, tmp_path):
    from sinter.operators import models as MD
    rows = spark.createDataFrame([(float(i), None if i % 7 == 0 else i * 0.5, 3.0, i % 3, 2.0 * i) for i in range(60)],
                                 "a double, b double, flat double, cluster int, label double")
    fitted = MD.build_pipeline(("a", "b", "flat"), MD.linear_model()).fit(rows)
    path = str(tmp_path / "model")
    K.save_model(fitted, path)
    before = [r.prediction for r in fitted.transform(rows).orderBy("a").collect()]
    assert [r.prediction for r in K.load_model(path).transform(rows).orderBy("a").collect()] == before


def test_preamble_exports_have_bounded_files(spark, monkeypatch):
    """Events of one month make more files as they get more, each with a preamble."""
    from sinter.plans import q_sources as Q
    before = Q.preamble_scan(spark, SMALL).orderBy("event_id").collect()
    monkeypatch.setattr(Q, "EXPORT_ROWS", 100)
    path = Q._preamble_files(spark, SMALL)
    files = spark.read.text(path).groupBy(F.input_file_name()).count().collect()
    assert len(files) >= 10 and max(r["count"] for r in files) < 300
    assert Q.preamble_scan(spark, SMALL).orderBy("event_id").collect() == before
