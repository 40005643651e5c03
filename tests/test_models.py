"""Model pipeline properties on the planted regression (sf0.001)."""
import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from sinter.operators import features as FE, models as MD, split as SP
from sinter.plans import fixtures as FX


def test_one_hot_unseen_level_is_zero(spark):
    df = spark.createDataFrame([(0,), (1,), (-1,)], "cluster int")
    levels = FE.fit_levels(df, where=F.col("cluster") >= 0)
    z = FE.apply_one_hot(df, levels).orderBy("cluster").collect()
    assert (z[0]["cluster_0"], z[0]["cluster_1"]) == (0.0, 0.0)
    m = FE.one_hot_pipeline().fit(df.filter("cluster >= 0"))
    vecs = m.transform(df).orderBy("cluster").collect()
    assert vecs[0]["cluster_vec"].toArray().sum() == 0.0


def test_models_beat_mean_predictor(spark):
    r = FX.planted_regression(spark, SMALL)
    s = SP.seeded_split(r, "row_id", test_frac=0.3, seed=42).cache()
    specs = {"RandomForest": MD.model_specs("union", rf_depth=6, rf_trees=20)["RandomForest"],
             "Linear": MD.linear_model}
    table = {row["model"]: row for row in
             MD.compare(s, ("quantity", "discount", "tax"), specs=specs).collect()}
    for row in table.values():
        assert row["r2"] > 0.5 and row["n_test"] == s.filter("split = 'test'").count()


def test_seeded_split_is_exact_and_stable(spark):
    ev = FX.table(spark, SMALL, "events").select("event_id")
    a = SP.seeded_split(ev, "event_id", 0.3).filter("split = 'test'")
    b = SP.seeded_split(ev.repartition(5), "event_id", 0.3).filter("split = 'test'")
    n = ev.count()
    assert a.count() == -(-3 * n // 10)
    assert a.exceptAll(b).count() == 0


def test_boosting_defaults_take_one_pass_a_tree(spark, monkeypatch):
    from sinter.operators import boosting as BO
    passes, sums = [], BO.Cells.sums
    monkeypatch.setattr(BO.Cells, "sums", lambda *a: passes.append(1) or sums(*a))
    r = SP.seeded_split(FX.planted_regression(spark, SMALL), "row_id", test_frac=0.3, seed=42).cache()
    specs = {"GradientBoosting": MD.model_specs("union")["GradientBoosting"]}
    row = MD.compare(r, ("quantity", "discount", "tax"), specs=specs).first()
    assert len(passes) == MD.GB_TREES and row["r2"] > 0.9


def test_forest_and_boosting_refuse_missing_labels(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0, 0, "train"), (2, 2.0, None, 0, "train"), (3, 2.0, 1.0, 0, "test")],
                               "row_id int, q double, label double, cluster int, split string")
    for name in ("RandomForest", "GradientBoosting"):
        with pytest.raises(ValueError, match="labels"):
            MD.compare(df, ("q",), specs={name: MD.model_specs("union", rf_trees=2)[name]})
