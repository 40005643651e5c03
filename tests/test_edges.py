"""Edge rows: empty input, all-null and constant columns, a value on a bin
edge, duplicate timestamps, a split of a tiny table."""
import pytest
from pyspark.sql import functions as F

from sinter.operators import evaluate as EV, features as FE, profile as PR, schema as SC, \
    sequence as SQ, split as SP


def test_profile_of_empty_input(spark):
    df = spark.createDataFrame([], "cluster int, x double")
    out = PR.profile(df, by="cluster", cols=["x"])
    assert out.count() == 0 and out.columns == ["cluster", "x_count", "x_mean", "x_std", "x_median"]


def test_profile_single_row_group(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 2.0), (1, 4.0)], "cluster int, x double")
    r = {x["cluster"]: x for x in PR.profile(df, cols=["x"]).collect()}
    assert r[0]["x_std"] is None and r[0]["x_median"] == 1.0 and r[1]["x_median"] == 3.0


def test_all_null_column_dropped(spark):
    df = spark.createDataFrame([("1,5", None), ("2", None)], "a string, b string")
    out = SC.drop_all_null_columns(SC.coerce_all(df))
    assert out.columns == ["a"] and [r.a for r in out.collect()] == [1.5, 2.0]


def test_constant_column_standardises_to_zero(spark):
    df = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    z = FE.apply_standardiser(df, FE.fit_standardiser(df, ["x"]))
    assert [r.x for r in z.collect()] == [0.0, 0.0]


def test_value_on_bin_edge_is_right_closed(spark):
    df = spark.createDataFrame([(0.0,), (5.0,), (5.0000001,), (10.0,)], "actual double")
    b = EV.assign_bins(df, EV.linspace_edges(0.0, 10.0, 3)).orderBy("actual").collect()
    # 0.0 is the global minimum: no bin; 5.0 closes bin 1; 10.0 closes bin 2
    assert [(r.actual, r.bin_idx) for r in b] == [(5.0, 1), (5.0000001, 2), (10.0, 2)]


def test_duplicate_timestamps_need_a_tie_break(spark):
    df = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (2, "2024-01-01 00:00:00"),
                                (3, "2024-01-01 00:00:01")], "id int, t string") \
        .withColumn("t", F.to_timestamp("t"))
    rn = SQ.row_number(df, ["t", "id"], "rn").orderBy("id").collect()
    assert [r.rn for r in rn] == [1, 2, 3]


def test_tiny_chrono_split(spark):
    df = spark.range(3).withColumnRenamed("id", "i")
    s = {r.i: r.split for r in SP.chrono_split(df, ["i"], 0.2, cal_frac=0.1).collect()}
    # n_test = ceil(0.2 * 3) = 1, n_cal = ceil(0.1 * 2) = 1
    assert s == {0: "train", 1: "cal", 2: "test"}


def test_interpolation_null_time(spark):
    df = spark.createDataFrame([(1, "2024-01-01 00:00:00", 1.0), (2, None, 5.0),
                                (3, "2024-01-01 00:00:10", None), (4, "2024-01-01 00:00:20", 3.0)],
                               "id int, t string, v double").withColumn("t", F.to_timestamp("t"))
    out = {r.id: r.v for r in SQ.interpolate_time(df, "t", ["t", "id"], ["v"]).collect()}
    assert out == {1: 1.0, 3: 2.0, 4: 3.0}
    with pytest.raises(ValueError):
        SQ.interpolate_time(df, "t", ["t", "id"], ["v"], on_bad_ts="error")
