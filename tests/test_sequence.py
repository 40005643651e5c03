"""Range-partitioned series operators equal a plain pandas computation,
with duplicate timestamps, a dominant key and many partitions."""
import numpy as np
import pandas as pd
import pytest

from sinter.operators import sequence as SQ


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(3)
    n = 3000
    ts = pd.to_datetime("2024-01-01") + pd.to_timedelta(rng.integers(0, 500, n), unit="min")
    key = np.where(rng.random(n) < 0.7, "hot", rng.choice(["a", "b", "c"], n))
    v = rng.normal(size=n)
    v[rng.random(n) < 0.35] = np.nan
    pdf = pd.DataFrame({"id": np.arange(n), "ts": ts, "k": key, "v": v})
    sdf = spark.createDataFrame(pdf.assign(v=pdf.v.astype(object).where(pdf.v.notna(), None)))
    return pdf, sdf


def _to_pd(df, cols):
    return df.toPandas().sort_values("id").reset_index(drop=True)[cols]


@pytest.mark.parametrize("parts", [1, 7, 23])
def test_row_number(spark, frame, parts):
    pdf, sdf = frame
    got = _to_pd(SQ.row_number(sdf, ["ts", "id"], "rn", partitions=parts), ["id", "rn"])
    exp = pdf.sort_values(["ts", "id"]).assign(rn=np.arange(1, len(pdf) + 1)).sort_values("id")
    assert got.rn.tolist() == exp.rn.tolist()


@pytest.mark.parametrize("key", [None, "k"])
def test_fills(spark, frame, key):
    pdf, sdf = frame
    got = _to_pd(SQ.fill(sdf, ["ts", "id"], forward=["v"], backward=[], key=key, partitions=9), ["id", "v"])
    s = pdf.sort_values(["ts", "id"])
    exp = (s.groupby("k").v.ffill() if key else s.v.ffill()).reindex(pdf.index)
    np.testing.assert_allclose(got.v.astype(float), exp.astype(float), equal_nan=True)
    gotb = _to_pd(SQ.bfill(sdf, ["ts", "id"], ["v"], key=key, partitions=9), ["id", "v"])
    expb = (s.groupby("k").v.bfill() if key else s.v.bfill()).reindex(pdf.index)
    np.testing.assert_allclose(gotb.v.astype(float), expb.astype(float), equal_nan=True)


@pytest.mark.parametrize("key", [None, "k"])
def test_lags(spark, frame, key):
    pdf, sdf = frame
    got = _to_pd(SQ.lag(sdf, ["ts", "id"], ["v"], steps=(1, 3), key=key, partitions=11),
                 ["id", "v_lag1", "v_lag3"])
    s = pdf.sort_values(["ts", "id"])
    g = s.groupby("k").v if key else s.v
    np.testing.assert_allclose(got.v_lag1.astype(float), g.shift(1).reindex(pdf.index), equal_nan=True)
    np.testing.assert_allclose(got.v_lag3.astype(float), g.shift(3).reindex(pdf.index), equal_nan=True)


def test_interpolation_matches_numpy(spark, frame):
    pdf, sdf = frame
    got = _to_pd(SQ.interpolate_time(sdf, "ts", ["ts", "id"], ["v"], partitions=5), ["id", "v"])
    s = pdf.sort_values(["ts", "id"]).reset_index()
    t = s.ts.astype("int64").to_numpy() / 1e3
    v = s.v.to_numpy()
    known = ~np.isnan(v)
    out = v.copy()
    idx = np.flatnonzero(~known)
    ki = np.flatnonzero(known)
    for i in idx:
        p = ki[ki < i]
        nx = ki[ki > i]
        if len(p) == 0:
            continue
        p = p[-1]
        if len(nx) == 0:
            out[i] = v[p]
            continue
        nx = nx[0]
        out[i] = v[p] if t[nx] == t[p] else v[p] + (v[nx] - v[p]) * (t[i] - t[p]) / (t[nx] - t[p])
    exp = pd.Series(out, index=s["index"]).reindex(pdf.index)
    np.testing.assert_allclose(got.v.astype(float), exp, equal_nan=True, rtol=1e-9)


def test_one_range_reads_exchanged_rows(spark):
    """F8: the task of a single range doesn't run what leads to its rows."""
    from pyspark import TaskContext
    from pyspark.sql import functions as F

    task = F.udf(lambda _: TaskContext.get().taskAttemptId(), "long").asNondeterministic()
    df = spark.range(0, 60, 1, 4).withColumn("task", task("id"))
    r = SQ.Ranges(df, ["id"])
    assert r.n == 1 and r.rows.rdd.getNumPartitions() == 1
    assert r.rows.agg(F.count_distinct("task")).first()[0] == 4
    assert [x.id for x in SQ.row_number(df, ["id"], "n").filter("n = id + 1").sort("id").collect()] == list(range(60))
