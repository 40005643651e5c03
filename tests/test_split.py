"""Splits by rank selection equal a sort, with ties, nulls and hot values."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from sinter.operators import sequence as SQ, split as SP


@pytest.fixture(scope="module")
def many(spark):
    # one time holds a third of all rows, some times are null
    return spark.range(0, 200_000, numPartitions=6).selectExpr(
        "id", "CASE WHEN id % 3 = 0 THEN timestamp'2024-05-01' WHEN id % 1001 = 1 THEN NULL "
              "ELSE timestamp_seconds(1700000000 + id * 7919 % 1000003) END AS t", "id % 2 AS g")


def test_cuts_without_numbers(spark, many, monkeypatch):
    monkeypatch.setattr(SP, "FEW", 500)
    monkeypatch.setattr(SP, "SAMPLE", 2_000)
    monkeypatch.setattr(SP, "PIVOTS", 60)
    got = SP.chrono_split(many, ["t", "id"], 0.2, cal_frac=0.1)
    assert set(got.columns) == {"id", "t", "g", "split"}
    p = got.toPandas()
    p["o"] = p.t.isna().map({True: 0, False: 1})
    p = p.sort_values(["o", "t", "id"])
    assert p.split.tolist() == ["train"] * 144_000 + ["cal"] * 16_000 + ["test"] * 40_000
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan and "Window" not in plan


def test_ties_at_the_cut_keep_sizes_exact(spark, many):
    got = SP.chrono_split(many, ["t"], 0.5, cal_frac=0.1)
    n = {r.split: r["count"] for r in got.groupBy("split").count().collect()}
    assert n == {"train": 90_000, "cal": 10_000, "test": 100_000}
    assert got.select("id").distinct().count() == 200_000
    last = got.groupBy("split").agg({"t": "max"}).collect()
    first = got.groupBy("split").agg({"t": "min"}).collect()
    hi, lo = {r[0]: r[1] for r in last}, {r[0]: r[1] for r in first}
    assert hi["train"] <= lo["cal"] and hi["cal"] <= lo["test"]


def test_equal_rows_only(spark):
    same = spark.range(1_000).selectExpr("1 AS a")
    n = {r.split: r["count"] for r in SP.chrono_split(same, ["a"], 0.3).groupBy("split").count().collect()}
    assert n == {"train": 700, "test": 300}


def test_empty_and_one_row(spark):
    one = spark.range(1)
    assert [r.split for r in SP.chrono_split(one, ["id"], 0.2).collect()] == ["test"]
    assert SP.chrono_split(one.limit(0), ["id"], 0.2).count() == 0
    assert SP.seeded_split(one.limit(0), "id").count() == 0


def test_seeded_split_with_repeated_and_null_ids(spark):
    ids = spark.range(900).selectExpr("CASE WHEN id < 300 THEN 7 WHEN id < 310 THEN NULL ELSE id END AS id")
    n = {r.split: r["count"] for r in SP.seeded_split(ids, "id", 0.3).groupBy("split").count().collect()}
    assert n == {"test": 270, "train": 630}


def test_ranges_one_exchange_and_null_keys(spark):
    rng = np.random.default_rng(5)
    rows = [(i, None if i % 4 == 0 else "hot" if i % 4 < 3 else f"k{i % 11}", int(rng.integers(0, 50)),
             float(i) if rng.random() < 0.5 else None) for i in range(2_000)]
    df = spark.createDataFrame(rows, "id long, k string, t int, v double").repartition(7)
    out = SQ.fill(df, ["t", "id"], forward=["v"], key="k", partitions=9)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("shufflepartitionidpassthrough") == 1 and "Scan ExistingRDD" in plan
    got = {r.id: r.v for r in out.collect()}
    want, last = {}, {}
    for i, k, t, v in sorted(rows, key=lambda r: (r[2], r[0])):
        last[k] = v if v is not None else last.get(k)
        want[i] = last[k]
    assert got == want


def test_order_literals_of_every_type(spark):
    """Values come back from the driver as they went."""
    rows = [(f, s, b, d, k) for f in (float("nan"), float("-inf"), -0.1, 1e-310, None) for s in ("it's \\ \n ü", "", None)
            for b in (b"\x00\xff", None) for d in ("12.30", None) for k in (True, None)]
    df = spark.createDataFrame(rows, "f double, s string, b binary, d string, k boolean").selectExpr(
        "f", "s", "b", "CAST(d AS decimal(9,2)) AS d", "k", "DATE'2024-02-29' AS day", "TIMESTAMP_NTZ'2024-03-31 02:30:00.000001' AS n",
        "CAST(f AS float) AS g").withColumn("id", SQ.F.monotonically_increasing_id())
    names = ["f", "s", "b", "d", "k", "day", "n", "g", "id"]
    o = SQ.Order.of(df, names)
    got = [tuple(r["v"]) for r in df.select(o.value.alias("v")).orderBy("v").collect()]
    assert df.select(o.position(got).alias("p")).orderBy("p").toPandas().p.tolist() == list(range(1, len(rows) + 1))


def test_hash_cut_is_the_rank_cut(spark):
    from sinter.operators.sequence import Order
    # hashes that share their first digits, one that many rows share, and none
    x = spark.range(3000).select(
        F.when(F.col("id") % 7 == 0, F.lit("00ff12")).when(F.col("id") % 11 != 0, F.md5(F.col("id").cast("string"))).alias("_h"), "id")
    x = x.withColumn("id", F.when(F.col("id") % 14 == 0, 1).otherwise(F.col("id")))
    o = Order.of(x, ["_h", "id"])
    for rank in (1, 150, 240, 400, 700, 2999, 3000):
        assert SP.hash_cut("_h")(x, o, rank, 3000) == SP.rank_cut(x, o, rank, 3000)


def test_seeded_split_looks_at_few_rows_only_after_one_count(spark, monkeypatch):
    monkeypatch.setattr(SP, "FEW", 64)
    monkeypatch.setattr(SP, "_pivots", lambda *a: 1 / 0)
    s = SP.seeded_split(spark.range(20000), "id", test_frac=0.3)
    assert s.filter("split = 'test'").count() == 6000
