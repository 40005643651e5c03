"""Histogram booster: brute-force boosting, partitionings, missing values, storing."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from sinter.operators import boosting as B, models as MD
from sinter.plans import fixtures as FX

EDGES = [[10.5, 20.5, 30.5, 40.5], [0.025, 0.055, 0.085]]


def brute(x, y, edges, trees, depth, rate, lam):
    """Boosting by trying every cut on the rows themselves."""
    pred = np.full(len(y), y.mean())

    def value(rows):
        g = (pred - y)[rows]
        return -rate * g.sum() / (len(rows) + lam)

    def grow(rows, level, out):
        out[rows] = value(rows)
        if level == depth:
            return
        g, best = (pred - y)[rows], None
        for j, cuts in enumerate(edges):
            miss = np.isnan(x[rows, j])
            for missing_left in ((False, True) if miss.any() else (False,)):
                for e in cuts:
                    left = np.where(miss, missing_left, x[rows, j] < e)
                    if 0 < left.sum() < len(rows):
                        gain = sum(g[s].sum() ** 2 / (s.sum() + lam) for s in (left, ~left)) \
                            - g.sum() ** 2 / (len(rows) + lam)
                        if best is None or gain > best[0] * (1 + 1e-12):
                            best = gain, left
        if best is not None and best[0] > 1e-9 * max(g.sum() ** 2 / (len(rows) + lam), 1.0):
            grow(rows[best[1]], level + 1, out)
            grow(rows[~best[1]], level + 1, out)

    for _ in range(trees):
        step = np.zeros(len(y))
        grow(np.arange(len(y)), 0, step)
        pred = pred + step
    return pred


@pytest.fixture(scope="module")
def rows(spark):
    r = FX.planted_regression(spark, SMALL, keep=("l_orderkey", "l_linenumber"))
    gap = F.when(F.col("l_orderkey") % 7 != 0, F.col("quantity").cast("double"))
    return r.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("key"), "label",
                    F.array(gap, F.col("discount").cast("double")).alias("features")).cache()


def test_equals_boosting_on_the_rows(rows):
    fitted = B.HistogramBooster(maxIter=3, maxDepth=3, stepSize=0.3, edges=EDGES).fit(rows)
    got = fitted.transform(rows).toPandas()
    x = np.array([[math.nan if v is None else v for v in f] for f in got["features"]], float)
    want = brute(x, got["label"].to_numpy(), EDGES, 3, 3, 0.3, 1.0)
    assert np.isnan(x).any() and np.allclose(got["prediction"], want, atol=1e-6)


def test_partitions_do_not_change_the_trees(rows):
    make = lambda: B.HistogramBooster(maxIter=3, maxDepth=4, subsamplingRate=0.7, columnRate=0.5, idCol="key", edges=EDGES)
    a = make().fit(rows.coalesce(1)).getOrDefault("state")
    b = make().fit(rows.repartition(7)).getOrDefault("state")
    assert a == b


def test_blocks_are_renewed_and_stored(rows, monkeypatch):
    make = lambda: B.HistogramBooster(maxIter=5, maxDepth=2, idCol="key", edges=EDGES)
    a = make().fit(rows).getOrDefault("state")
    monkeypatch.setattr(B, "REFRESH", 2)
    assert make().fit(rows).getOrDefault("state") == a


def test_samples_have_their_rate():
    key = np.arange(200_000, dtype=np.uint32)
    one, two = (B.drawn_rows(key, 42, t, 0.8) for t in (0, 1))
    assert abs(one.mean() - 0.8) < 0.01 and abs((one & two).mean() - 0.64) < 0.01
    assert [len(B.drawn_columns(10, 42, t, 0.8)) for t in range(3)] == [8, 8, 8]
    assert len({tuple(B.drawn_columns(10, 42, t, 0.8)) for t in range(20)}) > 5


def test_edge_inputs(spark, rows, tmp_path):
    empty = B.HistogramBooster(maxIter=2).fit(rows.limit(0))
    assert {r["prediction"] for r in empty.transform(rows.limit(5)).collect()} == {0.0}
    odd = spark.createDataFrame([(None, 1.0), ([1.0, None], 2.0), ([math.nan, 3.0], None), ([1.0, 2.0], math.inf),
                                 ([2.0, 5.0], 4.0)], "features array<double>, label double")
    fitted = B.HistogramBooster(maxIter=2, stepSize=1.0, regLambda=0.0).fit(odd)
    assert all(math.isfinite(r["prediction"]) for r in fitted.transform(odd).collect())
    fitted.save(str(tmp_path / "m"))
    again = B.BoosterModel.load(str(tmp_path / "m"))
    values = [[r["prediction"] for r in m.transform(odd).collect()] for m in (again, fitted)]
    assert values[0] == values[1]


def test_in_the_model_pipeline(spark):
    r = FX.planted_regression(spark, SMALL)
    booster = B.HistogramBooster(maxIter=15, maxDepth=4, idCol="row_id")
    scored = MD.build_pipeline(("quantity", "discount", "tax"), booster).fit(r).transform(r)
    err, var = scored.agg(F.avg(F.pow(F.col("label") - F.col("prediction"), 2)), F.var_pop("label")).first()
    assert err < 0.1 * var


def test_cells_give_the_trees_of_level_passes(spark, monkeypatch):
    r = spark.range(3000).select(
        F.col("id"), F.array((F.col("id") % 50).cast("double"), F.when(F.col("id") % 13 != 0, (F.col("id") % 11).cast("double")))
        .alias("features"), (F.col("id") % 50 + 3 * (F.col("id") % 7)).cast("double").alias("label"))
    edges = [[i + 0.5 for i in range(49)], [i + 0.5 for i in range(10)]]
    booster = B.HistogramBooster(maxIter=5, stepSize=0.3, maxDepth=4, subsamplingRate=0.8, columnRate=0.5, idCol="id", edges=edges)
    with monkeypatch.context() as m:
        m.setattr(B, "MAX_CELLS", 0)
        by_level = [t.to_list() for t in booster.grown(r)[1]]
    passes = []
    with monkeypatch.context() as m:
        # a pass a tree, none a level
        m.setattr(B, "_tally", lambda *a: 1 / 0)
        sums = B.Cells.sums
        m.setattr(B.Cells, "sums", lambda *a: passes.append(1) or sums(*a))
        few = booster.grown(r)[1]
        assert [t.to_list() for t in few] == by_level and len(passes) == 5
        m.setattr(B, "DRIVER_SUMS", 0)
        assert [t.to_list() for t in booster.grown(r)[1]] == by_level


def test_forest_of_bootstrap_samples(spark, monkeypatch):
    r = spark.range(2000).select("id", F.array((F.col("id") % 20).cast("double")).alias("features"),
                                 F.when(F.col("id") % 100 != 99, (F.col("id") % 20) ** 2).cast("double").alias("label"))
    forest = B.HistogramForest(maxIter=12, stepSize=1.0, maxDepth=10, maxBins=32, regLambda=0.0, idCol="id")
    model = forest.fit(r)
    worst = model.transform(r).agg(F.max(F.abs(F.col("prediction") - F.col("label")))).first()[0]
    assert worst < 1e-6        # every sample has all values, and a value has one label
    key = np.random.default_rng(0).integers(0, 2 ** 32, 20000).astype(np.uint32)
    taken = B.bootstrap(key, 42, 0)
    assert abs(taken.mean() - 1) < 0.03 and abs(taken.var() - 1) < 0.05
    from pyspark.ml.functions import array_to_vector
    monkeypatch.setattr(B, "MAX_CELLS", 0)
    v = r.withColumn("features", array_to_vector("features"))
    assert type(forest.fit(v)).__name__ == "RandomForestRegressionModel"
