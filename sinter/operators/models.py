"""Regressors with the regime as a feature.

Spark ML does the distributed work: ``Pipeline`` of mean imputation,
assembly, scaling and a one-hot regime, then a tree ensemble or a linear
model. The comparison grid splits once (a ``split`` column), fits each
model on executors and keeps predictions distributed; only one metrics row
per model reaches the driver.
"""

from __future__ import annotations

import time

from pyspark import keyword_only
from pyspark.ml import Estimator, Pipeline, Transformer
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame, functions as F, types as T

from sinter.functions import metrics as M
from sinter.operators.boosting import HistogramBooster, HistogramForest
from sinter.operators.features import apply_standardiser, fit_standardiser, imputer, one_hot_stages

# The reference's model settings.
RF_TREES = 300
RF_SEED = 42
GB_TREES, GB_RATE, GB_DEPTH = 100, 0.1, 3
XGB_TREES, XGB_RATE, XGB_SUBSAMPLE, XGB_COLSAMPLE = 400, 0.05, 0.8, 0.8


def model_specs(grid: str = "union", rf_depth: int = 12, max_bins: int = 32,
                rf_trees: int | None = None, id_col: str = "") -> dict:
    """Model grids of the reference.

    ``union``: forest 300 trees, boosting defaults (100 x 0.1, depth 3) and
    the xgboost-like booster (400 x 0.05, rows and columns sampled 0.8 for
    each tree; ``id_col`` names its row key).
    ``conformal``: forest 100 trees and a default xgboost-like booster
    (100 x 0.3, depth 6). Spark trees stop at depth 30; the reference grows
    forests to purity, so the forest depth is a parameter.
    """
    def forest(trees):
        return HistogramForest(maxIter=trees, stepSize=1.0, maxDepth=rf_depth, maxBins=max_bins, regLambda=0.0,
                               seed=RF_SEED, idCol=id_col, strict=True)

    if grid == "union":
        trees = rf_trees or RF_TREES
        return {
            "RandomForest": lambda: forest(trees),
            "GradientBoosting": lambda: HistogramBooster(
                maxIter=GB_TREES, stepSize=GB_RATE, maxDepth=GB_DEPTH, maxBins=max_bins, regLambda=0.0, seed=RF_SEED,
                strict=True),
            "XGBoost": lambda: HistogramBooster(
                maxIter=XGB_TREES, stepSize=XGB_RATE, maxDepth=6, subsamplingRate=XGB_SUBSAMPLE,
                columnRate=XGB_COLSAMPLE, seed=RF_SEED, idCol=id_col),
        }
    if grid == "conformal":
        trees = rf_trees or 100
        return {
            "RandomForest": lambda: forest(trees),
            "XGB": lambda: GBTRegressor(maxIter=100, stepSize=0.3, maxDepth=6,
                                        maxBins=max_bins, seed=RF_SEED),
        }
    raise ValueError(f"unknown grid {grid}")


def linear_model() -> LinearRegression:
    """M8: ordinary least squares (normal equations, no penalty)."""
    return LinearRegression(solver="normal", regParam=0.0, elasticNetParam=0.0)


class _ScalerParams(HasInputCols):
    means = Param(Params._dummy(), "means", "training means, by input column", TypeConverters.toListFloat)
    stds = Param(Params._dummy(), "stds", "population stds, by input column", TypeConverters.toListFloat)


class PopulationScaler(Estimator, _ScalerParams, DefaultParamsReadable, DefaultParamsWritable):
    """The library's standardiser (population std) as a pipeline stage that
    can be stored."""

    @keyword_only
    def __init__(self, *, inputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset):
        cols = self.getInputCols()
        stats = fit_standardiser(dataset, cols)
        # a column without values or spread is divided by 1 later
        return PopulationScalerModel(inputCols=cols, means=[float(stats[c][0] or 0.0) for c in cols],
                                     stds=[float(stats[c][1] or 0.0) for c in cols])


class PopulationScalerModel(Transformer, _ScalerParams, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, *, inputCols=None, means=None, stds=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset):
        stats = zip(self.getInputCols(), zip(self.getOrDefault(self.means), self.getOrDefault(self.stds)))
        return apply_standardiser(dataset, dict(stats))


def build_pipeline(numeric, estimator, cluster: str | None = "cluster",
                   label: str = "label", scale: bool = True) -> Pipeline:
    """M4: impute(mean) -> scale -> + one-hot regime -> assemble -> model.
    ``scale=False`` for columns that are standardised already."""
    numeric = list(numeric)
    imp_out = [f"{c}__imp" for c in numeric]
    stages = [imputer(numeric, imp_out)]
    if scale:
        stages.append(PopulationScaler(inputCols=imp_out))
    stages.append(VectorAssembler(inputCols=imp_out, outputCol="num_scaled", handleInvalid="keep"))
    feats = ["num_scaled"]
    if cluster:
        stages += one_hot_stages(cluster, "cluster_vec")
        feats.append("cluster_vec")
    stages.append(VectorAssembler(inputCols=feats, outputCol="features"))
    estimator = estimator.setFeaturesCol("features").setLabelCol(label).setPredictionCol("prediction")
    stages.append(estimator)
    return Pipeline(stages=stages)


METRICS_SCHEMA = T.StructType([
    T.StructField("model", T.StringType()), T.StructField("method", T.StringType()),
    T.StructField("period", T.StringType()), T.StructField("n_train", T.LongType()),
    T.StructField("n_test", T.LongType()), T.StructField("mse", T.DoubleType()),
    T.StructField("r2", T.DoubleType()), T.StructField("mape", T.DoubleType()),
    T.StructField("train_seconds", T.DoubleType())])


def compare(df: DataFrame, numeric, label: str = "label", cluster: str | None = "cluster",
            split: str = "split", specs: dict | None = None, method: str = "",
            period: str = "", keep_predictions: bool = False):
    """Fit every model on ``split == 'train'`` rows, score the ``test``
    rows; returns the metrics table (and the prediction frames)."""
    specs = specs or model_specs()
    spark = df.sparkSession
    train = df.filter(F.col(split) == "train")
    test = df.filter(F.col(split) == "test")
    n_train, n_test = train.count(), test.count()
    rows, preds = [], {}
    for name, make in specs.items():
        est = make()
        pipe = build_pipeline(numeric, est, cluster, label)
        t0 = time.time()
        fitted = pipe.fit(train)
        secs = time.time() - t0          # E9: training time
        scored = fitted.transform(test)
        m = scored.agg(M.mse(label, "prediction").alias("mse"),
                       M.r2(label, "prediction").alias("r2"),
                       M.mape_fraction(label, "prediction").alias("mape")).first()
        rows.append((name, method, period, n_train, n_test, m["mse"], m["r2"], m["mape"], secs))
        if keep_predictions:
            preds[name] = scored
    table = spark.createDataFrame(rows, METRICS_SCHEMA)
    return (table, preds) if keep_predictions else table


def checkable(table: DataFrame, slack: float = 0.0) -> DataFrame:
    """What a metrics table must say whatever the engine's trees look like:
    the split's sizes, and that the model beats the mean (or, where the
    features say nothing of the label, comes within ``slack`` of its R2)."""
    return table.select("model", "n_train", "n_test", (F.col("r2") > -slack).alias("beats_mean"))
