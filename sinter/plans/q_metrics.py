"""Queries: error metrics, bins, result tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sinter.functions import metrics as M
from sinter.functions.clean import round6
from sinter.operators import evaluate as EV, profile as PR
from sinter.plans import fixtures as FX, oracle as O
from sinter.plans.catalog import register

MODELS = tuple(FX.MODEL_BY_FLAG.values())


def _r2_sql(a="actual", p="predicted"):
    sst = f"(var_pop({a}) * count({a}))"
    ssr = f"sum(power({a} - {p}, 2))"
    return f"(CASE WHEN {sst} = 0 THEN CASE WHEN {ssr} = 0 THEN 1.0 ELSE 0.0 END ELSE 1 - {ssr} / {sst} END)"


def _mape_pct_sql(a="actual", p="predicted"):
    return (f"(CASE WHEN count_if({a} = 0 AND {p} = 0) > 0 THEN NULL "
            f"WHEN count_if({a} = 0 AND {p} <> 0) > 0 THEN 'inf'::DOUBLE "
            f"ELSE avg(abs(({a} - {p}) / {a})) * 100 END)")


def _mape_eps_sql(a="actual", p="predicted"):
    return f"(avg(abs({a} - {p}) / greatest(abs({a}), 2.220446049250313e-16)) * 100)"


def _global_sql(where="TRUE"):
    return O.with_(O.PREDICTIONS) + f"""
SELECT model, count(*) AS n, round(avg(power(actual - predicted, 2)), 6) AS mse,
  round(sqrt(avg(power(actual - predicted, 2))), 6) AS rmse,
  round(avg(abs(actual - predicted)), 6) AS mae, round({_r2_sql()}, 6) AS r2,
  round({_mape_pct_sql()}, 6) AS mape_pct, round({_mape_eps_sql()}, 6) AS mape_eps,
  round(avg(CAST(actual BETWEEN lower AND upper AS DOUBLE)), 6) AS coverage
FROM preds WHERE {where} GROUP BY model"""


def _rounded(df, keep=("model", "n", "bin_mid")):
    return df.select(*[F.col(c) if c in keep else round6(c).alias(c) for c in df.columns])


@register("global_metrics", _global_sql(),
          covers=("A8", "E1", "E2", "E3", "E4", "E5", "E7", "E8"))
def global_metrics(spark, sf_dir):
    return _rounded(EV.metrics_table(FX.predictions(spark, sf_dir)))


@register("global_metrics_filtered", _global_sql("abs((actual - predicted) / actual) * 100 < 5"),
          covers=("A8", "F7"))
def global_metrics_filtered(spark, sf_dir):
    return _rounded(EV.metrics_table(FX.predictions(spark, sf_dir), ape_threshold=5.0))


@register("filter_counts", O.with_(O.PREDICTIONS) + """
SELECT model, count_if(abs((actual - predicted) / actual) * 100 < 5) AS kept,
  count_if(NOT (abs((actual - predicted) / actual) * 100 < 5)) AS dropped FROM preds GROUP BY model""",
          covers=("F7",))
def filter_counts(spark, sf_dir):
    return EV.filter_counts(FX.predictions(spark, sf_dir), 5.0)


@register("mape_variants", O.with_(O.ZEROS) + f"""
SELECT model, count(*) AS n, count_if(actual = 0) AS n_zero,
  round({_mape_pct_sql()}, 6) AS mape_pct,
  round(avg(CASE WHEN actual <> 0 THEN abs((actual - predicted) / actual) END), 6) AS mape_fraction,
  round({_mape_eps_sql()}, 6) AS mape_eps
FROM zt GROUP BY model""", covers=("E5", "E6", "E7"))
def mape_variants(spark, sf_dir):
    z = FX.zero_targets(spark, sf_dir)
    g = z.groupBy("model").agg(
        F.count(F.lit(1)).alias("n"), M.zero_actuals("actual").alias("n_zero"),
        M.mape_pct("actual", "predicted").alias("mape_pct"),
        M.mape_fraction("actual", "predicted").alias("mape_fraction"),
        M.mape_eps("actual", "predicted").alias("mape_eps"))
    return _rounded(g, keep=("model", "n", "n_zero"))


def _edges_cte(bins: int) -> str:
    return f"""
, rng AS (SELECT min(actual) AS mn, max(actual) AS mx FROM preds),
edges AS (SELECT list_transform(range({bins}), lambda i: CASE WHEN i = {bins - 1} THEN mx
                 ELSE mn + i * ((mx - mn) / {bins - 1}) END) AS e FROM rng),
binned AS (
  SELECT p.*, len(list_filter(e, lambda v: v < p.actual)) AS bin_idx, e FROM preds p, edges)"""


def _lbl(x):
    return f"(round_even(({x}) * 1000, 0) / 1000)"


def _binned_sql(bins: int) -> str:
    return O.with_(O.PREDICTIONS) + _edges_cte(bins) + f"""
SELECT model, 0.5 * ({_lbl('e[bin_idx]')} + {_lbl('e[bin_idx + 1]')}) AS bin_mid, count(*) AS n,
  round({_r2_sql()}, 6) AS r2, round({_mape_pct_sql()}, 6) AS mape_pct,
  round(sqrt(avg(power(actual - predicted, 2))), 6) AS rmse,
  round(avg(abs(actual - predicted)), 6) AS mae
FROM binned WHERE bin_idx BETWEEN 1 AND {bins - 1}
GROUP BY model, bin_idx, e HAVING count(*) >= 2"""


def _binned(spark, sf_dir, bins):
    b = EV.binned_metrics(FX.predictions(spark, sf_dir), bins=bins)
    return _rounded(b)


@register("binned_metrics_10", _binned_sql(10), covers=("A3", "A4", "A5", "A6", "A7"))
def binned_metrics_10(spark, sf_dir):
    return _binned(spark, sf_dir, 10)


@register("binned_metrics_30", _binned_sql(30), covers=("A4", "A5", "A6", "A7"))
def binned_metrics_30(spark, sf_dir):
    return _binned(spark, sf_dir, 30)


@register("bin_assignment", O.with_(O.PREDICTIONS) + _edges_cte(10) + f"""
SELECT model, actual, bin_idx, 0.5 * ({_lbl('e[bin_idx]')} + {_lbl('e[bin_idx + 1]')}) AS bin_mid
FROM binned WHERE bin_idx BETWEEN 1 AND 9""", covers=("A5", "A6"))
def bin_assignment(spark, sf_dir):
    p = FX.predictions(spark, sf_dir)
    lo, hi = EV.value_range(p)
    return EV.assign_bins(p, EV.linspace_edges(lo, hi, 10)).select("model", "actual", "bin_idx", "bin_mid")


@register("skipped_bins", O.with_(O.PREDICTIONS) + _edges_cte(400) + """
SELECT 400 AS bins, count(*) AS n_skipped FROM (
  SELECT model, bin_idx FROM binned WHERE bin_idx BETWEEN 1 AND 399 GROUP BY ALL HAVING count(*) < 2)""",
          covers=("A7",))
def skipped_bins(spark, sf_dir):
    n = EV.skipped_bins(FX.predictions(spark, sf_dir), bins=400)
    return spark.createDataFrame([(400, n)], "bins int, n_skipped long")


@register("value_range", O.with_(O.PREDICTIONS) + "SELECT min(actual) AS lo, max(actual) AS hi FROM preds",
          covers=("A3",))
def value_range(spark, sf_dir):
    p = FX.predictions(spark, sf_dir)
    lo, hi = EV.value_range(p)
    return spark.createDataFrame([(lo, hi)], "lo double, hi double")


@register("model_list", O.with_(O.PREDICTIONS) + "SELECT DISTINCT model FROM preds", covers=("A10",))
def model_list(spark, sf_dir):
    return PR.distinct_models(FX.predictions(spark, sf_dir))


@register("ranked_results", O.with_(O.PREDICTIONS) + """
, m AS (SELECT model, year(ts) AS dataset,
          avg(CASE WHEN actual <> 0 THEN abs((actual - predicted) / actual) END) AS mape
        FROM preds GROUP BY model, year(ts))
SELECT model, dataset, round(mape, 6) AS mape,
  row_number() OVER (PARTITION BY model ORDER BY mape, dataset) AS rank FROM m""",
          covers=("A11", "E6"))
def ranked_results(spark, sf_dir):
    p = FX.predictions(spark, sf_dir)
    m = p.groupBy("model", F.year("ts").alias("dataset")).agg(
        M.mape_fraction("actual", "predicted").alias("mape"))
    ranked = PR.rank_results(m, by=("model",), metric="mape", tie_break=("dataset",))
    return ranked.select("model", "dataset", round6("mape").alias("mape"), "rank")


@register("actual_vs_pred", O.with_(O.PREDICTIONS) + """
SELECT model, ts, actual, predicted FROM preds""", covers=("M12",))
def actual_vs_pred(spark, sf_dir):
    return EV.actual_vs_predicted(FX.predictions(spark, sf_dir))


@register("models_side_by_side", O.with_(O.PREDICTIONS) + """
SELECT date_trunc('day', ts) AS ts, """ + ", ".join(
    f"avg(predicted) FILTER (WHERE model = '{m}') AS {m}" for m in MODELS) + """
FROM preds WHERE ts >= TIMESTAMP '1996-03-01' AND ts < TIMESTAMP '1996-03-31' + INTERVAL 1 DAY
GROUP BY 1""", covers=("M13", "F9"))
def models_side_by_side(spark, sf_dir):
    p = FX.predictions(spark, sf_dir)
    return EV.side_by_side(p, MODELS, start="1996-03-01", end="1996-03-31")


@register("models_by_row", O.with_(O.PREDICTIONS) + """
SELECT ts, l_orderkey, l_linenumber, max(actual) AS actual, """ + ", ".join(
    f"max({v}) FILTER (WHERE model = '{m}') AS {v}_{m}" for m in MODELS for v in ("predicted", "lower", "upper")) + """
FROM preds GROUP BY ALL""", covers=("M13",))
def models_by_row(spark, sf_dir):
    return EV.side_by_side_rows(FX.predictions(spark, sf_dir), MODELS, index=("ts", "l_orderkey", "l_linenumber"))
