"""Queries: features, conformal intervals, models."""

from __future__ import annotations

from pyspark.sql import functions as F

from sinter.functions import metrics as M
from sinter.functions.clean import round6
from sinter.operators import boosting as BO, conformal as CF, features as FE, models as MD, split as SP
from sinter.plans import fixtures as FX, oracle as O
from sinter.plans.catalog import register
from sinter.session import scratch_path
from sinter.sources import sinks as K

SENS = FX.SENSORS


def _hourly_split(spark, sf_dir):
    h = FX.hourly_sensors(spark, sf_dir)
    return SP.chrono_split(h, ["ts"], test_frac=0.2)


_HOURLY_TRAIN = O.with_(O.HOURLY) + """
, r AS (SELECT *, row_number() OVER (ORDER BY ts) AS rn, count(*) OVER () AS n FROM hourly),
tr AS (SELECT * FROM r WHERE rn <= n - CAST(ceil(0.2 * n) AS BIGINT))"""


def _std_sql():
    stats = ", ".join(f"avg({s}) AS m_{s}, stddev_pop({s}) AS s_{s}" for s in SENS)
    cols = ", ".join(
        f"round(({s} - m_{s}) / CASE WHEN s_{s} = 0 OR s_{s} IS NULL THEN 1 ELSE s_{s} END, 6) AS {s}"
        for s in SENS)
    return _HOURLY_TRAIN + f", st AS (SELECT {stats} FROM tr)\nSELECT ts, {cols} FROM r, st"


@register("standardise", _std_sql(), covers=("M1", "W7"))
def standardise(spark, sf_dir):
    s = _hourly_split(spark, sf_dir)
    stats = FE.fit_standardiser(s, SENS, where=F.col("split") == "train")
    z = FE.apply_standardiser(s, stats)
    return z.select("ts", *[round6(c).alias(c) for c in SENS])


def _impute_sql():
    stats = ", ".join(f"avg({s}) AS m_{s}" for s in SENS)
    cols = ", ".join(f"round(coalesce({s}, m_{s}), 6) AS {s}" for s in SENS)
    return _HOURLY_TRAIN + f", st AS (SELECT {stats} FROM tr)\nSELECT ts, {cols} FROM r, st"


@register("impute_mean", _impute_sql(), covers=("M2",))
def impute_mean(spark, sf_dir):
    s = _hourly_split(spark, sf_dir)
    model = FE.imputer(SENS).fit(s.filter(F.col("split") == "train"))
    z = model.transform(s)
    return z.select("ts", *[round6(c).alias(c) for c in SENS])


@register("one_hot_cluster", O.with_(O.REGRESSION) + """
SELECT cluster, CAST(cluster = 0 AS DOUBLE) AS cluster_0, CAST(cluster = 1 AS DOUBLE) AS cluster_1,
  count(*) AS n FROM reg GROUP BY ALL""", covers=("M3",))
def one_hot_cluster(spark, sf_dir):
    r = FX.planted_regression(spark, sf_dir)
    levels = FE.fit_levels(r, "cluster", where=F.col("cluster") < 2)   # regime 2 unseen
    z = FE.apply_one_hot(r, levels)
    return z.groupBy("cluster", *[f"cluster_{v}" for v in levels]).agg(F.count(F.lit(1)).alias("n"))


@register("linear_fit", O.with_(O.REGRESSION) + """
SELECT round(regr_slope(label, quantity), 6) AS slope, round(regr_intercept(label, quantity), 6) AS intercept,
  count(*) AS n FROM reg""", covers=("M8",))
def linear_fit(spark, sf_dir):
    from pyspark.ml.feature import VectorAssembler
    r = FX.planted_regression(spark, sf_dir)
    v = VectorAssembler(inputCols=["quantity"], outputCol="features").transform(r)
    fitted = MD.linear_model().setLabelCol("label").fit(v)
    n = fitted.summary.numInstances
    return spark.createDataFrame(
        [(float(fitted.coefficients[0]), float(fitted.intercept), int(n))],
        "slope double, intercept double, n long").select(
        round6("slope").alias("slope"), round6("intercept").alias("intercept"), "n")


def _conformal_split(spark, sf_dir):
    """Per model: test = last ceil(0.2 n) rows by time, cal = last
    ceil(0.1 n_train) of the rest (W7, W8 per group)."""
    p = FX.event_predictions(spark, sf_dir)
    return SP.keyed_chrono_split(p, ["ts", "event_id"], "model", test_frac=0.2, cal_frac=0.1)


_CONF_SQL = O.with_(O.EVENT_PREDS) + """
, r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY ts, event_id) AS rn,
               count(*) OVER (PARTITION BY model) AS n FROM epreds),
s AS (SELECT *, n - CAST(ceil(n * 0.2) AS BIGINT) AS n_train FROM r),
l AS (SELECT *, CASE WHEN rn > n_train THEN 'test'
                     WHEN rn > n_train - CAST(ceil(n_train * 0.1) AS BIGINT) THEN 'cal' ELSE 'train' END AS split
      FROM s),
cal AS (SELECT model, abs(actual - predicted) AS res,
               row_number() OVER (PARTITION BY model ORDER BY abs(actual - predicted)) - 1 AS i,
               count(*) OVER (PARTITION BY model) AS n_cal FROM l WHERE split = 'cal'),
lv AS (SELECT DISTINCT model, n_cal,
         ceil((n_cal + 1) * (1.0::DOUBLE - 0.05::DOUBLE)) / n_cal AS level FROM cal),
pos AS (SELECT model, n_cal, level, level * (n_cal - 1) AS x FROM lv),
q AS (SELECT p.model, p.n_cal, p.level,
        max(CASE WHEN c.i = floor(p.x) THEN c.res END) AS lo_v,
        max(CASE WHEN c.i = ceil(p.x) THEN c.res END) AS hi_v, max(p.x) AS x
      FROM pos p JOIN cal c ON c.model = p.model GROUP BY p.model, p.n_cal, p.level),
qh AS (SELECT model, n_cal, level, lo_v + (x - floor(x)) * (hi_v - lo_v) AS q_hat FROM q)
SELECT qh.model, qh.n_cal, round(qh.level, 6) AS level, round(qh.q_hat, 6) AS q_hat,
  count(*) AS n_test,
  round(avg(CAST(t.actual BETWEEN t.predicted - qh.q_hat AND t.predicted + qh.q_hat AS DOUBLE)), 6) AS coverage
FROM qh JOIN l t ON t.model = qh.model AND t.split = 'test'
GROUP BY qh.model, qh.n_cal, qh.level, qh.q_hat"""


@register("conformal_intervals", _CONF_SQL, covers=("M9", "W8", "E8"))
def conformal_intervals(spark, sf_dir):
    p = _conformal_split(spark, sf_dir)
    q = CF.q_hat(p.filter(F.col("split") == "cal"), by=["model"], alpha=0.05)
    t = CF.intervals(p.filter(F.col("split") == "test"), q)
    cov = t.groupBy("model").agg(F.count(F.lit(1)).alias("n_test"),
                                 M.coverage("actual", "lower", "upper").alias("coverage"))
    return (q.join(cov, "model")
            .select("model", "n_cal", round6("level").alias("level"), round6("q_hat").alias("q_hat"),
                    "n_test", round6("coverage").alias("coverage")))


FEATURES = ("quantity", "discount", "tax")


def _seeded_regression(spark, sf_dir):
    r = FX.planted_regression(spark, sf_dir)
    s = SP.seeded_split(r, "row_id", test_frac=0.3, seed=42)
    return s.checkpoint(eager=True)     # split once, reused by every model


_SPLIT_SIZES = O.with_(O.REGRESSION) + """
, s AS (SELECT count(*) AS n FROM reg)
SELECT m.model, CAST(n - ceil(n * 0.3) AS BIGINT) AS n_train, CAST(ceil(n * 0.3) AS BIGINT) AS n_test,
  true AS beats_mean FROM s, (VALUES {models}) m(model)"""


@register("compare_models", _SPLIT_SIZES.format(models="('GradientBoosting'), ('Linear')"), covers=("M4", "M6", "M8", "M10", "W9", "E1", "E4", "E6", "E9"))
def compare_models(spark, sf_dir):
    """Boosting defaults and OLS on the same seeded split; the full union
    grid (forest 300, booster 400) is ``MD.model_specs('union')``."""
    specs = {"GradientBoosting": MD.model_specs("union")["GradientBoosting"],
             "Linear": MD.linear_model}
    return MD.checkable(MD.compare(_seeded_regression(spark, sf_dir), FEATURES, label="label",
                                   cluster="cluster", specs=specs, method="returnflag", period="all"))


@register("forest_model", _SPLIT_SIZES.format(models="('RandomForest')"), covers=("M4", "M5", "M10"))
def forest_model(spark, sf_dir):
    """The conformal grid's forest (100 trees) on the seeded split."""
    specs = {"RandomForest": MD.model_specs("conformal", rf_depth=8, id_col="row_id")["RandomForest"]}
    return MD.checkable(MD.compare(_seeded_regression(spark, sf_dir), FEATURES, label="label",
                                   cluster="cluster", specs=specs, method="returnflag", period="all"))


# candidate cuts of the three measures and the regime, and one tree's settings
TREE_EDGES = [[i + 0.5 for i in range(1, 50)], [i / 100 + 0.005 for i in range(10)],
              [i / 100 + 0.005 for i in range(8)], [0.5, 1.5]]
TREE_RATE, TREE_LAMBDA, TREE_SEED, TREE_ROWS = 0.05, 1.0, 42, 0.8


def _tree_sql() -> str:
    """One tree of two levels: rows drawn by the mixed key, then sums left of
    every cut, the best cut of the root and of its children."""
    salt = int(BO.mix32((TREE_SEED * 1_000_003) & 0xFFFFFFFF))
    mix = "k{i} AS (SELECT * EXCLUDE (u), {e} AS u FROM k{j})"
    steps = ["xor(u, u >> 16)", "(u * 2146121005::UBIGINT) & 4294967295::UBIGINT", "xor(u, u >> 15)",
             "(u * 2221713035::UBIGINT) & 4294967295::UBIGINT", "xor(u, u >> 16)"]
    mixed = ",\n".join(mix.format(i=i + 1, j=i, e=e) for i, e in enumerate(steps))
    cuts = ", ".join(f"({j}, {i}, {e!r}::DOUBLE)" for j, es in enumerate(TREE_EDGES) for i, e in enumerate(es))
    lam = TREE_LAMBDA

    def best(name, source, node):
        return f"""
{name}_s AS (SELECT {node} AS node, c.col, c.cut, c.edge, sum(g) AS g, count(*) AS h,
    coalesce(sum(g) FILTER (x[c.col + 1] < c.edge), 0) AS lg, count(*) FILTER (x[c.col + 1] < c.edge) AS lh
  FROM {source}, cuts c GROUP BY ALL),
{name} AS (SELECT *, lg * lg / (lh + {lam}) + (g - lg) * (g - lg) / (h - lh + {lam}) - g * g / (h + {lam}) AS gain
  FROM {name}_s WHERE lh >= 1 AND h - lh >= 1
  QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, col, cut) = 1)"""

    return O.with_() + f"""
cuts AS (SELECT * FROM (VALUES {cuts}) v(col, cut, edge)),
src AS (SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS key,
    [l_quantity, l_discount, l_tax,
     CASE l_returnflag WHEN 'A' THEN 0.0 WHEN 'N' THEN 1.0 ELSE 2.0 END]::DOUBLE[] AS x,
    2 * l_quantity + 100 * l_discount + CASE WHEN l_returnflag = 'R' THEN 20.0 ELSE 0.0 END
      + (l_partkey % 11) - 5 AS label FROM lineitem),
base AS (SELECT avg(label) AS base FROM src),
k0 AS (SELECT x, base - label AS g, xor(CAST(('0x' || substr(md5(key), 1, 8)) AS UBIGINT), {salt}::UBIGINT) AS u
       FROM src, base),
{mixed},
drawn AS (SELECT x, g FROM k5 WHERE u < {round(TREE_ROWS * 2 ** 32)}::UBIGINT),
{best("root", "drawn", "0")},
child AS (SELECT d.x, d.g, CASE WHEN d.x[r.col + 1] < r.edge THEN 1 ELSE 2 END AS node FROM drawn d, root r),
{best("kids", "child", "node")},
leaf AS (SELECT CASE WHEN c.x[k.col + 1] < k.edge THEN 2 * c.node + 1 ELSE 2 * c.node + 2 END AS node,
  sum(c.g) AS g, count(*) AS h FROM child c JOIN kids k ON k.node = c.node GROUP BY 1)
SELECT node, CAST(col AS BIGINT) AS split_column, edge, CAST(h AS BIGINT) AS n_rows, round(gain / h, 6) AS gain,
  round(-{TREE_RATE} * g / (h + {lam}), 6) AS value FROM (SELECT * FROM root UNION ALL SELECT * FROM kids)
UNION ALL SELECT node, -1, NULL, h, 0.0, round(-{TREE_RATE} * g / (h + {lam}), 6) FROM leaf"""


@register("booster_tree", _tree_sql(), covers=("M7",))
def booster_tree(spark, sf_dir):
    """Splits, gains and leaf values of a sampled first tree of two levels."""
    r = FX.planted_regression(spark, sf_dir, keep=("l_orderkey", "l_linenumber")).select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("key"), "label",
        F.array(*[F.col(c).cast("double") for c in (*FEATURES, "cluster")]).alias("features"))
    booster = BO.HistogramBooster(maxIter=1, stepSize=TREE_RATE, maxDepth=2, subsamplingRate=TREE_ROWS,
                                  regLambda=TREE_LAMBDA, seed=TREE_SEED, idCol="key", edges=TREE_EDGES)
    t = booster.grown(r)[1][0]
    rows = [(i, int(t.column[i]), TREE_EDGES[t.column[i]][t.cut[i]] if t.column[i] >= 0 else None, int(t.h[i]),
             float(t.gain[i]) / int(t.h[i]) if t.h[i] else 0.0, float(t.value[i]))
            for i in range(len(t.column)) if t.h[i]]
    out = spark.createDataFrame(rows, "node int, split_column long, edge double, n_rows long, gain double, value double")
    return out.withColumns({"gain": round6("gain"), "value": round6("value")})


@register("booster_model", _SPLIT_SIZES.format(models="('XGBoost')"), covers=("M4", "M7", "M10"))
def booster_model(spark, sf_dir):
    """The union grid's booster: 400 trees of depth 6, rate 0.05, 0.8 of the
    rows and columns for each tree."""
    specs = {"XGBoost": MD.model_specs("union", id_col="row_id")["XGBoost"]}
    return MD.checkable(MD.compare(_seeded_regression(spark, sf_dir), FEATURES, label="label",
                                   cluster="cluster", specs=specs, method="returnflag", period="all"))


@register("saved_pipeline", O.with_(O.REGRESSION) + """
SELECT count(*) AS n_rows, count(*) AS n_equal FROM reg""", covers=("S11", "M4"))
def saved_pipeline(spark, sf_dir):
    """A fitted pipeline that was stored and loaded again scores every row
    as it did before."""
    r = FX.planted_regression(spark, sf_dir)
    fitted = MD.build_pipeline(("quantity", "discount", "tax"), MD.linear_model()).fit(r)
    path = scratch_path(spark, "saved_pipeline")
    K.save_model(fitted, path)
    scored = K.load_model(path).transform(fitted.transform(r).select(
        *r.columns, F.col("prediction").alias("before")))
    return scored.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("before") == F.col("prediction")).alias("n_equal"))
