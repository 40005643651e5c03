"""Queries: cleaning, schema, filters, profiles (P*, F*, A1, A2, K9 slices)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sinter.functions import clean as C
from sinter.operators import filters as FL, profile as PR, schema as SC
from sinter.plans import fixtures as FX, oracle as O
from sinter.plans.catalog import register

MEASURES = ("quantity", "price", "discount", "tax")


def cleaned_lineitem(spark, sf_dir):
    """B1 cleaned back: parse the text date, coerce the text numbers."""
    m = FX.messy_lineitem(spark, sf_dir)
    return m.select("l_orderkey", "l_linenumber", "flag", "status",
                    C.parse_ts("ts_txt").alias("ts"),
                    *[C.clean_number(c).alias(c) for c in MEASURES])


def regime_profile(spark, sf_dir, months):
    c = cleaned_lineitem(spark, sf_dir)
    c = FL.month_between(c, "ts", *months)
    c = FL.drop_any_null(c, MEASURES)
    return PR.profile(c, by="flag", cols=MEASURES)


def _profile_sql(months):
    a, b = months
    where = f"month(ts) BETWEEN {a} AND {b} AND " + " AND ".join(f"{c} IS NOT NULL" for c in MEASURES)
    return O.with_(O.MESSY, O.CLEAN) + O.profile_sql("clean", "flag", MEASURES, where)


@register("regime_profile_mar_jun", _profile_sql((3, 6)),
          covers=("P9", "P12", "P13", "P14", "P15", "F3", "F1", "A1", "K9"))
def regime_profile_mar_jun(spark, sf_dir):
    return regime_profile(spark, sf_dir, (3, 6))


@register("regime_profile_ago_set", _profile_sql((8, 9)), covers=("F3", "A1", "K9"))
def regime_profile_ago_set(spark, sf_dir):
    return regime_profile(spark, sf_dir, (8, 9))


@register("clean_text", O.with_(O.MESSY, O.CLEAN) + "SELECT * FROM clean",
          covers=("P12", "P13", "P14", "P15", "P9"))
def clean_text(spark, sf_dir):
    return cleaned_lineitem(spark, sf_dir)


def _ts_texts(spark, sf_dir):
    li = FX.table(spark, sf_dir, "lineitem")
    k = F.col("l_orderkey")
    inferred = (F.when(k % 3 == 0, F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss"))
                .when(k % 3 == 1, F.date_format("l_shipdate", "yyyy-MM-dd"))
                .otherwise(F.concat(F.lit("x"), F.date_format("l_shipdate", "yyyy"))))
    return li.select("l_orderkey", "l_linenumber",
                     F.when(k % 37 == 0, F.lit("sem data"))
                     .otherwise(F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss.SSSSSS")).alias("ts_txt"),
                     inferred.alias("ts_inf"),
                     F.date_format("l_shipdate", "d/M/yyyy H:mm").alias("ts_dayfirst"))


_TS_SQL = """
WITH t AS (
  SELECT l_orderkey, l_linenumber,
    CASE WHEN l_orderkey % 37 = 0 THEN 'sem data'
         ELSE strftime(l_shipdate, '%Y-%m-%d %H:%M:%S.%f') END AS ts_txt,
    CASE l_orderkey % 3 WHEN 0 THEN strftime(l_shipdate, '%Y-%m-%d %H:%M:%S')
                        WHEN 1 THEN strftime(l_shipdate, '%Y-%m-%d')
                        ELSE 'x' || strftime(l_shipdate, '%Y') END AS ts_inf,
    strftime(l_shipdate, '%-d/%-m/%Y %-H:%M') AS ts_dayfirst
  FROM lineitem)
SELECT l_orderkey, l_linenumber, ts_txt,
  try_strptime(ts_txt, '%Y-%m-%d %H:%M:%S.%f') AS ts_explicit,
  coalesce(try_strptime(ts_inf, '%Y-%m-%d %H:%M:%S.%f'), try_strptime(ts_inf, '%Y-%m-%d %H:%M:%S'),
           try_strptime(ts_inf, '%Y-%m-%d %H:%M'), try_strptime(ts_inf, '%Y-%m-%d')) AS ts_inferred,
  strptime(ts_dayfirst, '%d/%m/%Y %H:%M') AS ts_dayfirst
FROM t
"""


@register("parse_timestamps", _TS_SQL, covers=("P9", "P10", "P11"))
def parse_timestamps(spark, sf_dir):
    t = _ts_texts(spark, sf_dir)
    return t.select("l_orderkey", "l_linenumber", "ts_txt",
                    C.parse_ts("ts_txt").alias("ts_explicit"),
                    C.parse_ts_any("ts_inf").alias("ts_inferred"),
                    C.parse_ts_strict("ts_dayfirst").alias("ts_dayfirst"))


_TEXT_COLS = ("flag", "status", "ts_txt", "quantity", "price", "discount", "tax")


def _castable_sql():
    parts = []
    for c in _TEXT_COLS:
        rep = f"replace({c}, ',', '.')"
        prepared = f"(CASE WHEN {rep} = {O.q(C.SENTINEL)} THEN NULL ELSE {rep} END)"
        num = (f"(CASE WHEN regexp_full_match(trim({prepared}), {O.q(C.NUMBER_PATTERN)}) "
               f"THEN TRY_CAST(trim({prepared}) AS DOUBLE) END)")
        parts.append(f"SELECT '{c}' AS column_name, count_if({prepared} IS NOT NULL AND {num} IS NULL) "
                     f"AS bad_cells FROM messy")
    inner = "\nUNION ALL\n".join(parts)
    return O.with_(O.MESSY) + f"SELECT column_name, bad_cells, bad_cells = 0 AS castable FROM ({inner}) u"


@register("castable_columns", _castable_sql(), covers=("P17",))
def castable_columns(spark, sf_dir):
    m = FX.messy_lineitem(spark, sf_dir).select(*_TEXT_COLS)
    bad, good = SC.bad_cells(m), SC.castable_columns(m)
    return spark.createDataFrame([(c, bad[c], good[c]) for c in _TEXT_COLS],
                                 "column_name string, bad_cells long, castable boolean")


@register("cast_castable", O.with_(O.MESSY) + f"""
SELECT flag, status, ts_txt, quantity,
  CAST({O.clean_num('price')} AS FLOAT) AS price,
  CAST({O.clean_num('discount')} AS FLOAT) AS discount, tax
FROM messy""", covers=("P17",))
def cast_castable(spark, sf_dir):
    m = FX.messy_lineitem(spark, sf_dir).select(*_TEXT_COLS)
    return SC.cast_castable(m, dtype="float")


@register("strict_cast", f"""
SELECT CAST(replace({O.dec_text('l_quantity')}, ',', '.') AS FLOAT) AS quantity,
       CAST(replace({O.dec_text('l_discount')}, ',', '.') AS FLOAT) AS discount,
       CAST(replace({O.dec_text('l_tax')}, ',', '.') AS FLOAT) AS tax
FROM lineitem""", covers=("P16",))
def strict_cast(spark, sf_dir):
    li = FX.table(spark, sf_dir, "lineitem")
    t = li.select(FX.decimal_text("l_quantity").alias("quantity"),
                  FX.decimal_text("l_discount").alias("discount"),
                  FX.decimal_text("l_tax").alias("tax"))
    return SC.strict_cast_all(t, dtype="float")


@register("drop_null_columns", O.with_(O.MESSY) + f"""
SELECT CAST(l_orderkey AS DOUBLE) AS l_orderkey, ts_txt,
  {O.clean_num('quantity')} AS quantity, {O.clean_num('price')} AS price,
  {O.clean_num('discount')} AS discount, {O.clean_num('tax')} AS tax,
  CAST(NULL AS TIMESTAMP) AS inicio_dt, CAST(NULL AS TIMESTAMP) AS fim_dt, 'all' AS period
FROM messy""", covers=("P3", "P4", "P18", "P19"))
def drop_null_columns(spark, sf_dir):
    m = FX.messy_lineitem(spark, sf_dir).withColumn("fim", F.col("ts_txt"))
    c = SC.coerce_all(m, exclude=("ts_txt",))        # text date 'fim' -> all null
    c = SC.drop_all_null_columns(c)                   # drops fim, flag, status
    c = SC.drop_if_present(c, "l_linenumber", "not_there")
    c = SC.add_null_timestamps(c, ("inicio_dt", "fim_dt"))
    return SC.tag(c, period="all")


_RENAME = {"click_mediana": "cliques_mediana", "view_mediana": "visitas_mediana",
           "TO_NOT_PRESENT": "ignored"}


@register("rename_select", O.with_(O.blocks("1 hour")) + """
SELECT ts, click_mediana AS cliques_mediana, error_mediana, signup_mediana,
       view_mediana AS visitas_mediana, purchase_laudo FROM blocks""",
          covers=("P1", "P5", "P6"))
def rename_select(spark, sf_dir):
    b = SC.rename(FX.block_table(spark, sf_dir), _RENAME)
    feats = SC.suffix_columns(b, "_mediana", exclude=("purchase_laudo",))
    nums = SC.numeric_columns(b.select(*feats, "purchase_laudo"))
    return b.select("ts", *nums)


@register("error_columns", O.with_(O.PREDICTIONS) + """
SELECT ts, model, actual, predicted, round(power(actual - predicted, 2), 6) AS squared_error,
  round(abs(actual - predicted), 6) AS abs_error,
  round(abs((actual - predicted) / actual) * 100, 6) AS ape
FROM preds""", covers=("P20",))
def error_columns(spark, sf_dir):
    p = SC.error_columns(FX.predictions(spark, sf_dir))
    return p.select("ts", "model", "actual", "predicted",
                    *[C.round6(c).alias(c) for c in ("squared_error", "abs_error", "ape")])


_SENS_RULES = {"click": 100.0, "view": 100.0}


@register("threshold_mask", O.with_(O.HOURLY_ZEROS) + """
SELECT ts, CASE WHEN click > 0 THEN click END AS click, CASE WHEN error > 0 THEN error END AS error,
  CASE WHEN purchase > 0 THEN purchase END AS purchase, CASE WHEN signup > 0 THEN signup END AS signup,
  CASE WHEN view > 0 THEN view END AS view
FROM hourly
WHERE click > 100 AND view > 100 AND click IS NOT NULL AND error IS NOT NULL
  AND purchase IS NOT NULL AND signup IS NOT NULL AND view IS NOT NULL""",
          covers=("F4", "F5", "F1"))
def threshold_mask(spark, sf_dir):
    h = FX.hourly_sensors(spark, sf_dir, plant_zeros=True)
    h = FL.threshold_rows(h, _SENS_RULES)
    h = FL.drop_any_null(h)
    return FL.mask_non_positive(h, FX.SENSORS)


_FEATS = ("click_mediana", "error_mediana", "signup_mediana", "view_mediana")


@register("complete_case_audit", O.with_(O.blocks("1 hour")) + f"""
SELECT count(*) AS blocks, count_if(purchase_laudo IS NOT NULL) AS with_target,
  count_if(purchase_laudo IS NULL) AS without_target,
  count_if(purchase_laudo IS NOT NULL AND ({' OR '.join(f'{c} IS NULL' for c in _FEATS)})) AS dropped_null_sensor,
  count_if(purchase_laudo IS NOT NULL AND NOT ({' OR '.join(f'{c} IS NULL' for c in _FEATS)})) AS kept
FROM blocks""", covers=("F6",))
def complete_case_audit(spark, sf_dir):
    return FL.complete_case_audit(FX.block_table(spark, sf_dir), "purchase_laudo", _FEATS)


@register("complete_cases", O.with_(O.blocks("1 hour")) + f"""
SELECT * FROM blocks WHERE purchase_laudo IS NOT NULL AND {' AND '.join(f'{c} IS NOT NULL' for c in _FEATS)}""",
          covers=("F6", "F2"))
def complete_cases(spark, sf_dir):
    return FL.complete_cases(FX.block_table(spark, sf_dir), "purchase_laudo", _FEATS)


@register("mape_filter", O.with_(O.PREDICTIONS) + """
SELECT ts, model, actual, predicted FROM preds WHERE abs((actual - predicted) / actual) * 100 < 5""",
          covers=("F7",))
def mape_filter(spark, sf_dir):
    p = FL.ape_below(FX.predictions(spark, sf_dir), 5.0)
    return p.select("ts", "model", "actual", "predicted")


@register("first_week", O.with_(O.PREDICTIONS) + """
SELECT ts, model, actual, predicted FROM preds
WHERE ts >= (SELECT min(ts) FROM preds) AND ts < (SELECT min(ts) FROM preds) + INTERVAL 7 DAY""",
          covers=("F8", "W1"))
def first_week(spark, sf_dir):
    p = FL.first_week(FX.predictions(spark, sf_dir), "ts", 7)
    return p.select("ts", "model", "actual", "predicted")


@register("date_slice", O.with_(O.PREDICTIONS) + """
SELECT ts, model, actual, predicted FROM preds
WHERE ts >= TIMESTAMP '1996-03-01' AND ts < TIMESTAMP '1996-03-02' + INTERVAL 1 DAY""",
          covers=("F9",))
def date_slice(spark, sf_dir):
    p = FL.date_slice(FX.predictions(spark, sf_dir), "ts", "1996-03-01", "1996-03-02")
    return p.select("ts", "model", "actual", "predicted")


@register("survivor_rows", O.with_(O.MESSY) + f"""
SELECT * FROM messy WHERE {O.clean_num('quantity')} IS NOT NULL AND {O.clean_num('price')} IS NOT NULL
  AND {O.clean_num('discount')} IS NOT NULL AND {O.clean_num('tax')} IS NOT NULL""",
          covers=("F10", "F2"))
def survivor_rows(spark, sf_dir):
    m = FX.messy_lineitem(spark, sf_dir)
    num = {f"_n_{c}": C.clean_number(c) for c in MEASURES}
    kept = FL.drop_any_null(m.withColumns(num), list(num))
    return kept.drop(*num)


@register("period_stats", O.with_(O.MESSY, O.CLEAN) + f"""
SELECT count(*) AS rows, CAST(min(ts) AS DATE) AS first_day, CAST(max(ts) AS DATE) AS last_day
FROM clean WHERE month(ts) BETWEEN 3 AND 6 AND {' AND '.join(f'{c} IS NOT NULL' for c in MEASURES)}""",
          covers=("A2",))
def period_stats(spark, sf_dir):
    c = FL.month_between(cleaned_lineitem(spark, sf_dir), "ts", 3, 6)
    return PR.period_stats(FL.drop_any_null(c, MEASURES), "ts")
