"""DuckDB SQL for the correctness gate.

The same fixtures as ``sinter.plans.fixtures`` written as SQL common table
expressions over the pre-registered views, and the SQL text of each query.
"""

from __future__ import annotations

from sinter.functions.clean import NUMBER_PATTERN, SENTINEL
from sinter.plans.fixtures import (MODEL_BY_FLAG, SENSORS, STRIP_GAP, STRIP_NOISE_EVERY,
                                   STRIP_SEGMENT, STRIP_STEP)


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def dec_text(x: str) -> str:
    return f"replace(CAST(CAST({x} AS DECIMAL(14, 2)) AS VARCHAR), '.', ',')"


def clean_num(x: str) -> str:
    """SQL twin of ``clean.clean_number``."""
    rep = f"replace({x}, ',', '.')"
    sent = f"(CASE WHEN {rep} = {q(SENTINEL)} THEN NULL ELSE {rep} END)"
    blank = f"nullif(trim({sent}), '')"
    return (f"(CASE WHEN regexp_full_match(trim({blank}), {q(NUMBER_PATTERN)}) "
            f"THEN TRY_CAST(trim({blank}) AS DOUBLE) END)")


def rnd3(x: str) -> str:
    return f"(round_even(({x}) * 1000, 0) / 1000)"


def r6(x: str) -> str:
    return f"round({x}, 6)"


MESSY = f"""messy AS (
  SELECT l_orderkey, l_linenumber, l_returnflag AS flag, l_linestatus AS status,
    CASE WHEN l_orderkey % 37 = 0 THEN 'sem data'
         ELSE strftime(l_shipdate, '%Y-%m-%d %H:%M:%S.%f') END AS ts_txt,
    CASE WHEN l_orderkey % 23 = 0 THEN '   ' ELSE {dec_text('l_quantity')} END AS quantity,
    CASE WHEN l_orderkey % 17 = 0 THEN {q(SENTINEL)} ELSE {dec_text('l_extendedprice')} END AS price,
    {dec_text('l_discount')} AS discount,
    CASE WHEN l_orderkey % 31 = 0 THEN '1d' ELSE {dec_text('l_tax')} END AS tax
  FROM lineitem)"""

CLEAN = f"""clean AS (
  SELECT l_orderkey, l_linenumber, flag, status,
    try_strptime(ts_txt, '%Y-%m-%d %H:%M:%S.%f') AS ts,
    {clean_num('quantity')} AS quantity, {clean_num('price')} AS price,
    {clean_num('discount')} AS discount, {clean_num('tax')} AS tax
  FROM messy)"""

MEASURES = ("quantity", "price", "discount", "tax")


def _model_case(col: str = "l_returnflag") -> str:
    whens = " ".join(f"WHEN {col} = {q(k)} THEN {q(v)}" for k, v in MODEL_BY_FLAG.items())
    return f"CASE {whens} ELSE 'Outro' END"


HOURLY = "hourly AS (\n  SELECT date_trunc('hour', ts) AS ts, " + ", ".join(
    f"median(value) FILTER (WHERE event_type = {q(s)}) AS {s}" for s in SENSORS) + \
    "\n  FROM events GROUP BY 1)"

HOURLY_ZEROS = "hourly AS (\n  SELECT date_trunc('hour', ts) AS ts, " + ", ".join(
    f"median(CASE WHEN event_id % 29 = 0 THEN 0.0 ELSE value END) "
    f"FILTER (WHERE event_type = {q(s)}) AS {s}" for s in SENSORS) + \
    "\n  FROM events GROUP BY 1)"

IRREGULAR = """series AS (
  SELECT event_id, ts, event_type, CASE WHEN event_id % 7 <> 0 THEN value END AS value
  FROM events)"""

PREDICTIONS = f"""preds AS (
  SELECT l_shipdate AS ts, {_model_case()} AS model, l_orderkey, l_linenumber,
    l_extendedprice AS actual,
    l_extendedprice * (1.0 + ((l_partkey % 21) - 10) / 100.0) AS predicted,
    l_extendedprice * (1.0 + ((l_partkey % 21) - 10) / 100.0) - 4000.0 AS lower,
    l_extendedprice * (1.0 + ((l_partkey % 21) - 10) / 100.0) + 4000.0 AS upper
  FROM lineitem)"""

ZEROS = """zt AS (
  SELECT c_custkey, c_mktsegment AS model,
    CASE WHEN c_custkey % 50 = 0 THEN 0.0 ELSE c_acctbal END AS actual,
    c_acctbal * (1.0 + ((c_custkey % 11) - 5) / 100.0) AS predicted
  FROM customer)"""

STRIPS = f"""strips AS (
  SELECT event_id AS row_id,
    CASE WHEN event_id % {STRIP_NOISE_EVERY} = 0 THEN 500.0 + event_id
         ELSE (event_id // 4) * {STRIP_STEP} + ((event_id // 4) // {STRIP_SEGMENT}) * {STRIP_GAP} END AS x,
    CASE WHEN event_id % {STRIP_NOISE_EVERY} = 0 THEN -500.0
         ELSE (event_id % 4) * 10.0 + ((event_id * 7919) % 1000) / 5000.0 END AS y
  FROM events)"""

REGRESSION = """reg AS (
  SELECT l_shipdate AS ts, l_quantity AS quantity, l_discount AS discount, l_tax AS tax,
    CASE WHEN l_returnflag = 'A' THEN 0 WHEN l_returnflag = 'N' THEN 1 ELSE 2 END AS cluster,
    CAST(2 * l_quantity + 100 * l_discount + CASE WHEN l_returnflag = 'R' THEN 20.0 ELSE 0.0 END
         + (l_partkey % 11) - 5 AS DOUBLE) AS label
  FROM lineitem)"""


def blocks(every_sql: str = "1 hour") -> str:
    cols = ", ".join(
        f"median(value) FILTER (WHERE event_type = {q(s)}) AS {s}_mediana"
        for s in SENSORS if s != "purchase")
    return (f"blocks AS (\n  SELECT time_bucket(INTERVAL '{every_sql}', ts) AS ts, {cols}, "
            f"median(value) FILTER (WHERE event_type = 'purchase') AS purchase_laudo\n"
            f"  FROM events GROUP BY 1)")


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def profile_sql(src: str, by: str, cols, where: str = "TRUE") -> str:
    parts = []
    for c in cols:
        parts += [f"count({c}) AS {c}_count", f"{rnd3(f'avg({c})')} AS {c}_mean",
                  f"{rnd3(f'stddev_samp({c})')} AS {c}_std", f"{rnd3(f'median({c})')} AS {c}_median"]
    return f"SELECT {by}, " + ", ".join(parts) + f" FROM {src} WHERE {where} GROUP BY {by}"

EVENT_PREDS = """epreds AS (
  SELECT event_id, ts, event_type AS model, value AS actual,
    value * (1.0 + ((user_id % 21) - 10) / 100.0) AS predicted
  FROM events)"""
