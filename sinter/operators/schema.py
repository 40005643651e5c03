"""Projection, cleaning and schema operators.

Column lists are read from the schema on the driver (metadata only); any
check that needs the data (all-null columns, castable columns) is a single
aggregate pass with one partial row per map task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from sinter.functions import clean as C

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType,
                 T.FloatType, T.DoubleType, T.DecimalType)


def rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Rename by dictionary; keys not in the table are ignored."""
    present = {k: v for k, v in mapping.items() if k in df.columns}
    return df.withColumnsRenamed(present) if present else df


def alias_cluster(df: DataFrame) -> DataFrame:
    """Accept ``cluster_label`` as the regime column."""
    if "cluster_label" in df.columns and "cluster" not in df.columns:
        return df.withColumnRenamed("cluster_label", "cluster")
    return df


def require(df: DataFrame, *cols: str) -> None:
    """Fail early with the missing names."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")


def detect_column(df: DataFrame, candidates=("inicio_dt", "inicio")) -> str:
    """First candidate present, else an error."""
    for c in candidates:
        if c in df.columns:
            return c
    raise ValueError(f"none of the date columns {list(candidates)} is present")


def drop_if_present(df: DataFrame, *cols: str) -> DataFrame:
    """Drop, ignoring absent names."""
    return df.drop(*[c for c in cols if c in df.columns])


def null_counts(df: DataFrame, cols=None) -> dict[str, int]:
    """Non-null count of every column in one aggregate pass."""
    cols = list(cols or df.columns)
    row = df.agg(*[F.count(F.col(c)).alias(c) for c in cols]).first()
    return {c: row[c] for c in cols}


def all_null_columns(df: DataFrame, cols=None) -> list[str]:
    counts = null_counts(df, cols)
    return [c for c, n in counts.items() if n == 0]


def drop_all_null_columns(df: DataFrame, keep=()) -> DataFrame:
    """Drop columns with no value at all (one pass)."""
    empty = [c for c in all_null_columns(df) if c not in keep]
    return df.drop(*empty) if empty else df


def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    """P5: numeric columns by type."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NUMERIC_TYPES) and f.name not in exclude]


def suffix_columns(df: DataFrame, suffix: str, exclude=()) -> list[str]:
    """Columns ending with a suffix, minus the excluded (target)."""
    return [c for c in df.columns if c.endswith(suffix) and c not in exclude]


def string_columns(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.StringType) and f.name not in exclude]


def clean_text_columns(df: DataFrame, exclude=(), sentinels=(C.SENTINEL,)) -> DataFrame:
    """P12-P15 on every string column but the excluded ones: one projection."""
    targets = set(string_columns(df, exclude))
    return df.select(*[C.clean_number(c, sentinels).alias(c) if c in targets else F.col(c)
                       for c in df.columns])


def coerce_all(df: DataFrame, exclude=(), sentinels=(C.SENTINEL,)) -> DataFrame:
    """Every column but the excluded becomes double, bad cells null.

    A non-string column is cast with ``try_cast``; a text date column that
    is not excluded therefore becomes all-null, as in the reference.
    """
    out = []
    for f in df.schema.fields:
        if f.name in exclude:
            out.append(F.col(f.name))
        elif isinstance(f.dataType, T.StringType):
            out.append(C.clean_number(f.name, sentinels).alias(f.name))
        elif isinstance(f.dataType, NUMERIC_TYPES):
            out.append(F.col(f.name).cast("double").alias(f.name))
        else:
            out.append(F.lit(None).cast("double").alias(f.name))
    return df.select(*out)


def bad_cells(df: DataFrame, cols=None, sentinels=(C.SENTINEL,)) -> dict[str, int]:
    """Cells of each text column that aren't numbers, in one pass:
    ``count_if(cell is not null and number(cell) is null)``."""
    cols = list(cols or string_columns(df))
    prepared = {c: C.null_sentinels(C.decimal_comma(c), sentinels) for c in cols}
    row = df.agg(*[F.count_if(prepared[c].isNotNull() & C.to_number(prepared[c]).isNull())
                   .alias(c) for c in cols]).first()
    return {c: row[c] for c in cols}


def castable_columns(df: DataFrame, cols=None, sentinels=(C.SENTINEL,)) -> dict[str, bool]:
    """A text column is numeric iff every non-null cell parses."""
    return {c: n == 0 for c, n in bad_cells(df, cols, sentinels).items()}


def cast_castable(df: DataFrame, cols=None, dtype: str = "float",
                  sentinels=(C.SENTINEL,)) -> DataFrame:
    """Cast only the fully castable text columns (float32 by default)."""
    ok = {c for c, good in castable_columns(df, cols, sentinels).items() if good}
    return df.select(*[C.to_number(C.null_sentinels(C.decimal_comma(c), sentinels))
                       .cast(dtype).alias(c) if c in ok else F.col(c) for c in df.columns])


def strict_cast_all(df: DataFrame, exclude=(), dtype: str = "float") -> DataFrame:
    """ANSI cast of the whole table; any bad cell fails the job."""
    return df.select(*[F.col(c) if c in exclude else C.strict_number(c, dtype).alias(c)
                       for c in df.columns])


def add_null_timestamps(df: DataFrame, cols=("inicio_dt", "inicio", "fim_dt")) -> DataFrame:
    """Pad absent date columns as null timestamps."""
    missing = {c: F.lit(None).cast("timestamp") for c in cols if c not in df.columns}
    return df.withColumns(missing) if missing else df


def tag(df: DataFrame, **tags) -> DataFrame:
    """Literal provenance columns (model, method, period ...)."""
    return df.withColumns({k: F.lit(v) for k, v in tags.items()})


def error_columns(df: DataFrame, y: str = "actual", p: str = "predicted") -> DataFrame:
    """P20: per-row squared, absolute and percentage error."""
    from sinter.functions.metrics import ape
    return df.withColumns({
        "squared_error": F.pow(F.col(y) - F.col(p), 2),
        "abs_error": F.abs(F.col(y) - F.col(p)),
        "ape": ape(y, p),
    })
