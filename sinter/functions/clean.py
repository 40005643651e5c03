"""Column expressions that turn text sensor cells into typed values.

All of them are built-in Spark expressions (whole-stage codegen, no Python
in the row path). Spark 4 runs ANSI by default, so every parse uses a
``try_`` form where the reference coerces bad cells to null.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values that must equal the reference's input conventions.
SENTINEL = "[-11059] No Good Data For Calculation"
TS_FORMAT_FRACTION = "yyyy-MM-dd HH:mm:ss.SSSSSS"
TS_FORMAT_DAY_FIRST = "d/M/yyyy H:mm"
TS_FORMATS_INFERRED = (
    "yyyy-MM-dd HH:mm:ss.SSSSSS",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd",
)
# the same four in one pattern: one parse a cell, not one for each
TS_FORMAT_INFERRED = "yyyy-MM-dd[ HH:mm[:ss[.SSSSSS]]]"
# plain decimal number, optional sign and exponent; Spark's own cast also
# takes '1d', '1f' and hex floats, which pandas and DuckDB refuse
NUMBER_PATTERN = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"
DOUBLE_EPS = 2.220446049250313e-16


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def decimal_comma(c) -> Column:
    """Replace every ',' by '.' (P12)."""
    return F.replace(col_(c), F.lit(","), F.lit("."))


def null_sentinels(c, sentinels=(SENTINEL,)) -> Column:
    """Whole-cell sentinel strings become null."""
    c = col_(c)
    return F.when(c.isin(list(sentinels)), F.lit(None)).otherwise(c)


def blank_to_null(c) -> Column:
    """Trim; an empty result becomes null."""
    return F.nullif(F.trim(col_(c)), F.lit(""))


def to_number(c) -> Column:
    """Text to double, anything that is not a plain number -> null."""
    c = col_(c)
    t = F.trim(c)
    return F.when(t.rlike(NUMBER_PATTERN), t.try_cast("double"))


def clean_number(c, sentinels=(SENTINEL,)) -> Column:
    """The full text-cell chain: comma -> sentinel -> trim/blank -> guarded
    cast, written flat so each column's expression tree stays small (the
    composed form repeats its input at every step). Same result as
    ``to_number(blank_to_null(null_sentinels(decimal_comma(c))))``: an empty
    cell never matches the number pattern."""
    dotted = decimal_comma(c)
    t = F.trim(dotted)
    return (F.when(dotted.isin(list(sentinels)), F.lit(None).cast("double"))
            .when(t.rlike(NUMBER_PATTERN), t.try_cast("double")))


def strict_number(c, dtype: str = "float") -> Column:
    """ANSI cast after decimal comma; a bad cell fails the job."""
    return decimal_comma(c).cast(dtype)


def _wall(ts: Column) -> Column:
    """Parsed wall-clock time without a zone (parse and cast use the same
    session zone, so the text's wall time is kept)."""
    return ts.cast("timestamp_ntz")


def parse_ts(c, fmt: str = TS_FORMAT_FRACTION) -> Column:
    """Explicit format, bad -> null."""
    return _wall(F.try_to_timestamp(col_(c), F.lit(fmt)))


def parse_ts_any(c, fmts=TS_FORMATS_INFERRED) -> Column:
    """First format that parses wins, else null (P10). The inferred formats
    nest, so one pattern with optional parts takes exactly the same texts."""
    if tuple(fmts) == TS_FORMATS_INFERRED:
        fmts = (TS_FORMAT_INFERRED,)
    return _wall(F.coalesce(*[F.try_to_timestamp(col_(c), F.lit(f)) for f in fmts]))


def parse_ts_strict(c, fmt: str = TS_FORMAT_DAY_FIRST) -> Column:
    """Day-first format; under ANSI a bad value fails the job."""
    return F.to_timestamp_ntz(col_(c), F.lit(fmt))


def nan_to_null(c) -> Column:
    """pandas skips NaN, Spark propagates it: turn NaN into null."""
    return F.nanvl(col_(c), F.lit(None).cast("double"))


def round_half_even(c, digits: int = 3) -> Column:
    """numpy's rounding of a double: rint(x * 10^d) / 10^d."""
    scale = float(10 ** digits)
    return F.rint(col_(c) * F.lit(scale)) / F.lit(scale)


def round6(c) -> Column:
    return F.round(col_(c), 6)
