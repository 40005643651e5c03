"""Error metrics as aggregate expressions.

Every metric is an ordinary Spark aggregate, so it works under
``groupBy(...)`` (per model, per bin, per cluster) and is computed with
map-side partial aggregation: one shuffle of one small row per group and
map task, whatever the data size.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from sinter.functions.clean import DOUBLE_EPS, col_

INF = float("inf")


def mse(y, p) -> Column:
    """Mean squared error."""
    return F.avg(F.pow(col_(y) - col_(p), 2))


def rmse(y, p) -> Column:
    """Root of the mean squared error."""
    return F.sqrt(mse(y, p))


def mae(y, p) -> Column:
    """Mean absolute error."""
    return F.avg(F.abs(col_(y) - col_(p)))


def r2(y, p) -> Column:
    """1 - SSres / SStot (not the squared correlation).

    Constant actual values: 1 when the fit is perfect, else 0 (the usual
    finite convention of the metric).
    """
    y, p = col_(y), col_(p)
    ss_res = F.sum(F.pow(y - p, 2))
    ss_tot = F.var_pop(y) * F.count(y)
    return (F.when(ss_tot == 0, F.when(ss_res == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
            .otherwise(F.lit(1.0) - ss_res / ss_tot))


def ape(y, p) -> Column:
    """Per-row absolute percentage error, percent; null where actual = 0."""
    y, p = col_(y), col_(p)
    return F.abs(F.try_divide(y - p, y)) * F.lit(100.0)


def mape_pct(y, p) -> Column:
    """E5: mean of |(y-p)/y| * 100 with no zero guard.

    Matches numpy: a row with y = 0 and p != 0 makes the mean +inf, a row
    with y = p = 0 makes it NaN (returned as null).
    """
    y, p = col_(y), col_(p)
    zero_nonzero = F.count_if((y == 0) & (p != 0))
    zero_zero = F.count_if((y == 0) & (p == 0))
    return (F.when(zero_zero > 0, F.lit(None).cast("double"))
            .when(zero_nonzero > 0, F.lit(INF))
            .otherwise(F.avg(ape(y, p))))


def mape_fraction(y, p) -> Column:
    """Mean of |(y-p)/y| over rows with y != 0, as a fraction."""
    y, p = col_(y), col_(p)
    return F.avg(F.when(y != 0, F.abs((y - p) / y)))


def mape_eps(y, p) -> Column:
    """Mean of |y-p| / max(|y|, eps) * 100."""
    y, p = col_(y), col_(p)
    return F.avg(F.abs(y - p) / F.greatest(F.abs(y), F.lit(DOUBLE_EPS))) * F.lit(100.0)


def zero_actuals(y) -> Column:
    """Count of rows whose actual value is exactly zero."""
    return F.count_if(col_(y) == 0)


def coverage(y, lower, upper) -> Column:
    """Share of rows with lower <= y <= upper."""
    y = col_(y)
    return F.avg((y.between(col_(lower), col_(upper))).cast("double"))


def regression_metrics(y="actual", p="predicted") -> list[Column]:
    """The metric set of the model-comparison table."""
    return [F.count(F.lit(1)).alias("n"),
            mse(y, p).alias("mse"),
            r2(y, p).alias("r2"),
            mape_fraction(y, p).alias("mape")]
