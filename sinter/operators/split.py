"""Train / calibration / test splits.

All splits label rows (a ``split`` column) instead of producing separate
frames, so one cached or checkpointed table flows through fit, calibrate
and evaluate. The chronological and the seeded split only need the order
value at which a label ends; ``rank_cuts`` finds it by exact counts between
pivots, and rows are labelled where they lie: nothing is sorted, numbered or
exchanged. Row numbers are added only on request.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from sinter.operators.sequence import Order, row_number, sample_values

PIVOTS = 1 << 8
SAMPLE, FEW = 1 << 13, 1 << 13


def n_test_of(n: int, test_frac: float) -> int:
    """Test size of a fractional split: ceil(f * n)."""
    return int(math.ceil(test_frac * n))


@dataclass(frozen=True)
class Cut:
    """The order value of the row at a rank: ``below`` rows have a smaller
    one, ``same`` rows this one."""

    value: tuple
    below: int
    same: int


def _among(counted, rank: int, below: int) -> Cut:
    for value, n in counted:
        if below + n >= rank:
            return Cut(value, below, n)
        below += n
    raise ValueError("rank beyond the last row; is the input deterministic?")


def _pivots(df: DataFrame, order: Order, n: int) -> list[tuple]:
    """Sorted values of rows of ``df``, at least one: every look at an
    interval takes its pivots out of it, whatever the sample holds."""
    values = [v for v, _ in sample_values(df, order, n, SAMPLE)]
    if not values:
        return [tuple(df.agg(F.min(order.value).alias("v")).first()["v"])]
    return values[::-(-len(values) // PIVOTS)]


def rank_cut(df: DataFrame, order: Order, rank: int, n: int) -> Cut:
    """The cut at 1-based ``rank`` of ``n`` rows. Rows are counted at and
    between pivots (one small count a pivot and task is exchanged), then only
    the interval with the rank is looked at, until it has few rows."""
    below, inside = 0, df
    while n > FEW:
        pivots = _pivots(inside, order, n)
        seen = inside.select(order.value.alias("v"), order.position(pivots).alias("at"))
        # odd places are pivots, even ones the open intervals around them
        is_pivot = F.get(order.literals(pivots), F.col("at") - 1) == F.col("v")
        place = 2 * F.col("at") - F.coalesce(is_pivot, F.lit(False)).cast("int")
        counts = {r["place"]: r["count"] for r in seen.groupBy(place.alias("place")).count().collect()}
        for i in sorted(counts):
            if below + counts[i] >= rank:
                break
            below += counts[i]
        if i % 2:
            return Cut(pivots[i // 2], below, counts[i])
        if i:
            inside = inside.filter(order.value > order.literal(pivots[i // 2 - 1]))
        if i // 2 < len(pivots):
            inside = inside.filter(order.value < order.literal(pivots[i // 2]))
        n = counts[i]
    rows = inside.select(order.value.alias("v")).groupBy("v").count().orderBy("v").collect()
    return _among([(tuple(r["v"]), r["count"]) for r in rows], rank, below)


def hash_cut(hash_col: str):
    """``rank_cut`` of an order that starts with a hash as hex text: one count
    by its first four digits leaves so few rows that no pivots are needed."""
    def cut(df: DataFrame, order: Order, rank: int, n: int) -> Cut:
        head, below = F.substr(hash_col, F.lit(1), F.lit(4)), 0
        counts = {r["head"]: r["count"] for r in df.groupBy(head.alias("head")).count().collect()}
        for h in sorted(counts, key=lambda v: (v is not None, v)):
            if below + counts[h] >= rank:
                break
            below += counts[h]
        found = rank_cut(df.filter(head.eqNullSafe(F.lit(h))), order, rank - below, counts[h])
        return Cut(found.value, found.below + below, found.same)
    return cut


def label_ranks(df: DataFrame, order, ends, name: str, n: int, find=rank_cut) -> DataFrame:
    """Label rows by rank: ``ends`` are (label, last rank), in order. Rows
    that share the order value at an end are told apart by their other
    columns; only those rows are numbered."""
    o = Order.of(df, order)
    cuts = []
    for label, last in ends:
        if 0 < last and (not cuts or last > cuts[-1][1]):
            cuts.append((label, last, find(df, o, last, n) if last < n else None))

    def labels(reached) -> Column:
        out = None
        for label, last, cut in cuts:
            if cut is None:
                return F.lit(label) if out is None else out.otherwise(F.lit(label))
            out = (F if out is None else out).when(reached(last, cut), F.lit(label))
        return F.lit(None).cast("string") if out is None else out

    out = df.withColumn(name, labels(lambda last, cut: o.value <= o.literal(cut.value)))
    split = {c.value: c for _, last, c in cuts if c is not None and c.below + c.same > last}
    if not split:
        return out
    at = o.literals(list(split))
    start = F.create_map(*[x for v, c in split.items() for x in (F.lit(list(split).index(v)), F.lit(c.below))])
    which = F.array_position(at, o.value) - 1
    tied = df.filter(F.array_contains(at, o.value)).withColumns(
        {"_which": which.cast("int"), "_other": F.xxhash64(*[F.col(c) for c in df.columns])})
    tied = row_number(tied, ["_other"], "_rank", key="_which").withColumn("_rank", F.col("_rank") + start[F.col("_which")])
    tied = tied.withColumn(name, labels(lambda last, cut: F.col("_rank") <= last)).drop("_which", "_other", "_rank")
    return out.filter(~F.array_contains(at, o.value)).unionByName(tied)


def chrono_split(df: DataFrame, order, test_frac: float = 0.2, cal_frac: float | None = None,
                 name: str = "split", rn: str | None = None, n: int | None = None) -> DataFrame:
    """The last ceil(f*n) rows by ``order`` are ``test``; with
    ``cal_frac`` the last ceil(cal_frac * n_train) training rows are
    ``cal``; the rest ``train``. ``rn`` names a column of row numbers to add,
    which costs an exchange and a sort."""
    n = df.count() if n is None else n
    n_train = n - n_test_of(n, test_frac)
    n_cal = n_test_of(n_train, cal_frac) if cal_frac else 0
    ends = [("train", n_train - n_cal), ("cal", n_train), ("test", n)]
    if rn is None:
        return label_ranks(df, order, ends, name, n)
    r = F.col(rn)
    return row_number(df, order, rn).withColumn(
        name, F.when(r > F.lit(n_train), F.lit("test")).when(r > F.lit(n_train - n_cal), F.lit("cal"))
        .otherwise(F.lit("train")))


def keyed_chrono_split(df: DataFrame, order, key: str, test_frac: float = 0.2, cal_frac: float | None = None,
                       name: str = "split", rn: str = "row_number") -> DataFrame:
    """W7/W8 inside each ``key``: the last ceil(f*n) rows of a key by
    ``order`` are ``test``, the last ceil(cal_frac * n_train) of its other
    rows ``cal``. Needs a row per key on the executors: the counts are
    joined (broadcast by AQE while small)."""
    x = row_number(df, order, rn, key=key)
    n = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    n = n.withColumn("_train", F.col("_n") - F.ceil(F.col("_n") * F.lit(test_frac)))
    n = n.withColumn("_cal", F.ceil(F.col("_train") * F.lit(cal_frac or 0.0)))
    label = (F.when(F.col(rn) > F.col("_train"), F.lit("test"))
             .when(F.col(rn) > F.col("_train") - F.col("_cal"), F.lit("cal")).otherwise(F.lit("train")))
    return x.join(n, key).withColumn(name, label).drop("_n", "_train", "_cal")


def hash_key(row_id: str, seed: int = 42):
    """Portable seeded order key: md5 of '<row_id>:<seed>' (same in DuckDB)."""
    return F.md5(F.concat(F.col(row_id).cast("string"), F.lit(f":{int(seed)}")))


def seeded_split(df: DataFrame, row_id: str, test_frac: float = 0.3, seed: int = 42,
                 name: str = "split", n: int | None = None) -> DataFrame:
    """Exactly ceil(f*n) rows are ``test``, the first of a seeded hash
    order of a stable row id (independent of partitioning, unlike
    ``randomSplit``). The hash that ends them is found like any cut, and
    rows are labelled where they lie."""
    n = df.count() if n is None else n
    x = df.withColumn("_h", hash_key(row_id, seed))
    return label_ranks(x, ["_h", row_id], [("test", n_test_of(n, test_frac)), ("train", n)], name, n, hash_cut("_h")).drop("_h")


def cap_rows(df: DataFrame, max_rows: int, rn: str = "row_number",
             split: str = "split", which: str = "train") -> DataFrame:
    """Keep only the first ``max_rows`` rows (by row number) of one
    split; other splits pass unchanged. ``chrono_split(rn=...)`` numbers
    rows from the start, so train rows are exactly 1..n_train."""
    return df.filter((F.col(split) != F.lit(which)) | (F.col(rn) <= F.lit(max_rows)))
