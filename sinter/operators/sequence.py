"""Operators over a global order without a single-partition window.

``Window.orderBy(ts)`` with no partition key moves every row into one task.
Here the rows are dealt to ranges of the full order (``[key] + order``,
ending in a unique tie-break), so ranges are balanced even when one timestamp
or one series holds a large share of the rows. The bounds of the ranges are
literals, picked once from a hash sample of the order values: which range a
row falls in depends on its own values alone. Recomputing a lost partition
cuts the same way, so no copy of the rows is stored, and all windows run
inside one exchange on the range id.

What a range needs from the ranges before or after it travels through tables
with one row per range (lags: as many as the longest lag), aggregated where
the rows lie. A series continues over a bound only if it is the bound's own
series, so no other series enters them.

The input is read several times (count, sample, edges, rows), with the
columns each needs; an input that is costly or not deterministic should be
checkpointed first. Rows with equal order values may come out in any order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

# rows a range should hold, from few rows to many; ranges a layout may have
FEW_ROWS, MANY_ROWS, MAX_RANGES = 1 << 16, 1 << 20, 1 << 14
HASH_SPACE = 1 << 30
_KEY, _PID = "_sq_key", "_pid"


def _micros_long(ts: Column) -> Column:
    """Microseconds since the epoch of a zone-free timestamp (no session-zone
    conversion, so no daylight-saving shifts)."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", epoch, ts.cast("timestamp_ntz"))


def _encoded(df: DataFrame, names) -> list[tuple[Column, T.DataType]]:
    """Order columns in a form whose values survive the way to the driver
    and back as literals: times become numbers, the order stays."""
    out = []
    for name in names:
        c, t = F.col(name), df.schema[name].dataType
        if isinstance(t, T.TimestampNTZType):
            c, t = _micros_long(c), T.LongType()
        elif isinstance(t, T.TimestampType):
            c, t = F.unix_micros(c), T.LongType()
        elif isinstance(t, T.DateType):
            c, t = F.unix_date(c), T.IntegerType()
        elif not isinstance(t, (T.NumericType, T.StringType, T.BooleanType, T.BinaryType)):
            raise TypeError(f"can't order by {name!r} of type {t.simpleString()}")
        out.append((c, t))
    return out


def typed(value, t: T.DataType) -> str:
    """SQL text of a constant of type ``t``; bytes go as hex, so no text
    needs escaping."""
    if isinstance(t, T.LongType) and value is not None and value > -(1 << 63):
        return f"{value}L"
    if value is None:
        text = "NULL"
    elif isinstance(value, (str, bytes, bytearray)):
        text = f"X'{(value.encode() if isinstance(value, str) else bytes(value)).hex()}'"
    else:
        text = f"'{value!r}'" if isinstance(value, float) else f"'{value}'"
    return f"CAST({text} AS {t.simpleString()})"


@dataclass(frozen=True)
class Order:
    """The composite order value of a row, comparable with literals of it."""

    value: Column
    types: tuple

    @staticmethod
    def of(df: DataFrame, names) -> "Order":
        enc = _encoded(df, names)
        return Order(F.struct(*[c.alias(f"o{i}") for i, (c, _) in enumerate(enc)]), tuple(t for _, t in enc))

    def literal(self, row) -> Column:
        return F.expr(self._text(row))

    def literals(self, rows) -> Column:
        """An array of order values, as one piece of text: built column by
        column, a thousand of them take seconds of the driver."""
        return F.expr(f"array({', '.join(self._text(r) for r in rows)})")

    def _text(self, row) -> str:
        return "named_struct(" + ", ".join(f"'o{i}', {typed(v, t)}" for i, (v, t) in enumerate(zip(row, self.types))) + ")"

    def position(self, bounds) -> Column:
        """How many of the sorted ``bounds`` are at or below the row's value,
        by two short looks: at the first bound of each block, then inside one."""
        if not bounds:
            return F.lit(0)
        step = max(1, int(len(bounds) ** 0.5))
        blocks = [bounds[i:i + step] for i in range(0, len(bounds), step)]
        heads = self.literals([b[0] for b in blocks])
        inside = F.expr("array(" + ", ".join(f"array({', '.join(self._text(r) for r in b)})" for b in blocks) + ")")

        def reached(table, value):
            return F.size(F.filter(table, lambda b: b <= value))

        def place(value):
            # arrays of one element name a value that is used more than once
            return F.transform(F.array(reached(heads, value)), lambda k: F.when(k == 0, 0).otherwise(
                (k - 1) * step + reached(F.element_at(inside, F.greatest(k, F.lit(1))), value)))

        return F.flatten(F.transform(F.array(self.value), place))[0]


def sample_values(df: DataFrame, order: Order, n: int, wanted: int) -> list[tuple[tuple, int]]:
    """Distinct order values with their number of rows, in order, of about
    ``wanted`` rows taken by hash of the value: the same ones on every run,
    and a value that many rows share is one value."""
    share = min(HASH_SPACE, max(1, wanted * HASH_SPACE // max(n, 1)))
    rows = (df.select(order.value.alias("v")).filter(F.pmod(F.xxhash64("v"), F.lit(HASH_SPACE)) < share)
            .groupBy("v").count().orderBy("v").collect())
    return [(tuple(r["v"]), r["count"]) for r in rows]


def range_bounds(df: DataFrame, order: Order, partitions: int | None = None) -> list[tuple]:
    """Lower bounds of all ranges but the first."""
    n = df.count()
    if partitions is None:
        spread = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        partitions = min(MAX_RANGES, max(-(-n // MANY_ROWS), min(spread, -(-n // FEW_ROWS))))
    if partitions <= 1 or n == 0:
        return []
    each = min(256, max(16, (1 << 16) // partitions))
    values = sample_values(df, order, n, partitions * each)
    total, run, bounds = sum(c for _, c in values), 0, []
    for v, c in values:
        if run * partitions >= total * (len(bounds) + 1):
            bounds.append(v)
        run += c
    return bounds


class Ranges:
    """``df`` dealt to ranges: ``where`` has the range id and the series key
    beside each row as it lies, ``rows`` after the one exchange."""

    def __init__(self, df: DataFrame, order, key=None, partitions: int | None = None):
        self.order = list(order)
        full = ([key] if key else []) + self.order
        o = Order.of(df, full)
        bounds = range_bounds(df, o, partitions)
        self.n = len(bounds) + 1
        self.value = o.value
        self.where = df.withColumns({_KEY: F.col(key) if key else F.lit(0), _PID: o.position(bounds).cast("int")})
        # one range is exchanged too: coalesced, its task would run all that leads to the rows as well
        self.rows = self.where.repartitionById(self.n, F.col(_PID)) if bounds else self.where.repartition(1)
        if bounds and key:
            enc, t = _encoded(df, [key])[0]
            at = F.expr(f"array({', '.join(typed(b[0], t) for b in bounds)})")
            self.goes_on = (F.col(_PID) < self.n - 1) & F.get(at, F.col(_PID)).eqNullSafe(enc)
            self.came = (F.col(_PID) > 0) & F.get(at, F.col(_PID) - 1).eqNullSafe(enc)
        else:
            self.goes_on, self.came = F.col(_PID) < self.n - 1, F.col(_PID) > 0

    def window(self, backward: bool = False):
        by = [F.col(c).desc() if backward else F.col(c) for c in self.order]
        return Window.partitionBy(_PID, _KEY).orderBy(*by)

    def join(self, rows: DataFrame, edges: DataFrame) -> DataFrame:
        """Left join of ``edges`` (range, series, values; a row a range)."""
        e = edges.withColumnsRenamed({_PID: "_e_pid", _KEY: "_e_key"})
        return rows.join(F.broadcast(e), (F.col(_PID) == F.col("_e_pid")) & F.col(_KEY).eqNullSafe(F.col("_e_key")),
                         "left").drop("_e_pid", "_e_key")

    def lengths(self) -> DataFrame:
        """Per range whose last series goes on: its rows there (``here``) and
        up to the range's end (``upto``)."""
        per = self.where.filter(self.goes_on).groupBy(_PID, _KEY).agg(F.count(F.lit(1)).alias("here"))
        run = Window.partitionBy(_KEY).orderBy(_PID).rowsBetween(Window.unboundedPreceding, 0)
        return per.withColumn("upto", F.sum("here").over(run))

    def numbered(self, name: str) -> DataFrame:
        before = self.lengths().select((F.col(_PID) + 1).alias(_PID), _KEY, F.col("upto").alias("_off"))
        rows = self.rows.withColumn(name, F.row_number().over(self.window()).cast("long"))
        if self.n == 1:
            return rows
        return self.join(rows, before).withColumn(name, F.col(name) + F.coalesce("_off", F.lit(0))).drop("_off")


def _drop_internal(df: DataFrame) -> DataFrame:
    return df.drop(_KEY, _PID)


def running_sum(df: DataFrame, order, value: str, name: str) -> DataFrame:
    """Running total of the whole numbers ``value`` by ``order`` (unique),
    the row's own included."""
    r = Ranges(df, order)
    own = F.sum(value).over(r.window().rowsBetween(Window.unboundedPreceding, 0))
    rows = r.rows.withColumn(name, own.cast("long"))
    if r.n > 1:
        each = r.where.groupBy(_PID, _KEY).agg(F.sum(value).alias("_sum"))
        over = Window.partitionBy(_KEY).orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
        before = each.select(_PID, _KEY, F.sum("_sum").over(over).alias("_off"))
        rows = r.join(rows, before).withColumn(name, F.col(name) + F.coalesce("_off", F.lit(0))).drop("_off")
    return _drop_internal(rows)


def row_number(df: DataFrame, order, name: str = "row_number",
               partitions: int | None = None, key=None) -> DataFrame:
    """Global 1-based row number by ``order`` (restarting per ``key``)."""
    return _drop_internal(Ranges(df, order, key, partitions).numbered(name))


def _carried(r: Ranges, cols, forward: bool) -> DataFrame:
    """Per range and series that reaches it from the range before (forward)
    or after it: the nearest non-null value of each column there."""
    pick, side, step = (F.max_by, r.goes_on, 1) if forward else (F.min_by, r.came, -1)
    near = r.where.filter(side).groupBy(_PID, _KEY).agg(
        *[pick(F.col(c), F.when(F.col(c).isNotNull(), r.value)).alias(c) for c in cols])
    run = (Window.partitionBy(_KEY).orderBy(F.col(_PID) if forward else F.col(_PID).desc())
           .rowsBetween(Window.unboundedPreceding, 0))
    return near.select((F.col(_PID) + step).alias(_PID), _KEY,
                       *[F.last(c, ignorenulls=True).over(run).alias(c) for c in cols])


def fill(df: DataFrame, order, forward=(), backward=(), key=None,
         partitions: int | None = None) -> DataFrame:
    """Forward-fill ``forward`` and backward-fill ``backward`` columns inside
    one exchange. A column in both lists gets ffill then bfill (leading gap
    takes the first value)."""
    r = Ranges(df, order, key, partitions)
    y, parts = r.rows, {}
    for cols, fwd in ((list(forward), True), (list(backward), False)):
        if not cols:
            continue
        tag = "f" if fwd else "b"
        # a running frame over the reversed order for the backward side (an
        # UNBOUNDED FOLLOWING frame is re-aggregated for every row)
        w = r.window(backward=not fwd).rowsBetween(Window.unboundedPreceding, 0)
        y = y.withColumns({f"_{tag}_{c}": F.last(c, ignorenulls=True).over(w) for c in cols})
        if r.n > 1:
            y = r.join(y, _carried(r, cols, fwd).withColumnsRenamed({c: f"_{tag}c_{c}" for c in cols}))
        for c in cols:
            parts.setdefault(c, []).extend([f"_{tag}_{c}"] + ([f"_{tag}c_{c}"] if r.n > 1 else []))
    y = y.withColumns({c: F.coalesce(*[F.col(p) for p in ps]) for c, ps in parts.items()})
    return _drop_internal(y.drop(*[p for ps in parts.values() for p in ps]))


def ffill(df: DataFrame, order, cols, key=None, partitions: int | None = None) -> DataFrame:
    """Carry the last non-null value forward along ``order``."""
    return fill(df, order, forward=cols, key=key, partitions=partitions)


def bfill(df: DataFrame, order, cols, key=None, partitions: int | None = None) -> DataFrame:
    """Carry the next non-null value backward (looks into the future)."""
    return fill(df, order, backward=cols, key=key, partitions=partitions)


def interpolate_time(df: DataFrame, ts: str, order, cols, key=None,
                     partitions: int | None = None, on_bad_ts: str = "drop") -> DataFrame:
    """Time-weighted linear interpolation, forward direction.

    Inside a gap: v0 + (v1 - v0) * (t - t0) / (t1 - t0) from the previous
    and next known points; a leading gap stays null; a trailing gap takes
    the last known value. Rows without a time cannot be placed: they are
    dropped (``on_bad_ts='drop'``) or fail the call (``'error'``).
    """
    cols = list(cols)
    if on_bad_ts == "error":
        if not df.filter(F.col(ts).isNull()).isEmpty():
            raise ValueError(f"null values in time column {ts!r}")
    elif on_bad_ts == "drop":
        df = df.filter(F.col(ts).isNotNull())
    else:
        raise ValueError("on_bad_ts must be 'drop' or 'error'")
    known = {f"_p_{c}": F.when(F.col(c).isNotNull(), F.struct(F.col(ts).alias("t"), F.col(c).alias("v")))
             for c in cols}
    y = df.withColumns(known)
    y = y.withColumns({f"_n_{c}": F.col(f"_p_{c}") for c in cols})
    y = fill(y, order, forward=[f"_p_{c}" for c in cols], backward=[f"_n_{c}" for c in cols],
             key=key, partitions=partitions)
    out = {}
    for c in cols:
        p, n = F.col(f"_p_{c}"), F.col(f"_n_{c}")
        t, t0, t1 = (_micros_long(x).cast("double") for x in (F.col(ts), p["t"], n["t"]))
        interp = p["v"] + (n["v"] - p["v"]) * F.try_divide(t - t0, t1 - t0)
        out[c] = (F.when(F.col(c).isNotNull(), F.col(c))
                  .when(p.isNull(), F.lit(None))
                  .when(n.isNull(), p["v"])
                  .when(t1 == t0, p["v"])
                  .otherwise(interp))
    return y.withColumns(out).drop(*[f"_p_{c}" for c in cols], *[f"_n_{c}" for c in cols])


def lag(df: DataFrame, order, cols, steps=(1,), key=None, partitions: int | None = None,
        diff: bool = False) -> DataFrame:
    """Value ``k`` rows earlier along ``order`` (per key), or the
    difference to it.

    Inside a range a plain ``lag`` window does it. The first ``k`` rows of a
    series in a range find their source among the last ``k`` rows that the
    series has in an earlier range, which a table of the last ``max(steps)``
    rows of every range (ranked and cut before they are exchanged, then
    broadcast) answers by their number in the series.
    """
    cols, steps = list(cols), list(steps)
    r = Ranges(df, order, key, partitions)
    w = r.window()
    out = r.numbered("_seq").withColumn("_rk", F.row_number().over(w))
    tail = None
    if r.n > 1:
        last = r.where.filter(r.goes_on).withColumn("_back", F.row_number().over(r.window(backward=True)))
        ends = r.lengths().select(_PID, _KEY, "upto")
        tail = (r.join(last.filter(F.col("_back") <= max(steps)), ends)
                .select(F.col(_KEY).alias("_t_key"), (F.col("upto") - F.col("_back") + 1).alias("_src_seq"),
                        *[F.col(c).alias(f"_t_{c}") for c in cols]))
    for k in steps:
        if tail is not None:
            t = tail.select("_t_key", (F.col("_src_seq") + k).alias("_want"),
                            *[F.col(f"_t_{c}").alias(f"_t{k}_{c}") for c in cols])
            out = out.join(F.broadcast(t), F.col(_KEY).eqNullSafe(F.col("_t_key")) & (F.col("_seq") == F.col("_want")),
                           "left").drop("_t_key", "_want")
        for c in cols:
            v = F.lag(c, k).over(w)
            if tail is not None:
                v = F.when(F.col("_rk") <= k, F.col(f"_t{k}_{c}")).otherwise(v)
            out = out.withColumn(f"{c}_diff{k}" if diff else f"{c}_lag{k}", F.col(c) - v if diff else v)
        out = out.drop(*[f"_t{k}_{c}" for c in cols])
    return _drop_internal(out).drop("_seq", "_rk")
