"""Exact quantiles without holding a group in one task.

Spark's exact ``percentile`` merges a group's whole value->count map in one
task, so a hot group (or the global median) is unbounded there. Here the
order statistic of rank floor(p * (n - 1)) is found by pivots, for all
columns and groups in the same two aggregates a round:

1. a mergeable sketch (``percentile_approx``) of the values inside the open
   interval of each slot proposes two of them as pivots;
2. the values below, at and just above each pivot are counted exactly. The
   rank then either is a pivot's, or lies in a smaller open interval.

Pivots are values of the data, so a round always removes some, only
comparisons decide (infinities and denormals are like any value), and the
sketch's error costs rounds, never exactness. The columns stay wide, no
value is exchanged: the state has one row per group and is broadcast to the
rows when it has at most ``BROADCAST_GROUPS`` of them, else joined.
The result is linearly interpolated like numpy / DuckDB ``quantile_cont``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sinter.session import checkpoint_root

GRID = 256
ACCURACY = 10_000
BROADCAST_GROUPS = 50_000


def _value(c):
    """A column as a double; NaN is missing."""
    v = (F.col(c) if isinstance(c, str) else c).cast("double")
    return F.when(~F.isnan(v), v)


def _below(limit):
    return lambda x: x < limit


def _select(d: DataFrame, by, slots, levels, extra=()) -> DataFrame:
    """``d`` has the keys ``by`` and value columns; ``slots`` are (value
    column, probability column or literal). Returns one row per group with
    ``n{i}``, ``p{i}`` and ``q{i}`` for every slot, and the ``extra``
    aggregates, which share the first pass."""
    def stat(i, v, p):
        prob = F.first(p) if isinstance(p, str) else F.lit(float(p))
        return [F.count(v).alias(f"n{i}"), prob.cast("double").alias(f"p{i}")]

    state = d.groupBy(*by).agg(*[a for i, (v, p) in enumerate(slots) for a in stat(i, v, p)], *extra)
    kept = [c for c in state.columns if c not in by and c[0] not in "np"]
    none = F.lit(None).cast("double")
    new = {}
    for i in range(len(slots)):
        new |= {f"r{i}": F.floor(F.col(f"p{i}") * (F.col(f"n{i}") - 1)).cast("long"), f"below{i}": F.lit(0).cast("long"),
                f"lo{i}": none, f"hi{i}": none, f"v{i}": none, f"w{i}": none,
                f"open{i}": F.col(f"n{i}") > 0}
    state = state.withColumns(new).checkpoint(eager=True)
    few = state.count() <= BROADCAST_GROUPS
    # without levels in between, a place's level is its 256th part: no array to look through
    even = len(levels) == GRID + 1
    grid = None if even else F.array(*[F.lit(x) for x in levels])

    while True:
        still = [i for i, n in enumerate(state.agg(*[F.count_if(f"open{i}") for i in range(len(slots))]).first()) if n]
        if not still:
            break

        def rows(table):
            return d.join(F.broadcast(table) if few else table, by)

        own = [c for i in still for c in (f"lo{i}", f"hi{i}", f"open{i}")]
        sketch = []
        for i in still:
            v = F.col(slots[i][0])
            inside = F.when(F.col(f"open{i}") & (F.col(f"lo{i}").isNull() | (v > F.col(f"lo{i}")))
                            & (F.col(f"hi{i}").isNull() | (v < F.col(f"hi{i}"))), v)
            sketch += [F.percentile_approx(inside, levels, ACCURACY).alias(f"s{i}"), F.count(inside).alias(f"m{i}")]
        tried = state.join(rows(state.select(*by, *own)).groupBy(*by).agg(*sketch), by)
        for i in still:
            # the pivots on both sides of the rank's place in the interval
            place = F.try_divide(F.col(f"r{i}") - F.col(f"below{i}") + 1, F.col(f"m{i}"))
            # null place (nothing inside): no pivot, as without an array
            lower = F.ceil(place * GRID).cast("int") if even else F.size(F.filter(grid, _below(place)))
            at = F.greatest(lower, F.lit(1))
            tried = tried.withColumns({
                f"a{i}": F.element_at(f"s{i}", at),
                f"b{i}": F.element_at(f"s{i}", F.least(at + 1, F.lit(len(levels))))})
        tried = tried.drop(*[f"{c}{i}" for i in still for c in "sm"]).checkpoint(eager=True)
        counts = []
        for i in still:
            v = F.col(slots[i][0])
            for x in "ab":
                t = F.col(f"{x}{i}")
                counts += [F.count_if(v < t).alias(f"{x}lt{i}"), F.count_if(v <= t).alias(f"{x}le{i}"),
                           F.min(F.when(v > t, v)).alias(f"{x}up{i}")]
        seen = tried.join(rows(tried.select(*by, *[f"{x}{i}" for i in still for x in "ab"]))
                          .groupBy(*by).agg(*counts), by)
        for i in still:
            seen = seen.withColumns(_narrow(i))
        state = seen.select(*state.columns).checkpoint(eager=True)

    out = {}
    for i in range(len(slots)):
        pos = F.col(f"p{i}") * (F.col(f"n{i}") - 1)
        frac = pos - F.col(f"r{i}")
        out[f"q{i}"] = F.when(frac == 0, F.col(f"v{i}")).when(F.col(f"v{i}") == F.col(f"w{i}"), F.col(f"v{i}")).otherwise(
            F.col(f"v{i}") + (F.col(f"w{i}") - F.col(f"v{i}")) * frac)
    return state.withColumns(out).select(*by, *[f"{c}{i}" for i in range(len(slots)) for c in "npq"], *kept)


def _narrow(i: int) -> dict:
    """New state of slot ``i`` from the counts at its pivots a <= b."""
    r, was_open = F.col(f"r{i}"), F.col(f"open{i}")
    c = {n: F.col(f"{n}{i}") for n in ("a", "alt", "ale", "aup", "b", "blt", "ble", "bup", "lo", "hi", "below", "v", "w")}
    at_a, at_b = (r >= c["alt"]) & (r < c["ale"]), (r >= c["blt"]) & (r < c["ble"])
    hit = was_open & (at_a | at_b)

    def following(le, same, up):
        return F.when(r + 1 < le, same).otherwise(F.coalesce(up, same))

    above_a, above_b = r >= c["ale"], r >= c["ble"]
    return {
        f"v{i}": F.when(hit, F.when(at_a, c["a"]).otherwise(c["b"])).otherwise(c["v"]),
        f"w{i}": F.when(hit, F.when(at_a, following(c["ale"], c["a"], c["aup"]))
                        .otherwise(following(c["ble"], c["b"], c["bup"]))).otherwise(c["w"]),
        f"open{i}": was_open & ~hit,
        f"lo{i}": F.when(above_b, c["b"]).when(above_a, c["a"]).otherwise(c["lo"]),
        f"hi{i}": F.when(r < c["alt"], c["a"]).when(r < c["blt"], c["b"]).otherwise(c["hi"]),
        f"below{i}": F.when(above_b, c["ble"]).when(above_a, c["ale"]).otherwise(c["below"]),
    }


def _levels(probs) -> list[float]:
    return sorted({k / GRID for k in range(GRID + 1)} | {float(p) for p in probs or ()})


def _keyed(df: DataFrame, by, values: dict):
    """Keys and values only; rows with a null key are left out (pandas
    ``groupby`` drops them too). No key: one constant key."""
    checkpoint_root(df.sparkSession)
    keys = [F.col(k).alias(k) for k in by] or [F.lit(0).alias("_q_all")]
    d = df.select(*keys, *[v.alias(n) for n, v in values.items()])
    names = list(by) or ["_q_all"]
    for k in names:
        d = d.filter(F.col(k).isNotNull())
    return d, names


def exact_quantiles(df: DataFrame, by, value, probs=None, prob_col: str | None = None) -> DataFrame:
    """Quantiles of ``value`` per ``by`` group.

    ``probs``: list of levels for every group (output column ``p``), or
    ``prob_col``: a column of ``df`` holding one level per group (constant
    inside a group). Returns ``by..., p, n, q``; groups without a value
    have no row."""
    by = list(by)
    cols = {"_x": _value(value)} | ({"_p": F.col(prob_col)} if prob_col else {})
    d, keys = _keyed(df, by, cols)
    slots = [("_x", "_p")] if prob_col else [("_x", float(p)) for p in probs]
    # deterministic, so a lost cached block is recomputed to the same values
    d = d.filter(F.col("_x").isNotNull()).persist()
    wide = _select(d, keys, slots, _levels(probs))
    d.unpersist()
    each = F.explode(F.array(*[F.struct(F.col(f"p{i}").alias("p"), F.col(f"n{i}").alias("n"), F.col(f"q{i}").alias("q"))
                               for i in range(len(slots))]))
    return wide.select(*by, each.alias("s")).select(*by, "s.p", "s.n", "s.q")


def exact_medians(df: DataFrame, by, cols, extra=None) -> DataFrame:
    """``by...`` and the median of each of ``cols`` under its own name, all
    columns in the same passes; null where a group has no value.
    ``extra(column)`` -> {suffix: aggregate} of a column as a double adds
    ``<col>_<suffix>``, taken in the first pass."""
    by, cols = list(by), list(cols)
    more = {f"{c}_{k}": a for i, c in enumerate(cols) for k, a in (extra(f"_x{i}") if extra else {}).items()}
    aggs = [a.alias(f"_e{j}") for j, a in enumerate(more.values())]
    d, keys = _keyed(df, by, {f"_x{i}": _value(c) for i, c in enumerate(cols)})
    d = d.persist()
    wide = _select(d, keys, [(f"_x{i}", 0.5) for i in range(len(cols))], _levels([0.5]), aggs)
    d.unpersist()
    return wide.select(*by, *[F.col(f"q{i}").alias(c) for i, c in enumerate(cols)],
                       *[F.col(f"_e{j}").alias(k) for j, k in enumerate(more)])


def exact_median(df: DataFrame, by, value) -> DataFrame:
    """Median per group (``by..., median``)."""
    r = exact_quantiles(df, by, value, probs=[0.5])
    return r.select(*by, F.col("q").alias("median"))
