"""Mixing sources to target weights by hash-threshold histograms.

Every document has a fixed 60-bit hash. A source that must give ``target``
words of its ``source_size`` gives all documents ``floor(target / size)``
times and once more those whose hash lies below a threshold, so the epochs
of a source are nested. The threshold comes from histograms: words are
summed by source and hash bucket, the running sum names the bucket in which
the budget ends, and only that bucket is split again, until one hash is
left. Nothing is sorted and no source is gathered in a task: the histograms
are map-side sums of at most 4096 buckets a source.

The recipe (one row per source) lies on the driver, as the weights do; more
than ``MAX_SOURCES`` sources are refused rather than broadcast.

Defined results: a null text has size 0; a null source is a source of its
own, the last; rows equal in id and text have one hash and share their fate;
a source of size 0 has target 0; an empty table gives no rows; other columns
are passed through where they don't clash with the five that are added.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sinter.llm.common import WORD, store

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2.0
HASH_BITS, LEVEL_BITS = 60, 12
MAX_SOURCES = 200_000


def doc_hash(id_col: Column, text: Column) -> Column:
    """60 bits of md5 of id and text: the same in every run and engine."""
    named = F.concat(F.coalesce(id_col.cast("string"), F.lit("")), F.lit(" "), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(named.cast("binary")), 1, 15), 16, 10).cast("long")


def targets(sizes: list[tuple[str | None, int]], weights=WEIGHTS, share: float = SHARE,
            most: float = MOST) -> dict[str | None, float]:
    """Words that each source shall give. Sources in code point order, null
    last, take the weights in turn; a target above ``most`` times its
    source's size is cut there and the excess shared by weight again."""
    order = sorted(sizes, key=lambda s: (s[0] is None, (s[0] or "").encode("utf-8")))
    weight = {s: float(weights[i % len(weights)]) for i, (s, _) in enumerate(order)}
    size = dict(order)
    left, free, out = share * sum(size.values()), [s for s, _ in order], {}
    while free:
        unit = left / sum(weight[s] for s in free)
        above = [s for s in free if unit * weight[s] > most * size[s]]
        for s in above:
            out[s] = most * size[s]
            left -= out[s]
        if not above:
            out.update({s: unit * weight[s] for s in free})
            break
        free = [s for s in free if s not in out]
    return out


def thresholds(sized: DataFrame, budgets: dict[str | None, float]) -> dict[str | None, int]:
    """For each source the hash below which its documents hold the budget,
    as near as whole documents allow. ``sized``: source, size, h."""
    spark = sized.sparkSession
    done: dict[str | None, int] = {s: 0 for s, b in budgets.items() if b <= 0}
    # source -> (first hash of the boundary bucket, words before it)
    state = {s: (0, 0) for s in budgets if s not in done}
    bits = HASH_BITS
    while state:
        bits -= LEVEL_BITS
        rows = [(s, lo, used, float(budgets[s])) for s, (lo, used) in state.items()]
        edge = F.broadcast(spark.createDataFrame(rows, "s string, lo long, used long, budget double"))
        width = 1 << bits
        inside = sized.join(edge, F.col("source").eqNullSafe(F.col("s"))
                            & (F.col("h") >= F.col("lo"))
                            & (F.col("h") < F.col("lo") + F.lit(width << LEVEL_BITS)))
        hist = (inside.groupBy("s", "lo", "used", "budget", F.expr(f"shiftright(h - lo, {bits})").alias("bucket"))
                .agg(F.sum("size").alias("words"), F.min("h").alias("h0"), F.max("h").alias("h1")))
        w = Window.partitionBy("s").orderBy("bucket")
        cum = hist.withColumn("upto", F.col("used") + F.sum("words").over(w))
        over = (cum.filter(F.col("upto") > F.col("budget")).groupBy("s")
                .agg(F.min_by(F.struct("lo", "bucket", "words", "upto", "h0", "h1"), "bucket").alias("b")))
        found = {r["s"]: r["b"] for r in over.collect()}
        for s in list(state):
            b = found.get(s)
            if b is None:  # all of the bucket fits
                done[s] = state[s][0] + (width << LEVEL_BITS)
                del state[s]
            elif b["h0"] == b["h1"]:  # one hash: in or out, whichever is nearer
                before = b["upto"] - b["words"]
                done[s] = b["h0"] + (b["upto"] - budgets[s] < budgets[s] - before)
                del state[s]
            else:
                state[s] = (b["lo"] + b["bucket"] * width, b["upto"] - b["words"])
    return done


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, source, size, source_size, target, taken, times, *keep) of every
    document; ``times`` is how often the mix takes it."""
    sized = store(docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), *keep,
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        doc_hash(F.col(id_col), F.col(text_col)).alias("h")), "mixing-sizes")
    spark = docs.sparkSession
    totals = sized.groupBy("source").agg(F.sum("size").alias("n"))
    rows = totals.limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources; a recipe must list them")
    size = {r["source"]: r["n"] for r in rows}
    want = targets(list(size.items()), weights, share, most)
    full = {s: int(min(most, math.floor(want[s] / n))) if n else 0 for s, n in size.items()}
    rest = {s: (want[s] - full[s] * n if full[s] < most else 0.0) for s, n in size.items()}
    below = thresholds(sized.select("source", "size", "h"), rest)
    recipe = spark.createDataFrame(
        [(s, n, want[s], full[s], below[s]) for s, n in size.items()],
        "s string, source_size long, target double, full long, below long")
    times = F.col("full") + (F.col("h") < F.col("below")).cast("long")
    return (sized.join(F.broadcast(recipe), F.col("source").eqNullSafe(F.col("s")))
            .select("doc_id", "source", "size", "source_size", "target",
                    (F.col("size") * times).alias("taken"), times.alias("times"), *keep))


def mixture(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST,
            id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of the mix, columns unchanged: each document as often as it is taken."""
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
    x = rows.select("row", *[F.col(f"row.`{c}`").alias(a) for c, a in (
        (id_col, "i"), (text_col, "t"), (source_col, "s"))])
    taken = mix(x, weights, share, most, "i", "t", "s", keep=("row",)).filter("times > 0")
    return (taken.select("row", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("n"))
            .select("row.*"))


ORACLE = """
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ' ' || coalesce(text, '')), 1, 15))::BIGINT AS h
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS n,
         [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1]::DOUBLE AS w
  FROM d GROUP BY source),
r AS (
  SELECT *, 2.0 * n / w AS ratio, row_number() OVER (ORDER BY 2.0 * n / w, source NULLS LAST) AS i,
         coalesce(sum(2.0 * n) OVER (ORDER BY 2.0 * n / w, source NULLS LAST
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cut,
         sum(w) OVER (ORDER BY 2.0 * n / w DESC, source DESC NULLS FIRST) AS wrest
  FROM s),
l AS (SELECT *, (1.5 * (SELECT sum(n) FROM s) - cut) / wrest AS unit FROM r),
u AS (SELECT min_by(unit, i) AS unit FROM l WHERE unit <= ratio),
t AS (
  SELECT source, n, least(2.0 * n, (SELECT unit FROM u) * w)::DOUBLE AS target FROM s),
k AS (
  SELECT *, CASE WHEN n = 0 THEN 0 ELSE least(2, floor(target / n)) END::BIGINT AS full_times FROM t),
c AS (
  SELECT doc_id, d.source, size, h, n, target, full_times,
         CASE WHEN full_times < 2 THEN target - full_times * n ELSE 0 END AS rest,
         sum(size) OVER (PARTITION BY d.source ORDER BY h) AS upto,
         sum(size) OVER (PARTITION BY d.source, h) AS own
  FROM d JOIN k ON d.source IS NOT DISTINCT FROM k.source)
SELECT doc_id, size, n AS source_size, target,
       (size * (full_times + CASE WHEN rest > 0 AND (upto <= rest OR
          (upto - own <= rest AND upto - rest < rest - (upto - own))) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c
"""
