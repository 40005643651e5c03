"""Quality rules whose thresholds limit false rejection at a stated risk.

Base rules hold for every document (enough words, few repeated passages).
On top of them every rule of ``RULES`` compares one text statistic with a
cutoff, and the cutoff is chosen from labelled documents, for each stratum
(language) on its own. A candidate cutoff is certified when the exact
binomial test rejects "the rule drops more than ``risk / rules`` of the good
documents". The cutoffs of a rule are tested in a fixed order, the most
lenient first, each at level ``delta / (strata x rules)``, up to the first
that fails: in a fixed sequence no further correction is needed, as a wrong
certificate takes an error at the first cutoff that deserves none (Bonferroni
over strata and rules, fixed sequence inside). So with probability 1 - delta
every stratum loses at most ``risk`` of its good documents to all its rules
together, whatever certified cutoff is then picked. Of those the rule takes
the cutoff with the largest (bad documents dropped - ``cost`` x good
documents dropped), the most lenient of equals; without a certified cutoff
that drops more bad than that, the rule is off in that stratum.

Text statistics and verdicts are DataFrame functions in one narrow pass;
the labelled counts are one grouped aggregate with two rows per stratum.

Defined results: a null or empty text has no words and fails the base rules;
a null language is a stratum of its own; null or repeated labels: a document
counts once, with its lowest label, and documents without label are not
counted; with no labels only the base rules act; an empty table gives no
rows; other columns are passed through, in ``judge`` a clashing name of
theirs is replaced by the statistic.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sinter.llm.common import SPACE, store

BLANK = " \t\n\x0b\x0c\r"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
RISK, DELTA, COST = 0.05, 0.05, 20.0

# statistic -> candidate cutoffs; a document is dropped above its cutoff.
# Shares are in thousandths so that all comparisons are between integers.
RULES: dict[str, tuple[int, ...]] = {
    "symbol_share": (10, 20, 30, 50, 80, 120, 200, 300),
    "dup_line_share": (50, 100, 200, 300, 400, 500, 600, 800),
    "repeat_share": (20, 50, 100, 150, 200, 250),
    "upper_share": (100, 200, 300, 400, 500, 700),
}
# largest values of n at which "first to last of n" keeps arrays equally long
_STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _pairs(arr: Column, step: int) -> tuple[Column, Column]:
    """The elements that have one ``step`` later, and those later ones."""
    n = F.greatest(F.size(arr) - step, F.lit(0))
    return F.slice(arr, F.lit(1), n), F.slice(arr, F.lit(step + 1), n)


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the five counts and the rule shares of every text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    x = docs.drop(*_STATS, *RULES, "__w", "__l", "__h", "__p")
    body = F.btrim(text, F.lit(BLANK))
    x = x.withColumn("__w", F.when(body == "", F.array().cast("array<string>"))
                     .otherwise(F.split(body, SPACE + "+")))
    lines = F.filter(F.split(text, "\n"), lambda s: F.btrim(s, F.lit(BLANK)) != "")
    x = x.withColumn("__l", lines)
    x = x.withColumn("n_words", F.size("__w").cast("long"))
    x = x.withColumn("word_chars", F.char_length(F.array_join("__w", "")).cast("long"))
    x = x.withColumn("n_symbols", F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"))
    x = x.withColumn("n_dup_lines", (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"))
    # hashes of windows of 1, 2, 4 and 8 words
    x = x.withColumn("__h", F.transform("__w", lambda w: F.xxhash64(w)))
    step = 1
    while step < WINDOW:
        a, b = _pairs(F.col("__h"), step)
        x = x.withColumn("__h", F.zip_with(a, b, lambda u, v: F.xxhash64(u, v)))
        step *= 2
    some = F.size(F.array_distinct("__h")) < F.size("__h")
    x = x.withColumn("__p", F.when(some, F.sort_array(F.transform(
        "__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    a, b = _pairs(F.col("__p"), 1)
    # places of windows that occur twice or more: equal neighbours when sorted
    at = F.flatten(F.zip_with(a, b, lambda u, v: F.when(
        u["h"] == v["h"], F.array(u["i"], v["i"])).otherwise(F.array().cast("array<int>"))))
    x = x.withColumn("__p", F.sort_array(F.array_distinct(at)))
    a, b = _pairs(F.col("__p"), 1)
    covered = F.aggregate(F.zip_with(a, b, lambda u, v: F.least(v - u, F.lit(WINDOW))),
                          F.lit(WINDOW), lambda s, d: s + d)
    x = x.withColumn("n_repeat_words", F.when(F.col("__p").isNull(), F.lit(0)).otherwise(covered).cast("long"))
    upper = F.regexp_count(text, F.lit("\\p{Lu}"))
    n_lines = F.size("__l")

    def share(part, whole):
        return F.when(whole > 0, F.floor(F.lit(1000) * part / whole)).otherwise(F.lit(0)).cast("long")

    x = x.withColumns({
        "symbol_share": share(F.col("n_symbols"), F.col("word_chars")),
        "dup_line_share": share(F.col("n_dup_lines"), n_lines),
        "repeat_share": share(F.col("n_repeat_words"), F.col("n_words")),
        "upper_share": share(upper, F.col("word_chars")),
    })
    failed = ((F.col("n_words") < MIN_WORDS)
              | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    return x.withColumn("base_failed", failed).drop("__w", "__l", "__h", "__p")


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(Bin(n, p) <= k), as the incomplete beta function I_{1-p}(n-k, k+1)."""
    if k >= n:
        return 1.0
    a, b, x = float(n - k), float(k + 1), 1.0 - p
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                     + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 / (1.0 - (a + b) * x / (a + 1.0) or tiny)
    f = d
    for m in range(1, 100_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 / ((1.0 + num * d) or tiny)
            c = (1.0 + num / c) or tiny
            f *= c * d
        if abs(c * d - 1.0) < 1e-14:
            break
    return f


def choose(counts: dict, risk: float = RISK, delta: float = DELTA, cost: float = COST,
           rules: dict[str, tuple[int, ...]] | None = None) -> dict:
    """Cutoffs {(stratum, rule): cutoff} from the labelled counts.

    ``counts[stratum][label]`` holds ``n`` and the documents above each
    cutoff under ``(rule, cutoff)``; label 1 is good, 0 bad.
    """
    rules = RULES if rules is None else rules
    tests = max(1, len(counts) * len(rules))
    out = {}
    for stratum, by in counts.items():
        good, bad = by.get(1), by.get(0)
        if not good or not bad:
            continue
        for rule, cutoffs in rules.items():
            best = 0.0
            for cutoff in sorted(cutoffs, reverse=True):
                wrong, right = good[rule, cutoff], bad[rule, cutoff]
                if binomial_cdf(wrong, good["n"], risk / len(rules)) > delta / tests:
                    break
                if right - cost * wrong > best:
                    best = right - cost * wrong
                    out[stratum, rule] = cutoff
    return out


def calibrate(stats: DataFrame, labels: DataFrame, stratum: str = "lang", id_col: str = "doc_id",
              risk: float = RISK, delta: float = DELTA, cost: float = COST) -> dict:
    """Certified cutoffs {(stratum, rule): cutoff} of a statistics table.
    Documents that fail the base rules aren't counted: no rule decides them."""
    # one label per document, null ids and labels aside
    known = (labels.select(F.col("doc_id").alias("__id"), F.col("quality").cast("int").alias("__q"))
             .filter("__id IS NOT NULL AND __q IN (0, 1)").groupBy("__id").agg(F.min("__q").alias("__q")))
    seen = stats.filter(~F.col("base_failed")).select(
        F.col(id_col).alias("__id"), F.col(stratum).alias("__s"), *RULES).join(known, "__id")
    sums = [F.count_if(F.col(r) > c).alias(f"{r}_{c}") for r, cs in RULES.items() for c in cs]
    counts: dict = {}
    for row in seen.groupBy("__s", "__q").agg(F.count("*").alias("n"), *sums).collect():
        counts.setdefault(row["__s"], {})[row["__q"]] = {"n": row["n"]} | {
            (r, c): row[f"{r}_{c}"] for r, cs in RULES.items() for c in cs}
    return choose(counts, risk, delta, cost)


def verdict(cutoffs: dict, stratum: str = "lang") -> Column:
    """Is the document kept by the base rules and the certified cutoffs?"""
    dropped = F.col("base_failed")
    for s in {s for s, _ in cutoffs}:
        hit = F.lit(False)
        for (t, rule), cutoff in cutoffs.items():
            if t == s:
                hit = hit | (F.col(rule) > cutoff)
        dropped = dropped | (F.col(stratum).eqNullSafe(F.lit(s)) & hit)
    return ~dropped


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", text_col: str = "text",
          id_col: str = "doc_id", keep: tuple[str, ...] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with statistics and ``kept``."""
    stats = with_statistics(docs, text_col)
    if keep is not None:
        stats = stats.select(*keep, *_STATS, *RULES, "base_failed")
    stats = store(stats, "quality-statistics")
    return stats.withColumn("kept", verdict(calibrate(stats, labels, stratum, id_col), stratum))


def keep_good(docs: DataFrame, labels: DataFrame, stratum: str = "lang", text_col: str = "text",
              id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that the rules keep, columns unchanged."""
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
    x = rows.select("row", *[F.col(f"row.`{c}`").alias(c) for c in dict.fromkeys((id_col, stratum, text_col))])
    return judge(x, labels, stratum, text_col, id_col, keep=("row", id_col, stratum)).filter("kept").select("row.*")
