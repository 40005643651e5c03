"""URL filter lists with dates: every capture is judged by the entries that
were active when it was fetched.

A list is a history of dated entries (pattern, day, action): ``block`` and
``allow`` put a host or domain on the list, ``remove`` takes it off. Entries
of one pattern become validity intervals [day, next day of the pattern). A
capture matches the patterns that are its host or a parent domain of it; of
those active on the day of the fetch the longest decides, so a host can be
allowed under a blocked domain.

What decides is the pair of host and day, so captures are reduced to
distinct pairs first, with their number (a very common host is one row per
day from there on). The as-of join is an equi-join of the pairs' patterns
with the intervals of the pattern, and the interval that holds the day; it
finds one interval at most. Verdicts go back to the captures by host and
day; pairs with very many captures are dealt out by salt.

Defined results: a null or malformed URL has no host, nor has one whose host
is longer than the 253 characters that the domain name system allows; and a capture without
host or day is not blocked and has no pattern; several entries of one
pattern on one day: block wins over allow, allow over remove; entries with a
null part don't count; repeated captures are judged each; empty tables give
no rows or no matches; other columns of the captures are passed on, a
clashing name of theirs is replaced by the result's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# captures of a pair that share a salt, and how many pairs may need one
PART, MOST_SALTED = 50_000, 100_000
MAX_HOST = 253
HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)"


def host_of(url: Column) -> Column:
    """Lower-case host of a URL; null where there is none."""
    host = F.lower(F.regexp_extract(url, HOST, 1))
    name = F.rtrim(host, F.lit("."))
    return F.when((host != "") & (F.char_length(name) <= MAX_HOST), name)


def domains_of(host: Column) -> Column:
    """The host and all its parent domains, longest first."""
    parts = F.split(host, "\\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)),
                       lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, action, since, until) of the entries that put a pattern on
    the list; ``until`` is null while nothing follows."""
    order = F.when(F.col("action") == "block", 2).when(F.col("action") == "allow", 1).otherwise(0)
    daily = (entries.filter("pattern IS NOT NULL AND day IS NOT NULL AND action IS NOT NULL")
             .groupBy(F.lower("pattern").alias("pattern"), F.col("day").cast("date").alias("since"))
             .agg(F.max_by("action", order).alias("action")))
    following = F.lead("since").over(Window.partitionBy("pattern").orderBy("since"))
    return daily.withColumn("until", following).filter(F.col("action").isin("block", "allow"))


def verdicts(pairs: DataFrame, entries: DataFrame) -> DataFrame:
    """(host, day, pattern, action) of the (host, day) pairs that an entry decides."""
    asked = pairs.select("host", "day", F.explode(domains_of(F.col("host"))).alias("pattern"))
    # every pattern is looked up once a day, whatever hosts ask
    once = asked.select("pattern", "day").distinct()
    found = (once.join(intervals(entries), "pattern")
             .filter((F.col("day") >= F.col("since")) & (F.col("until").isNull() | (F.col("day") < F.col("until"))))
             .select("pattern", "day", "action"))
    return (asked.join(found, ["pattern", "day"]).groupBy("host", "day")
            .agg(F.max_by(F.struct("pattern", "action"), F.char_length("pattern")).alias("x"))
            .select("host", "day", "x.pattern", "x.action"))


def judge(captures: DataFrame, entries: DataFrame, url_col: str = "url", day: str = "fetch_day") -> DataFrame:
    """``captures`` with host, pattern, action and blocked."""
    own = [c for c in captures.columns if c not in ("host", "pattern", "action", "blocked")]
    x = captures.select(*own, host_of(F.col(url_col)).alias("host"))
    pairs = x.filter(F.col("host").isNotNull() & F.col(day).isNotNull()).groupBy(
        "host", F.col(day).cast("date").alias("day")).agg(F.count("*").alias("n"))
    decided = verdicts(pairs, entries).join(pairs, ["host", "day"])
    # no more than MOST_SALTED pairs can be that common
    part = max(PART, -(-captures.count() // MOST_SALTED))
    salts = F.floor(F.col("n") / part).cast("int")
    big = F.broadcast(pairs.filter(F.col("n") >= part).select(
        F.col("host").alias("__h"), F.col("day").alias("__d"), (salts + 1).alias("__m")))
    right = decided.withColumn("__salt", F.explode(F.sequence(F.lit(0), salts))).select(
        F.col("host").alias("__host"), F.col("day").alias("__day"), "__salt", "pattern", "action")
    left = x.join(big, (F.col("host") == F.col("__h")) & (F.col(day).cast("date") == F.col("__d")), "left").withColumn(
        "__s", F.coalesce(F.pmod(F.monotonically_increasing_id(), F.col("__m")).cast("int"), F.lit(0)))
    out = left.join(right, (F.col("host") == F.col("__host")) & (F.col(day).cast("date") == F.col("__day"))
                    & (F.col("__s") == F.col("__salt")), "left")
    return out.select(*own, "host", "pattern", "action", F.coalesce(F.col("action") == "block", F.lit(False)).alias("blocked"))


def digits(text: Column, n: int = 7) -> Column:
    """A number from the md5 of a text, the same in every engine."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, n), 16, 10).cast("long")


def list_history(hosts: DataFrame) -> DataFrame:
    """A list history derived from the hosts themselves: of every second
    host and every third parent domain, three dated entries."""
    names = hosts.select("host").distinct()
    of = names.select(F.col("host").alias("pattern"), F.lit(2).alias("every")).unionByName(
        names.select(F.element_at(F.split("host", "\\."), 1).alias("first"), "host")
        .filter(F.size(F.split("host", "\\.")) > 2)
        .select(F.expr("substr(host, length(first) + 2)").alias("pattern"), F.lit(3).alias("every")).distinct())
    of = of.filter(F.pmod(digits(F.concat("pattern", F.lit("?"))), F.col("every")) == 0).select("pattern").distinct()
    x = of.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn(
        "d", digits(F.concat("pattern", F.lit("#"), F.col("k").cast("string"))))
    return x.select("pattern", F.expr("date_add(DATE'2024-01-01', cast(d % 365 AS int))").alias("day"),
                    F.expr("CASE d DIV 365 % 4 WHEN 0 THEN 'allow' WHEN 1 THEN 'remove' ELSE 'block' END").alias("action"))


def captures_of(pages: DataFrame) -> DataFrame:
    """Pages as captures, the fetch day derived from the page's id."""
    return pages.select("page_id", "url", F.expr(
        "date_add(DATE'2024-01-01', cast(pmod(page_id * 37, 400) AS int))").alias("fetch_day"))


ORACLE = r"""
WITH u AS (
  SELECT page_id, url, DATE '2024-01-01' + ((page_id * 37) % 400)::INT AS fetch_day,
         nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '') AS named
  FROM pages),
c AS (SELECT page_id, url, fetch_day, CASE WHEN length(named) <= 253 THEN named END AS host FROM u),
h AS (SELECT DISTINCT host FROM c WHERE host IS NOT NULL),
o AS (
  SELECT host AS pattern, 2 AS every FROM h
  UNION SELECT substr(host, instr(host, '.') + 1), 3 FROM h WHERE len(string_split(host, '.')) > 2),
p AS (SELECT DISTINCT pattern FROM o WHERE ('0x' || substr(md5(pattern || '?'), 1, 7))::BIGINT % every = 0),
n AS (SELECT pattern, ('0x' || substr(md5(pattern || '#' || k), 1, 7))::BIGINT AS d FROM p, range(3) t(k)),
e AS (
  SELECT pattern, DATE '2024-01-01' + (d % 365)::INT AS day,
         CASE (d // 365) % 4 WHEN 0 THEN 'allow' WHEN 1 THEN 'remove' ELSE 'block' END AS action FROM n),
f AS (
  SELECT pattern, day, max_by(action, CASE action WHEN 'block' THEN 2 WHEN 'allow' THEN 1 ELSE 0 END) AS action
  FROM e GROUP BY ALL),
m AS (
  SELECT c.page_id, f.pattern, f.action, f.day, row_number() OVER (
    PARTITION BY c.page_id, f.pattern ORDER BY f.day DESC) AS latest
  FROM c JOIN f ON (c.host = f.pattern OR ends_with(c.host, '.' || f.pattern)) AND f.day <= c.fetch_day),
x AS (
  SELECT page_id, max_by(pattern, length(pattern)) AS pattern, max_by(action, length(pattern)) AS action
  FROM m WHERE latest = 1 AND action <> 'remove' GROUP BY page_id)
SELECT c.page_id, url, fetch_day, host, pattern, action, coalesce(action = 'block', false) AS blocked
FROM c LEFT JOIN x USING (page_id)
"""
