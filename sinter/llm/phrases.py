r"""Phrase collocations per language.

Texts are cut into pieces at punctuation and line ends, pieces into words,
and every run of 1 to ``MOST`` words of a piece is an n-gram. A phrase is a
candidate if its language holds it ``THRESHOLD`` times or more.

1. Every n-gram is hashed with its language. The leading bits of the hash
   name one of the hash partitions, the next 32 the n-gram within it. A task
   counts slices of text and sends each partition a summary: sorted hashes
   as differences, with counts, compressed. The partition merges them as
   Misra-Gries summaries: whenever more than ``capacity`` counters are left,
   the next largest count is taken off all of them and those at zero go.
   The capacity is ``SPARE`` * mass / THRESHOLD + 1, where the mass, all
   n-grams of the partition, is read before its first summary. Counts come
   out too small by at most mass / capacity in sum, so every n-gram that may
   reach the threshold survives; n-grams that share a hash only add up.
   Survivors set a bit in a map of 2^27 bits.
2. The texts are read again. N-grams whose bit is set, and whose first words
   were counted too, are counted exactly, as words, first in the task, then
   in their hash partition, to which each task sends its phrases in one
   compressed parcel. The map only spares work: what the threshold keeps is
   decided by exact counts.

Scores compare a phrase with its two parts at its weakest cut,
floor(1000 a n / (l r)) in 38-digit arithmetic, and a candidate goes if a
longer one around it is as frequent. A language's best ``limit`` phrases are
found in salted groups first, so no task sorts all phrases of a language.

Memory: a hash partition holds 256 MB of text at most, so a summary has
about 10 million counters at most; a task holds ``BATCH`` hashes. The map
has a fixed size: with far more than 2^27 survivors it spares less, and
step 2 shuffles more.

Defined results: a null language counts as ``und``; null and empty texts
have no words; letters A-Z are lower-cased, others stay; repeated rows count
as often as they occur; ties go by score, count, then phrase in byte order;
a long text is cut into pieces like any other, and is worked on a few MB at
a time; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sinter.llm.common import map_arrow, store, text_bytes

THRESHOLD = 100
MOST = 5
LIMIT = 2000
SPARE = 4
LEAST_BITS = 6        # of the hash partitions: 64 at least
PART_BYTES = 1 << 28  # of text for each hash partition
MAP_BITS = 27
CHUNK = 4 << 20
BATCH = 1 << 22
HELD_ROWS = 400_000   # counted n-grams that a task holds in pass 2

_WORD, _BLANK, _CUT = 0, 1, 2
_CLASS = np.zeros(256, np.uint8)
_CLASS[[32, 9]] = _BLANK
_CLASS[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = _CUT
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_M = np.uint64(0x9E3779B97F4A7C15)
_M2 = np.uint64(0xC2B2AE3D27D4EB4F)
_POWERS = np.cumprod(np.full(64, 0x100000001B3, np.uint64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _M
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


# ------------------------------------------------------------ words
class Words:
    """Words of a chunk: their bytes, text, and how many words their piece
    has from each one on."""

    def __init__(self, data: np.ndarray, starts_of_texts: np.ndarray, text: np.ndarray):
        kind = _CLASS[data]
        inside = kind == _WORD
        fresh = np.zeros(len(data), bool)
        fresh[starts_of_texts] = True
        begin = inside.copy()
        begin[1:] &= ~inside[:-1] | fresh[1:]
        at = np.flatnonzero(begin)
        # pieces: texts and punctuation begin a new one
        piece = np.cumsum((kind == _CUT) | fresh, dtype=np.int32)[at]
        last = np.flatnonzero(np.append(piece[1:] != piece[:-1], True)) if len(at) else at
        self.run = last[np.searchsorted(last, np.arange(len(at)))] + 1 - np.arange(len(at))
        self.letters = data[inside]
        self.at = np.flatnonzero(begin[inside])
        self.text = text[np.searchsorted(starts_of_texts, at, "right") - 1]

    def __len__(self):
        return len(self.at)

    def hashes(self) -> np.ndarray:
        size = np.diff(self.at, append=len(self.letters))
        pos = np.arange(len(self.letters)) - np.repeat(self.at, size)
        with np.errstate(over="ignore"):
            v = (self.letters.astype(np.uint64) + np.uint64(1)) * _POWERS[pos & 63]
            if len(size) and size.max() > 64:
                v += (pos >> 6).astype(np.uint64) * _M2 * self.letters
            return _mix(np.add.reduceat(v, self.at) + size.astype(np.uint64))

    def strings(self) -> pa.Array:
        off = np.append(self.at, len(self.letters)).astype(np.int64)
        return pa.LargeStringArray.from_buffers(len(self.at), pa.py_buffer(off), pa.py_buffer(self.letters.tobytes()))


def chunks(texts: pa.Array):
    """``Words`` of a column of texts, some MB at a time, cut between pieces."""
    data, off = text_bytes(texts)
    data = _LOWER[data]
    full = np.flatnonzero(np.diff(off))  # texts that have bytes
    begins = off[:-1][full]
    edges = np.union1d(begins, np.flatnonzero(_CLASS[data] == _CUT) + 1)
    a = 0
    while a < len(data):
        near, far = np.searchsorted(edges, [a + 1, a + CHUNK + 1])
        b = edges[far - 1] if far > near else edges[near] if near < len(edges) else len(data)
        b = len(data) if len(data) - a <= CHUNK else int(b)
        lo, hi = np.searchsorted(begins, a, "right") - 1, np.searchsorted(begins, b)
        words = Words(data[a:b], np.maximum(begins[lo:hi] - a, 0), full[lo:hi])
        if len(words):
            yield words
        a = b


def grams(words: Words, seed: np.ndarray, most: int = MOST):
    """(k, first words, hashes) of all n-grams of 1 to ``most`` words, where
    ``seed`` is the hash of each word's language."""
    w = words.hashes()
    with np.errstate(over="ignore"):
        h, at = _mix(w ^ seed), np.arange(len(w))
        yield 1, at, h
        for k in range(2, most + 1):
            keep = words.run[at] >= k
            at = at[keep]
            h = _mix(h[keep] * _M2 + w[at + k - 1])
            yield k, at, h


def languages(batch: pa.RecordBatch, column: int) -> tuple[list[str], np.ndarray]:
    """(names, code of each row); null is ``und``."""
    coded = pc.dictionary_encode(batch.column(column).cast(pa.string()).fill_null("und"))
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)


def _seeds(names: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(n.encode(), 12) for n in names], np.uint64)


# ------------------------------------------------------------ summaries
def pack_counts(low: np.ndarray, n: np.ndarray) -> bytes:
    """Sorted 32-bit hashes and counts, byte plane by byte plane."""
    step = np.diff(low, prepend=np.uint32(0)).astype("<u4")
    planes = [x.view(np.uint8).reshape(-1, 4).T.tobytes() for x in (step, np.asarray(n, "<u4"))]
    return pa.compress(b"".join(planes), codec="zstd", asbytes=True)


def unpack_counts(blob: bytes, k: int) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(pa.decompress(blob, 8 * k, codec="zstd", asbytes=True), np.uint8).reshape(2, 4, k)
    step, n = (np.ascontiguousarray(x.T).view("<u4").ravel() for x in raw)
    return np.cumsum(step, dtype=np.uint32), n.astype(np.int64)


class Summary:
    """A Misra-Gries summary of 32-bit hashes with room for ``capacity``
    counters. Summaries that come in are merged some at a time."""

    def __init__(self, capacity: int):
        self.capacity, self.error = capacity, 0
        self.hash, self.count = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.rows = 0

    def add(self, hashes: np.ndarray, counts: np.ndarray) -> None:
        self.waiting.append((hashes, counts))
        self.rows += len(hashes)
        if self.rows > max(self.capacity, 1 << 20):
            self.merge()

    def merge(self) -> None:
        h = np.concatenate([self.hash, *(x for x, _ in self.waiting)])
        n = np.concatenate([self.count, *(x for _, x in self.waiting)])
        self.waiting, self.rows = [], 0
        if not len(h):
            return
        order = np.argsort(h, kind="stable")
        h, n = h[order], n[order]
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        h, n = h[first], np.add.reduceat(n, first)
        if len(h) > self.capacity:
            cut = len(h) - self.capacity - 1
            take = int(np.partition(n, cut)[cut])  # the largest count that has no room
            keep = n > take
            h, n, self.error = h[keep], n[keep] - take, self.error + take
        self.hash, self.count = h, n

    def survivors(self, threshold: int) -> np.ndarray:
        """Hashes whose count may reach ``threshold``."""
        self.merge()
        return self.hash[self.count + self.error >= threshold]


def summaries(texts: DataFrame, bits: int) -> DataFrame:
    """(p, kind, mass, n, counts): for each hash partition p the mass of each
    slice of text (kind 0) and its counts (kind 1)."""
    def count(batches):
        held, rows = [], 0

        def flush():
            top = np.concatenate(held) >> np.uint64(32 - bits)
            top.sort()
            first = np.flatnonzero(np.append(True, top[1:] != top[:-1]))
            n = np.diff(first, append=len(top))
            top = top[first]
            part, low = (top >> np.uint64(32)).astype(np.int32), top.astype(np.uint32)
            cut = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            ends = np.append(cut[1:], len(part))
            mass = np.add.reduceat(n, cut)
            blobs = [pack_counts(low[a:b], n[a:b]) for a, b in zip(cut, ends)]
            k = len(cut)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.tile(part[cut], 2)), pa.array(np.repeat(np.array([0, 1], np.int8), k)),
                 pa.array(np.append(mass, np.zeros(k, np.int64))), pa.array(np.tile(ends - cut, 2)),
                 pa.array([None] * k + blobs, pa.binary())], names=["p", "kind", "mass", "n", "counts"])

        for batch in batches:
            names, code = languages(batch, 0)
            seed = _seeds(names)
            for words in chunks(batch.column(1)):
                for _, _, h in grams(words, seed[code[words.text]]):
                    held.append(h)
                    rows += len(h)
                    if rows >= BATCH:
                        yield from flush()
                        held, rows = [], 0
        if rows:
            yield from flush()

    return map_arrow(texts, count, "p int, kind byte, mass long, n long, counts binary")


def survivor_map(texts: DataFrame, bits: int, threshold: int = THRESHOLD, spare: int = SPARE) -> np.ndarray:
    """2^MAP_BITS bits, as bytes: set where the hash of an n-gram that may
    reach ``threshold`` begins with the bit's number."""
    width = 1 << (MAP_BITS - bits)  # bits of the map for each hash partition

    def finish(p, summary):
        own = np.zeros(width, bool)
        own[summary.survivors(threshold) >> np.uint32(32 + bits - MAP_BITS)] = True
        return pa.RecordBatch.from_arrays(
            [pa.array([p], pa.int32()), pa.array([pa.compress(np.packbits(own).tobytes(), codec="zstd", asbytes=True)])],
            names=["p", "bits"])

    def merge(batches):
        at, mass, summary = None, 0, None
        for batch in batches:
            cols = [batch.column(i) for i in range(5)]
            for i in range(batch.num_rows):
                p, kind, m, n = (c[i].as_py() for c in cols[:4])
                if p != at:
                    if summary is not None:
                        yield finish(at, summary)
                    at, mass, summary = p, 0, None
                if kind == 0:
                    mass += m
                    continue
                if summary is None:
                    summary = Summary(spare * mass // threshold + 1)
                summary.add(*unpack_counts(cols[4][i].as_py(), n))
        if summary is not None:
            yield finish(at, summary)

    rows = summaries(texts, bits).repartition(1 << bits, "p").sortWithinPartitions("p", "kind")
    out = np.zeros((1 << MAP_BITS) // 8, np.uint8)
    size = width // 8
    # 2^MAP_BITS bits in all, whatever the input
    for r in map_arrow(rows, merge, "p int, bits binary").collect():
        raw = pa.decompress(r["bits"], size, codec="zstd", asbytes=True)
        out[r["p"] * size:(r["p"] + 1) * size] = np.frombuffer(raw, np.uint8)
    return out


# ------------------------------------------------------------ exact counts
def _alive(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h >> np.uint64(64 - MAP_BITS)
    return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (7 - (at & np.uint64(7))).astype(np.uint8) & 1).astype(bool)


_COUNTS = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("k", pa.int32()), ("f", pa.int64())])
_PLACED = pa.schema([("p", pa.int32()), *_COUNTS])


def count_chunk(words: Words, names: list[str], code: np.ndarray, seed: np.ndarray, bitmap: np.ndarray, bits: int):
    """Tables (p, lang, phrase, k, f) of the n-grams of a chunk that the map
    lets through, with their hash partition; k = 0 and no phrase for the
    number of words."""
    lang = code[words.text]
    total = np.bincount(lang, minlength=len(names))
    some = np.flatnonzero(total)
    name = pa.array(names, pa.string())
    none = np.zeros(len(some), np.int32)
    yield pa.table([pa.array(none), name.take(pa.array(some)), pa.nulls(len(some), pa.string()), pa.array(none),
                    pa.array(total[some])], schema=_PLACED)
    coded = pc.dictionary_encode(words.strings())
    w = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    spelt = coded.dictionary.cast(pa.string())
    v = len(spelt)
    before = lang.astype(np.int64)  # of each word: what comes before the next one, as a code
    counted = np.ones(len(w), bool)
    for k, at, h in grams(words, seed[lang]):
        keep = counted[at] & _alive(bitmap, h)
        hit, h = at[keep], h[keep]
        counted = np.zeros(len(w), bool)
        if not len(hit):
            return
        _, first, back, n = np.unique(before[hit] * v + w[hit + k - 1], return_index=True, return_inverse=True,
                                      return_counts=True)
        counted[hit] = True
        before[hit] = back
        begin = hit[first]
        parts = [spelt.take(pa.array(w[begin + j])) for j in range(k)]
        phrase = parts[0] if k == 1 else pc.binary_join_element_wise(*parts, " ")
        yield pa.table([pa.array((h[first] >> np.uint64(64 - bits)).astype(np.int32)), name.take(pa.array(lang[begin])),
                        phrase, pa.array(np.full(len(begin), k, np.int32)), pa.array(n)], schema=_PLACED)


def folded(held: list[pa.Table]) -> pa.Table:
    """One row per key of the tables, with the sum of f."""
    keys = held[0].column_names[:-1]
    t = pa.concat_tables(held)
    return t.group_by(keys).aggregate([("f", "sum")]).rename_columns([*keys, "f"]).select(t.column_names)


def _parcels(held: list[pa.Table]) -> pa.RecordBatch:
    """(p, counts): the summed tables, one Arrow stream per hash partition."""
    t = folded(held).sort_by("p")
    p = t["p"].to_numpy()
    cut = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
    rows, out = t.select(_COUNTS.names), []
    for a, b in zip(cut.tolist(), np.append(cut[1:], len(p)).tolist()):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, _COUNTS, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_table(rows.slice(a, b - a).combine_chunks())
        out.append(sink.getvalue().to_pybytes())
    return pa.RecordBatch.from_arrays([pa.array(p[cut], pa.int32()), pa.array(out, pa.binary())], names=["p", "counts"])


def exact_counts(texts: DataFrame, bitmap: np.ndarray, bits: int, threshold: int = THRESHOLD) -> DataFrame:
    """(lang, phrase, k, f) of all n-grams that occur ``threshold`` times or
    more in their language, and (lang, null, 0, number of words)."""
    shared = texts.sparkSession.sparkContext.broadcast(bitmap)

    def count(batches):
        held, rows = [], 0
        for batch in batches:
            names, code = languages(batch, 0)
            seed = _seeds(names)
            for words in chunks(batch.column(1)):
                for t in count_chunk(words, names, code, seed, shared.value, bits):
                    held.append(t)
                    rows += t.num_rows
                if rows > 2 * HELD_ROWS:
                    held = [folded(held)]
                    if held[0].num_rows > HELD_ROWS:
                        yield _parcels(held)
                        held = []
                    rows = sum(t.num_rows for t in held)
        if held:
            yield _parcels(held)

    def add(batches):
        at, held, rows = None, [], 0

        def done():
            t = folded(held)
            yield from t.filter((pc.field("k") == 0) | (pc.field("f") >= threshold)).combine_chunks().to_batches()

        for batch in batches:
            for p, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                if p != at and held:
                    yield from done()
                    held, rows = [], 0
                at = p
                held.append(pa.ipc.open_stream(blob.as_buffer()).read_all())
                rows += held[-1].num_rows
                if rows > 2 * HELD_ROWS:
                    held = [folded(held)]
                    # what is left grows with the partition's phrases, not with the tasks
                    rows = 0
        if held:
            yield from done()

    parcels = map_arrow(texts, count, "p int, counts binary")
    return map_arrow(parcels.repartition(1 << bits, "p").sortWithinPartitions("p"), add,
                     "lang string, phrase string, k int, f long")


# ------------------------------------------------------------ scores
def _between(first, size):
    return F.array_join(F.slice("words", first, size), " ")


def maximal(counts: DataFrame) -> DataFrame:
    """Phrases of two words or more without those that lie inside a longer
    one as frequent. The longer one may have one word more only: whatever
    lies between the two is as frequent as both."""
    phrases = counts.filter("k >= 2")
    words = phrases.filter("k >= 3").withColumn("words", F.split("phrase", " "))
    inner = words.select("lang", "f", F.explode(F.array(
        _between(F.lit(1), F.col("k") - 1), _between(F.lit(2), F.col("k") - 1))).alias("phrase"))
    around = inner.groupBy("lang", "phrase").agg(F.max("f").alias("around"))
    return (phrases.join(around, ["lang", "phrase"], "left")
            .filter("around IS NULL OR around < f").drop("around"))


def scored(counts: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of the maximal phrases."""
    j = F.col("j")
    cuts = (maximal(counts).withColumn("words", F.split("phrase", " "))
            .withColumn("j", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
            .select("lang", "phrase", F.col("f").alias("a"), "j", _between(F.lit(1), j).alias("head"),
                    _between(j + 1, F.col("k") - j).alias("tail")))
    part = counts.filter(f"k BETWEEN 1 AND {MOST - 1}")
    total = counts.filter("k = 0").select("lang", F.col("f").alias("n"))
    wide = "decimal(38,0)"
    score = F.expr(f"(1000 * CAST(a AS {wide}) * n) div (CAST(l AS {wide}) * r)")
    both = (cuts.join(part.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
            .join(part.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
            .join(total, "lang").withColumn("score", score))
    worst = F.min(F.struct("score", "j", "l", "r")).alias("w")
    return (both.groupBy("lang", "phrase", "a", "n").agg(worst)
            .select("lang", "phrase", "a", "w.l", "w.r", "n", "w.score"))


def leading(rows: DataFrame, limit: int = LIMIT, part: int = 50_000) -> DataFrame:
    """The best ``limit`` rows of each language with their rank. Languages of
    more than ``part`` rows keep the best of salted groups first."""
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]

    def top(df, *keys):
        return df.withColumn("rank", F.row_number().over(Window.partitionBy("lang", *keys).orderBy(*best))).filter(
            F.col("rank") <= limit)

    part = max(part, 2 * limit)
    while True:
        most = rows.groupBy("lang").count().agg(F.max("count")).first()[0] or 0
        if most <= part:
            return top(rows)
        salt = F.pmod(F.xxhash64("phrase"), F.lit(math.ceil(most / part))).alias("salt")
        rows = store(top(rows.select("*", salt), "salt").drop("rank", "salt"), "phrases-leading")


def collocations(docs: DataFrame, threshold: int = THRESHOLD, limit: int = LIMIT, lang_col: str = "lang",
                 text_col: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's best phrases."""
    texts = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(LEAST_BITS, math.ceil(math.log2(max(1, size / PART_BYTES))))
    bitmap = survivor_map(texts, bits, threshold)
    counts = store(exact_counts(texts, bitmap, bits, threshold), "phrases-counts")
    found = store(scored(counts), "phrases-scored")
    return leading(found, limit).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n",
                                        F.col("score").cast("long").alias("score"))


ORACLE = r"""
WITH pieces AS (
  SELECT COALESCE(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
runs AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
grams AS (
  SELECT lang, k, unnest([array_to_string(ws[i:i + k - 1], ' ') FOR i IN range(1, len(ws) - k + 2)]) AS phrase
  FROM runs, (SELECT unnest(range(1, 6)) AS k) WHERE len(ws) >= k),
counts AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
total AS (SELECT lang, sum(len(ws)) AS n FROM runs GROUP BY lang),
kept AS (
  SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM counts c
  WHERE k >= 2 AND NOT EXISTS (
    SELECT 1 FROM counts o WHERE o.lang = c.lang AND o.k > c.k AND o.f >= c.f
    AND contains(' ' || o.phrase || ' ', ' ' || c.phrase || ' '))),
cuts AS (
  SELECT lang, phrase, a, j, array_to_string(ws[1:j], ' ') AS head, array_to_string(ws[j + 1:k], ' ') AS tail
  FROM (SELECT *, unnest(range(1, k)) AS j FROM kept)),
scored AS (
  SELECT c.lang, c.phrase, c.a, j, h.f AS l, t.f AS r, n,
         (1000::HUGEINT * c.a * n) // (h.f::HUGEINT * t.f) AS score
  FROM cuts c JOIN counts h ON h.lang = c.lang AND h.phrase = c.head
  JOIN counts t ON t.lang = c.lang AND t.phrase = c.tail JOIN total ON total.lang = c.lang),
worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase,
       a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM worst
QUALIFY rank <= 2000
"""
