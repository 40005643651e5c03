"""Near duplicates by SimHash, found through deletion variants.

A text's fingerprint has 64 bits: bit b is 1 if more than half of the hashes
(XXH64, seed 42) of its 3-word shingles, repeats included, have bit b.
Fingerprints link at ``DISTANCE`` = 2 or fewer differing bits, and linked
ones form components.

Links are found among distinct fingerprints. They are cut into two segments
of 32 bits only: two fingerprints that differ in two bits at most have a
segment in which they differ in one bit at most. Each segment is indexed as
it is and, for each of its bits, with that bit deleted (a wildcard in its
place): 66 keys a fingerprint. Fingerprints meet in an equality join on
these keys and are verified by counting the bits that differ:

* equal segments meet under the whole segment;
* segments that differ in bit j meet under the variant without bit j, where
  those with bit j set are compared with those without it alone.

A key of more than ``CROWD`` members isn't compared at all. Its members are
indexed once more by their whole fingerprints with every two bits deleted,
2 016 keys each: all that share such a key are within two bits of each
other, so each key links its members to the smallest one, and nothing is
left out or compared pair by pair.

Defined results: letters A-Z are lower-cased; a text of one or two words is
one shingle; a text that is null or has no word has fingerprint zero, which
links like any other; equal fingerprints are one component; a null id never
names a component that has another id; repeated rows are equal texts; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sinter.llm.common import map_arrow, store
from sinter.llm.neardup import components

SHINGLE = 3
SEED = 42
DISTANCE = 2
CROWD = 1024
CHUNK = 4 << 20    # bytes of a text that are in work at a time
FLUSH = 1 << 18    # hashes that are counted at a time

_LOW = np.uint64(0xFFFFFFFF)


# ------------------------------------------------------------ fingerprints
def word_chunks(text: bytes):
    """Lower-cased words of a text, as lists; a long text in several."""
    at = 0
    while at < len(text):
        end = min(at + CHUNK, len(text))
        while end < len(text) and text[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        words = text[at:end].lower().split()
        if words:
            yield words
        at = end


def shingle_hashes(text: bytes):
    """Lists of the hashes of a text's shingles."""
    kept: list[bytes] = []
    some = False
    for words in word_chunks(text):
        words = kept + words
        if len(words) >= SHINGLE:
            some = True
            joined = b" ".join(words)
            ends = np.cumsum([len(w) + 1 for w in words])
            first = np.append(0, ends[:-SHINGLE]).tolist()
            last = (ends[SHINGLE - 1:] - 1).tolist()
            digest = xxhash.xxh64_intdigest
            yield [digest(joined[a:b], SEED) for a, b in zip(first, last)]
        kept = words[-(SHINGLE - 1):]
    if kept and not some:
        yield [xxhash.xxh64_intdigest(b" ".join(kept), SEED)]


def fingerprints(texts) -> np.ndarray:
    """Fingerprint, as uint64, of every text (bytes or None)."""
    ones = np.zeros((len(texts), 64), np.int64)
    total = np.zeros(len(texts), np.int64)
    hashes: list[int] = []
    owner: list[tuple[int, int]] = []

    def count():
        h = np.array(hashes, ">u8")
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1)
        who = np.array([i for i, _ in owner])
        n = np.array([k for _, k in owner])
        np.add.at(ones, who, np.add.reduceat(bits, np.cumsum(n) - n, axis=0, dtype=np.int64))
        np.add.at(total, who, n)
        hashes.clear()
        owner.clear()

    for i, text in enumerate(texts):
        for some in shingle_hashes(text or b""):
            hashes += some
            owner.append((i, len(some)))
            if len(hashes) >= FLUSH:
                count()
    if hashes:
        count()
    bits = (2 * ones > total[:, None]).astype(np.uint8)
    return np.packbits(bits, axis=1).view(">u8").ravel().astype(np.uint64)


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) of every row; fp as a signed long."""
    def sign(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            fp = fingerprints([t.as_py() for t in texts])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_arrow(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), sign,
                     f"id {kind}, fp long")


# ------------------------------------------------------------ links
def segment_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(variant, key) of 66 keys a fingerprint, variant by variant: segment s
    whole is variant 33 s, without its bit j it is variant 33 s + 1 + j. The
    key holds the variant above the segment's bits."""
    variant, key = [], []
    for s in (0, 1):
        seg = (fp >> np.uint64(32 * s)) & _LOW
        for j in range(-1, 32):
            v = 33 * s + 1 + j
            bit = np.uint64(1 << j) if j >= 0 else np.uint64(0)
            variant.append(np.full(len(fp), v, np.int32))
            key.append((np.uint64(v) << np.uint64(32)) | (seg & ~bit))
    return np.concatenate(variant), np.concatenate(key).view(np.int64)


def spread(x: np.ndarray, close: np.ndarray) -> list[tuple[int, int]]:
    """Links that join what the matrix ``close`` [n, n] connects: a tree of
    each component, no list of pairs."""
    n = len(x)
    left = np.ones(n, bool)
    links = []
    for i in range(n):
        if not left[i]:
            continue
        left[i] = False
        todo = [i]
        while todo:
            j = todo.pop()
            new = np.flatnonzero(close[j] & left)
            left[new] = False
            links += [(int(x[j]), int(x[k])) for k in new]
            todo += new.tolist()
    return links


def bucket_links(variant: int, fp: np.ndarray) -> list[tuple[int, int]]:
    """Links within one key's members (distinct fingerprints)."""
    j = variant % 33 - 1
    if j >= 0:
        up = ((fp >> np.uint64(32 * (variant // 33) + j)) & np.uint64(1)).astype(bool)
        if up.all() or not up.any():
            return []
        a, b = fp[up], fp[~up]
        ab = np.bitwise_count(a[:, None] ^ b[None, :]) <= DISTANCE
        if not ab.any():
            return []
        close = np.zeros((len(fp), len(fp)), bool)
        close[:len(a), len(a):] = ab
        close[len(a):, :len(a)] = ab.T
        return spread(np.concatenate([a, b]), close)
    close = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= DISTANCE
    np.fill_diagonal(close, False)
    return spread(fp, close) if close.any() else []


def _meet(batches, most: int):
    """Sorted (key, fp) rows -> links (a, b), and (a, null) for each member
    of a crowd. A key is carried from batch to batch; of a crowd, nothing."""
    held_key, held, crowd = None, np.zeros(0, np.uint64), False

    def close_run(key, fp, out):
        if len(fp) > 1:
            out += bucket_links(key >> 32, fp)

    for batch in batches:
        key = batch.column(0).to_numpy(zero_copy_only=False)
        fp = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
        out: list[tuple[int, int | None]] = []
        cut = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        end = np.append(cut[1:], len(key))
        # keys of one member need no visit, but for the first and the last
        busy = np.flatnonzero((end - cut > 1) | (cut == 0) | (end == len(key)))
        for i in busy.tolist():
            k, own = int(key[cut[i]]), fp[cut[i]:end[i]]
            if k != held_key:
                if not crowd and held_key is not None:
                    close_run(held_key, held, out)
                held_key, held, crowd = k, np.zeros(0, np.uint64), False
            if not crowd and len(held) + len(own) > most:
                crowd, own, held = True, np.concatenate([held, own]), np.zeros(0, np.uint64)
            if crowd:
                out += [(int(x), None) for x in own]
            else:
                held = np.concatenate([held, own])
        yield _link_batch(out)
    if held_key is not None and not crowd:
        out = []
        close_run(held_key, held, out)
        yield _link_batch(out)


def _link_batch(pairs) -> pa.RecordBatch:
    a = np.array([p[0] for p in pairs], np.uint64).view(np.int64)
    b = pa.array([None if p[1] is None else p[1] - (1 << 64) if p[1] >> 63 else p[1] for p in pairs], pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(a), b], names=["a", "b"])


def crowd_links(fps: DataFrame) -> DataFrame:
    """Links (a, b) among ``fps`` (column a) by keys without any two bits:
    whoever shares one is within two bits."""
    def variants(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for lo in range(0, len(fp), 4096):
                some = fp[lo:lo + 4096]
                for i in range(64):
                    js = np.arange(i)
                    mask = ~(np.uint64(1 << i) | (np.uint64(1) << js.astype(np.uint64)))
                    key = some[:, None] & mask[None, :]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.tile(64 * i + js, len(some)), pa.int32()), pa.array(key.ravel().view(np.int64)),
                         pa.array(np.repeat(some, i).view(np.int64))], names=["bits", "key", "fp"])

    rows = map_arrow(fps.select("a"), variants, "bits int, key long, fp long")
    least = F.min("fp").alias("a")
    # the smallest member of each key, then each member beside it
    low = rows.groupBy("bits", "key").agg(least, F.count("*").alias("n")).filter("n > 1").select("bits", "key", "a")
    return rows.join(low, ["bits", "key"]).filter("a <> fp").select("a", F.col("fp").alias("b")).distinct()


def links(fps: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Links (a, b) that connect all fingerprints (column fp, distinct) with
    DISTANCE or fewer differing bits."""
    def index(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for lo in range(0, len(fp), 4096):
                _, key = segment_keys(fp[lo:lo + 4096])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array(np.tile(fp[lo:lo + 4096], 66).view(np.int64))], names=["key", "fp"])

    keyed = map_arrow(fps.select("fp"), index, "key long, fp long")
    met = store(map_arrow(keyed.repartition("key").sortWithinPartitions("key"),
                          partial(_meet, most=crowd), "a long, b long")
                .distinct(), "simhash-links")
    found = met.filter("b IS NOT NULL")
    members = met.filter("b IS NULL").select("a")
    if members.limit(1).count():
        found = found.unionByName(crowd_links(members))
    return found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id) of every document."""
    signed = store(with_fingerprints(docs, id_col, text_col), "simhash-documents")
    fps = store(signed.groupBy("fp").agg(F.min("id").alias("least")), "simhash-fingerprints")
    labels = components(store(links(fps), "simhash-edges"))
    joined = labels.select(F.col("node").alias("fp"), "label").join(fps, "fp")
    names = joined.groupBy("label").agg(F.min("least").alias("component_id"))
    named = joined.select("fp", "label").join(names, "label").select("fp", "component_id")
    classes = fps.join(named, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    # the rows of a very common fingerprint are one skewed key of this join
    return signed.join(classes, "fp", "left").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
