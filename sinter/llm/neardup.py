"""Near duplicates by improved consistent weighted sampling.

A text is the multiset of its 5-word shingles, each weighted tf x idf. The
document frequencies are counted over all documents, in 2^18 hash buckets,
and idf = 1 + IDF * ln(1 + N / df) / ln(1 + N), so common passages weigh
less but an edited copy of a very common text still resembles it.

1. Every text gets ``BANDS * ROWS`` consistent weighted samples: sample k of
   a set is the shingle with the smallest ln a = ln c - r (t - beta + 1),
   t = floor(ln w / r + beta), where r and c are Gamma(2, 1) and beta is
   uniform, all drawn from a hash of shingle and k. Two sets agree in a
   sample with probability equal to their weighted Jaccard similarity.
   Exact copies are one node from here on.
2. Samples are banded. In each bucket every node proposes a link to the
   bucket's hub (the member closest to the most common samples) and to its
   nearest other member by agreement of samples, so a bucket of n nodes
   gives fewer than 2 n proposals and no list of pairs. Pairs whose samples
   agree far less than the threshold allows are not proposed. Buckets above
   ``HEAVY`` members (at most a fixed number of buckets can be) are split by
   salt; the hubs of the parts meet in a second round. This only finds most
   links cheaply: step 4 makes up for what the hubs and parts miss.
3. Proposals are verified on the shingles themselves: exact weighted Jaccard
   similarity of at least ``SIMILARITY``. Verified links give components.
4. Buckets that still hold members of several components are read again:
   all pairs of different components whose samples agree enough are verified
   in place, so a pair that shares a band is left out only if it already is
   in one component. A bucket of more than ``PART`` members or
   ``PART_SHINGLES`` shingles is cut into m parts, and every two parts meet
   in a tile of their own: members are copied m times, pairs never are.
5. A class is a component with all exact copies, named by its smallest
   document id.

Defined results: null, empty and blank texts have no shingle and are each
a class of their own, named by the row's own id; a text of fewer than 5
words is one shingle; a null id never names a class that has another id;
repeated rows are exact copies; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sinter.llm.common import byte_slices, map_arrow, store, text_bytes
from sinter.llm.tokens import ragged

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 12, 4
IDF = 0.5
DF_BITS = 18
HEAVY = 4096
LEAST_AGREEMENT = 0.6  # 3.4 standard deviations below SIMILARITY at 48 samples
SLICE_BYTES = 1 << 20
BROADCAST_NODES = 2_000_000
PART, PART_SHINGLES = 1024, 1 << 20

_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_P = np.uint64(0x100000001B3)
_M = np.uint64(0x9E3779B97F4A7C15)
_M2 = np.uint64(0xC2B2AE3D27D4EB4F)
_POWERS = np.cumprod(np.full(64, _P, np.uint64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(29))
    x = x * _M
    return x ^ (x >> np.uint64(32))


def shingles(data: np.ndarray, off: np.ndarray):
    """Sorted distinct shingles of every text: (hash of 32 bits as uint64,
    times, shingles per text)."""
    n = len(off) - 1
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(n, np.int64)
    inside = ~_BLANK[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    first = off[:-1][off[:-1] < len(data)]
    begin[first] = inside[first]
    starts = np.flatnonzero(begin)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(n, np.int64)
    letters = data[inside].astype(np.uint64)
    at = np.flatnonzero(begin[inside])  # word begins among the letters
    size = np.diff(at, append=len(letters))
    with np.errstate(over="ignore"):
        pos = np.arange(len(letters)) - np.repeat(at, size)
        # bytes beyond the 64th reuse powers, shifted by how often
        word = np.add.reduceat((letters + np.uint64(1)) * _POWERS[pos & 63]
                               + (pos >> 6).astype(np.uint64) * _M2 * letters, at)
        word = _mix(word + size.astype(np.uint64))
        w_at = np.searchsorted(starts, off)
        n_words = np.diff(w_at)
        k = np.where(n_words >= SHINGLE, n_words - SHINGLE + 1, np.minimum(n_words, 1))
        owner = np.repeat(np.arange(n), k)
        s = ragged(w_at[:-1], k)
        left = n_words[owner] - (s - w_at[owner])
        h = np.zeros(len(s), np.uint64)
        padded = np.append(word, np.zeros(SHINGLE, np.uint64))
        for j in range(SHINGLE):
            part = padded[s + j]
            if j:
                part = np.where(left > j, part, np.uint64(0))
            h = h * _M2 + part
        h = _mix(h) >> np.uint64(32)
    # one sort by (text, hash); texts are numbered within blocks of 2^16
    out_h, out_c = [], []
    for a in range(0, n, 1 << 16):
        lo, hi = np.searchsorted(owner, [a, a + (1 << 16)])
        key = np.sort(((owner[lo:hi] - a).astype(np.uint64) << np.uint64(32)) | h[lo:hi])
        new = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        out_c.append(np.diff(new, append=len(key)))
        out_h.append(key[new])
    key = np.concatenate(out_h)
    per = np.zeros(n, np.int64)
    for i, a in enumerate(range(0, n, 1 << 16)):
        own = (out_h[i] >> np.uint64(32)).astype(np.int64)
        got = np.bincount(own, minlength=1) if len(own) else np.zeros(1, np.int64)
        per[a:a + len(got)] = got[:n - a]
    return key & np.uint64(0xFFFFFFFF), np.concatenate(out_c), per


def bucket_of(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((h.astype(np.uint64) * _M) >> np.uint64(64 - DF_BITS)).astype(np.int64)


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """(documents per shingle bucket, documents), over all rows."""
    def count(batches):
        total, docs = np.zeros(1 << DF_BITS, np.int64), 0
        for batch in batches:
            data, off = text_bytes(batch.column(0))
            for a, b in byte_slices(off, SLICE_BYTES):
                h, _, per = shingles(data[off[a]:off[b]], off[a:b + 1] - off[a])
                total += np.bincount(bucket_of(h), minlength=len(total))
                docs += int((per > 0).sum())
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], docs))],
                                         names=["bucket", "n"])

    df, n = np.zeros(1 << DF_BITS, np.int64), 0
    rows = map_arrow(texts, count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    got = rows.toPandas()  # at most 2^18 + 1 rows
    for b, c in ((got["bucket"].to_numpy(), got["n"].to_numpy()),):
        df[b[b >= 0]] = c[b >= 0]
        n = int(c[b < 0].sum())
    return df, n


def log_idf(df: np.ndarray, n: int) -> np.ndarray:
    idf = 1.0 + IDF * np.log1p(max(n, 1) / np.maximum(df, 1)) / np.log1p(max(n, 1))
    return np.log(idf).astype(np.float32)


def _tables():
    """Draws by hash bits: r and 1 / r, ln c, beta."""
    rng = np.random.default_rng(20)
    r = rng.gamma(2.0, 1.0, 1 << 14).astype(np.float32)
    c = np.log(rng.gamma(2.0, 1.0, 1 << 18)).astype(np.float32)
    beta = rng.random(1 << 14).astype(np.float32)
    odd = rng.integers(0, 1 << 62, (BANDS * ROWS, 2), dtype=np.uint64) | np.uint64(1)
    return r, np.float32(1) / r, c, beta, odd


_DRAWS: list = []


def samples(h: np.ndarray, log_w: np.ndarray, per: np.ndarray) -> np.ndarray:
    """Consistent weighted samples [texts with shingles, BANDS * ROWS]."""
    if not _DRAWS:
        _DRAWS.append(_tables())
    r_of, inv_of, c_of, b_of, odd = _DRAWS[0]
    per = per[per > 0]
    at = np.cumsum(per) - per
    out = np.empty((len(per), len(odd)), np.uint64)
    with np.errstate(over="ignore"):
        for k, (m, add) in enumerate(odd):
            z = h * m + add
            z ^= z >> np.uint64(31)
            z *= _M
            i = (z >> np.uint64(50)).astype(np.int64)
            r = r_of[i]
            b = b_of[(z >> np.uint64(36)).astype(np.int64) & 0x3FFF]
            t = log_w * inv_of[i]
            t += b
            np.floor(t, out=t)
            a = c_of[(z >> np.uint64(18)).astype(np.int64) & 0x3FFFF]
            a -= r * (t - b + np.float32(1))
            least = np.minimum.reduceat(a, at)
            hit = np.flatnonzero(a == np.repeat(least, per))
            # shingles are sorted, so the first of equals is the same in every text
            first = hit[np.searchsorted(hit, at)]
            out[:, k] = _mix(h[first] * _M2 + t[first].astype(np.int64).astype(np.uint64) + np.uint64(k))
    return out


def signatures(docs: DataFrame, log_w: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """One row per distinct text with shingles: node, its smallest id, its
    number of rows, band keys, one byte of every sample, and how many
    shingles it has."""
    bc = docs.sparkSession.sparkContext.broadcast(log_w)

    def sign(batches):
        idf = bc.value
        for batch in batches:
            node = batch.column(0).to_numpy(zero_copy_only=False)
            # equal texts of a batch are signed once
            uniq, first = np.unique(node, return_index=True)
            texts = batch.column(2).take(pa.array(first))
            data, off = text_bytes(texts)
            bands, sig, ok, size = [], [], [], []
            for a, b in byte_slices(off, SLICE_BYTES):
                h, times, per = shingles(data[off[a]:off[b]], off[a:b + 1] - off[a])
                has = np.flatnonzero(per)
                if not len(has):
                    continue
                s = samples(h, idf[bucket_of(h)] + np.log(times).astype(np.float32), per)
                with np.errstate(over="ignore"):
                    key = np.zeros((len(s), BANDS), np.uint64)
                    for j in range(ROWS):
                        key = _mix(key * _M2 + s[:, j::ROWS] + np.arange(BANDS, dtype=np.uint64))
                bands.append(key.astype(np.int64))
                sig.append((s & np.uint64(0xFF)).astype(np.uint8))
                ok.append(a + has)
                size.append(per[has])
            if not ok:
                continue
            ok = np.concatenate(ok)
            bands, sig = np.concatenate(bands), np.concatenate(sig)
            # smallest id and rows of each node in the batch
            none = np.iinfo(np.int64).max
            ids = batch.column(1).fill_null(none).to_numpy(zero_copy_only=False)
            order = np.argsort(node, kind="stable")
            first = np.searchsorted(node[order], uniq)
            least = np.minimum.reduceat(ids[order], first)[ok]
            n = np.diff(first, append=len(node))
            least = pa.array(least, mask=least == none)
            yield pa.RecordBatch.from_arrays(
                [pa.array(uniq[ok]), least, pa.array(n[ok]),
                 pa.ListArray.from_arrays(pa.array(np.arange(len(ok) + 1) * BANDS, pa.int32()), pa.array(bands.ravel())),
                 pa.array([x.tobytes() for x in sig], pa.binary()), pa.array(np.concatenate(size))],
                names=["node", "id", "n", "bands", "sig", "size"])

    rows = docs.filter(F.col(text_col).isNotNull()).select(
        F.xxhash64(text_col).alias("node"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    signed = map_arrow(rows, sign, "node long, id long, n long, bands array<long>, sig binary, size long")
    return signed.groupBy("node").agg(F.min("id").alias("id"), F.sum("n").alias("n"),
                                      F.first("bands").alias("bands"), F.first("sig").alias("sig"), F.first("size").alias("size"))


def propose(node: np.ndarray, sig: np.ndarray):
    """Links of one bucket: every member to the hub and to its nearest other
    member. Returns (a, b) row pairs and the hub's row."""
    n = len(node)
    if n < 2:
        return np.zeros((0, 2), np.int64), 0
    # most common byte of every sample, and the member closest to it
    mode = np.array([np.bincount(c, minlength=256).argmax() for c in sig.T], np.uint8)
    near = (sig == mode).sum(1)
    hub = int(np.lexsort((node, -near))[0])
    agree = (sig == sig[hub]).mean(1)
    star = np.flatnonzero((agree >= LEAST_AGREEMENT) & (np.arange(n) != hub))
    pairs = [np.column_stack([star, np.full(len(star), hub)])]
    step = max(1, (1 << 24) // (n * sig.shape[1]))
    for a in range(0, n, step):
        same = (sig[a:a + step, None, :] == sig[None, :, :]).mean(2)
        rows = np.arange(len(same))
        same[rows, a + rows] = -1.0
        best = same.argmax(1)
        ok = same[rows, best] >= LEAST_AGREEMENT
        pairs.append(np.column_stack([a + rows[ok], best[ok]]))
    return np.concatenate(pairs), hub


class _Bucket:
    """The members of the bucket that is being read, in parts of ``HEAVY``;
    later parts hold the hub of the first one too."""

    def __init__(self):
        self.key, self.split, self.hub = None, False, None
        self.node, self.sig = [], []

    def link(self, links):
        if not self.node:
            return
        node, sig = np.concatenate(self.node), np.concatenate(self.sig)
        self.node, self.sig = [], []
        if self.hub is not None:
            node, sig = np.append(self.hub[0], node), np.concatenate([self.hub[1][None], sig])
        pairs, hub = propose(node, sig)
        x, y = node[pairs[:, 0]], node[pairs[:, 1]]
        links.append((np.minimum(x, y)[x != y], np.maximum(x, y)[x != y]))
        if self.hub is None:
            self.hub = node[hub], sig[hub]

    def end(self, links, hubs):
        self.link(links)
        if self.split and self.hub is not None:
            hubs.append((self.key, *self.hub))
        self.hub = None


def _bucket_links(batches):
    """Rows (bucket, node, sig, is it a part of a split bucket), sorted by
    bucket -> proposed links (a, b), and the hubs of split buckets as
    (node, bucket, sig)."""
    held = _Bucket()

    def batch_of(links, hubs):
        a = np.concatenate([x for x, _ in links] + [np.array([h[1] for h in hubs], np.int64)])
        b = np.concatenate([y for _, y in links] + [np.array([h[0] for h in hubs], np.int64)])
        sig = [None] * (len(a) - len(hubs)) + [h[2].tobytes() for h in hubs]
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(sig, pa.binary())],
                                          names=["a", "b", "hub_sig"])

    links: list = []
    hubs: list = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key, node = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        sig = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(len(node), -1)
        split = batch.column(3).to_numpy(zero_copy_only=False)
        cut = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        for lo, hi in zip(cut[:-1], cut[1:]):
            if held.key != key[lo]:
                held.end(links, hubs)
                held.key, held.split = key[lo], bool(split[lo])
            for x in range(lo, hi, HEAVY):
                held.node.append(node[x:min(hi, x + HEAVY)])
                held.sig.append(sig[x:min(hi, x + HEAVY)])
                if sum(map(len, held.node)) >= HEAVY:
                    held.link(links)
        if links or hubs:
            yield batch_of(links, hubs)
            links, hubs = [], []
    held.end(links, hubs)
    if links or hubs:
        yield batch_of(links, hubs)


def proposals(nodes: DataFrame) -> DataFrame:
    """Distinct links (a < b) that the bands propose."""
    members = nodes.select(F.explode("bands").alias("key"), "node")
    shared = store(members.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "neardup-buckets")
    # no more than total / limit buckets can be larger than the limit
    limit = max(HEAVY, nodes.count() * BANDS // 100_000)
    parts = F.floor(F.col("n") / limit).cast("int")
    heavy = shared.filter(F.col("n") > limit).select("key", (parts + 1).alias("m"))
    inside = (members.join(shared.select("key"), "key", "left_semi").join(nodes.select("node", "sig"), "node")
              .join(F.broadcast(heavy), "key", "left")
              .withColumn("salt", F.when(F.col("m").isNull(), F.lit(0)).otherwise(
                  F.pmod(F.xxhash64("node"), F.col("m"))).cast("int"))
              .select(F.xxhash64("key", "salt").alias("part"), "node", "sig", F.col("m").isNotNull().alias("split")))
    first = store(map_arrow(inside.repartition("part").sortWithinPartitions("part", "node"),
                            _bucket_links, "a long, b long, hub_sig binary"), "neardup-links")
    # the hubs of the parts of a split bucket meet
    part_of = heavy.select("key", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("salt")).select(
        "key", F.xxhash64("key", "salt").alias("part"))
    hubs = (first.filter("hub_sig IS NOT NULL")
            .select(F.col("b").alias("part"), F.col("a").alias("node"), F.col("hub_sig").alias("sig"))
            .join(part_of, "part").select("key", "node", "sig", F.lit(False).alias("split")))
    second = map_arrow(hubs.repartition("key").sortWithinPartitions("key", "node"),
                       _bucket_links, "a long, b long, hub_sig binary")
    return (first.filter("hub_sig IS NULL").unionByName(second)
            .select("a", "b").distinct())


def features(docs: DataFrame, wanted: DataFrame, text_col: str) -> DataFrame:
    """(node, shingles, times) of the wanted nodes, once each."""
    n = wanted.count()
    rows = docs.filter(F.col(text_col).isNotNull()).select(F.xxhash64(text_col).alias("node"), F.col(text_col).alias("t"))
    # few enough to send to every task, else by exchange
    rows = rows.join(F.broadcast(wanted) if n <= BROADCAST_NODES else wanted, "node", "left_semi")

    def take(batches):
        for batch in batches:
            node = batch.column(0).to_numpy(zero_copy_only=False)
            uniq, first = np.unique(node, return_index=True)
            data, off = text_bytes(batch.column(1).take(pa.array(first)))
            for a, b in byte_slices(off, SLICE_BYTES):
                h, times, per = shingles(data[off[a]:off[b]], off[a:b + 1] - off[a])
                end = np.concatenate([[0], np.cumsum(per)])
                h, times = h.astype("<u4"), np.minimum(times, 0xFFFF).astype("<u2")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(uniq[a:b]), pa.array([h[x:y].tobytes() + times[x:y].tobytes()
                                                    for x, y in zip(end[:-1], end[1:])], pa.binary())],
                    names=["node", "f"])

    return map_arrow(rows, take, "node long, f binary").groupBy("node").agg(F.first("f").alias("f"))


def similarity(fa: bytes, fb: bytes, idf: np.ndarray) -> float:
    """Exact weighted Jaccard similarity of two feature strings."""
    (hx, tx), (hy, ty) = ((np.frombuffer(f, "<u4", len(f) // 6), np.frombuffer(f, "<u2", -1, len(f) // 6 * 4))
                          for f in (fa, fb))
    wx, wy = idf[bucket_of(hx)] * tx, idf[bucket_of(hy)] * ty
    at = np.minimum(np.searchsorted(hy, hx), len(hy) - 1)
    both = hy[at] == hx
    low = np.minimum(wx[both], wy[at[both]]).sum()
    high = wx.sum() + wy.sum() - low
    return float(low / high) if high else 0.0


def verify(links: DataFrame, feats: DataFrame, log_w: np.ndarray, threshold: float = SIMILARITY) -> DataFrame:
    """The links whose texts are at least ``threshold`` alike."""
    bc = links.sparkSession.sparkContext.broadcast(np.exp(log_w.astype(np.float64)))

    def check(batches):
        idf = bc.value
        for batch in batches:
            fa, fb = batch.column(2), batch.column(3)
            sim = np.array([similarity(x.as_py(), y.as_py(), idf) for x, y in zip(fa, fb)])
            keep = pa.array(np.flatnonzero(sim >= threshold))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(keep), batch.column(1).take(keep), pa.array(sim[keep.to_numpy()])],
                names=["a", "b", "similarity"])

    both = (links.join(feats.select(F.col("node").alias("b"), F.col("f").alias("fb")), "b")
            .join(feats.select(F.col("node").alias("a"), F.col("f").alias("fa")), "a").select("a", "b", "fa", "fb"))
    return map_arrow(both, check, "a long, b long, similarity double")


def tiles(nodes: DataFrame) -> DataFrame:
    """Members (node, label, size, bands, sig) of the buckets that hold
    several labels, once for each tile of the bucket: (tile, apart, part,
    band, node, label, sig, bands). A tile with ``apart`` pairs the members
    of its two parts, another one all its members."""
    members = nodes.select(F.posexplode("bands").alias("band", "key"), "node", "label", "size")
    mixed = store(members.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"),
                                             F.count("*").alias("n"), F.sum("size").alias("size"))
                  .filter("low < high")
                  .select("key", F.greatest(F.ceil(F.col("n") / PART), F.ceil(F.col("size") / PART_SHINGLES))
                          .cast("int").alias("m")), "neardup-mixed")
    part = F.pmod(F.xxhash64("node", F.lit(1)), F.col("m")).cast("int")
    inside = (members.drop("label", "size").join(mixed, "key").withColumn("part", part)
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1))))
    return inside.select(
        F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other")).alias("tile"),
        (F.col("part") != F.col("other")).alias("apart"), "part", "band", "node").join(
        nodes.select("node", "label", "sig", "bands"), "node").select(
        "tile", "apart", "part", "band", "node", "label", "sig", "bands")


def _runs(batches):
    """Rows sorted by their first column -> one table for each value of it."""
    held, key = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(0).to_numpy(zero_copy_only=False)
        cut = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
        for lo, hi in zip(cut[:-1], cut[1:]):
            if held and key != k[lo]:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            key = k[lo]
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def tile_pairs(tile: pa.Table):
    """Pairs of rows i < j of a tile with different labels whose samples
    agree enough, in blocks (i, j) sorted by i. A pair that an earlier band
    brings together as well is left to that band's bucket."""
    n = tile.num_rows
    label, part = (tile[c].to_numpy() for c in ("label", "part"))
    apart, band = tile["apart"][0].as_py(), tile["band"][0].as_py()
    sig = np.frombuffer(b"".join(tile["sig"].to_pylist()), np.uint8).reshape(n, -1)
    bands = np.array(tile["bands"].combine_chunks().flatten()).reshape(n, -1)[:, :band]
    least = int(np.ceil(LEAST_AGREEMENT * sig.shape[1] - 1e-9))
    step = max(1, (1 << 24) // (n * sig.shape[1]))
    for a in range(0, n, step):
        ok = label[a:a + step, None] != label[None, a:]
        if apart:
            ok &= part[a:a + step, None] != part[None, a:]
        ok &= np.arange(len(ok))[:, None] < np.arange(n - a)[None, :]
        if not ok.any():
            continue
        ok &= np.count_nonzero(sig[a:a + step, None, :] == sig[None, a:, :], axis=2) >= least
        i, j = np.nonzero(ok)
        for x in range(0, len(i), 1 << 20):
            ii, jj = a + i[x:x + (1 << 20)], a + j[x:x + (1 << 20)]
            new = ~(bands[ii] == bands[jj]).any(1)
            yield ii[new], jj[new]


def _open_members(batches):
    """Rows of tiles -> those members of a tile that have a pair to verify."""
    for tile in _runs(batches):
        hit = np.zeros(tile.num_rows, bool)
        for i, j in tile_pairs(tile):
            hit[i] = hit[j] = True
        if hit.any():
            yield pa.RecordBatch.from_arrays(
                [tile[c].combine_chunks().filter(pa.array(hit)) for c in ("tile", "apart", "part", "band", "node")],
                names=["tile", "apart", "part", "band", "node"])


def tile_links(tile: pa.Table, idf: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Links (label, label) of verified pairs of a tile (with column ``f``)
    that join labels not yet joined by the links before them."""
    raw = [f.as_py() for f in tile["f"]]
    k = np.array([len(f) // 6 for f in raw])
    off = np.cumsum(k) - k
    h = np.concatenate([np.frombuffer(f, "<u4", len(f) // 6) for f in raw])
    t = np.concatenate([np.frombuffer(f, "<u2", -1, len(f) // 6 * 4) for f in raw])
    w = idf[bucket_of(h)] * t
    total = np.add.reduceat(w, off)
    vocab, at = np.unique(h, return_inverse=True)
    label, group = np.unique(tile["label"].to_numpy(), return_inverse=True)
    dense, links = np.zeros(len(vocab)), []
    for ii, jj in tile_pairs(tile):
        # the lighter text holds all that two can share
        low, high = np.minimum(total[ii], total[jj]), np.maximum(total[ii], total[jj])
        keep = low >= (threshold - 1e-9) * high
        ii, jj = ii[keep], jj[keep]
        cut = [0, *(np.flatnonzero(ii[1:] != ii[:-1]) + 1).tolist(), len(ii)] if len(ii) else [0]
        for lo, hi in zip(cut[:-1], cut[1:]):
            i = ii[lo]
            j = jj[lo:hi][group[jj[lo:hi]] != group[i]]
            own = slice(off[i], off[i] + k[i])
            dense[at[own]] = w[own]
            # a run of partners at a time, one at least
            while len(j):
                many = max(1, int(np.searchsorted(np.cumsum(k[j]), 1 << 20)))
                x = j[:many]
                rows = ragged(off[x], k[x])
                both = np.add.reduceat(np.minimum(dense[at[rows]], w[rows]), np.cumsum(k[x]) - k[x])
                for y in x[both / (total[i] + total[x] - both) >= threshold]:
                    if group[y] != group[i]:
                        links.append((int(tile["label"][int(i)].as_py()), int(tile["label"][int(y)].as_py())))
                        group[group == group[y]] = group[i]
                j = j[many:]
                j = j[group[j] != group[i]]
            dense[at[own]] = 0.0
    return links


def join_labels(docs: DataFrame, nodes: DataFrame, feats: DataFrame, log_w: np.ndarray, text_col: str,
                threshold: float = SIMILARITY) -> DataFrame | None:
    """Links (a, b) between labels of ``nodes`` that share a bucket, by pairs
    of members that are at least ``threshold`` alike; None if there are none
    to verify."""
    rows = tiles(nodes)
    still = store(map_arrow(rows.repartition("tile").sortWithinPartitions("tile"), _open_members,
                            "tile long, apart boolean, part int, band int, node long"), "neardup-open")
    wanted = still.select("node").distinct()
    if not wanted.limit(1).count():
        return None
    missing = store(wanted.join(feats, "node", "left_anti"), "neardup-missing")
    more = store(features(docs, missing, text_col), "neardup-features")
    bc = docs.sparkSession.sparkContext.broadcast(np.exp(log_w.astype(np.float64)))

    def check(batches):
        for tile in _runs(batches):
            links = tile_links(tile, bc.value, threshold)
            if links:
                a, b = np.array(links, np.int64).T
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))],
                                                 names=["a", "b"])

    full = (still.join(nodes.select("node", "label", "sig", "bands"), "node")
            .join(feats.unionByName(more), "node")
            .select("tile", "apart", "part", "band", "node", "label", "sig", "bands", "f"))
    return store(map_arrow(full.repartition("tile").sortWithinPartitions("tile"), check, "a long, b long")
                 .distinct(), "neardup-joined")


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each connected component. Every
    round takes the least label of all neighbours, hands it to the old label
    and shortens paths, so rounds grow with the logarithm of the longest one."""
    edges = store(links.select("a", "b").union(links.select("b", "a")).toDF("u", "v"), "neardup-edges")
    labels = store(edges.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("u")).alias("label"))
                   .select("node", "label"), "neardup-labels")
    while True:
        heard = edges.join(labels.select(F.col("node").alias("v"), F.col("label").alias("l")), "v").select(F.col("u").alias("node"), "l")
        told = (labels.withColumnRenamed("label", "l0").join(heard.groupBy("node").agg(F.min("l").alias("l")), "node")
                .select("node", F.col("l0"), F.least("l0", "l").alias("l")))
        # the old label hears of the new one
        hook = told.select(F.col("l0").alias("node"), "l")
        new = told.select("node", "l").union(hook).groupBy("node").agg(F.min("l").alias("label"))
        jump = new.join(new.select(F.col("node").alias("label"), F.col("label").alias("up")), "label", "left").select(
            "node", F.least("label", F.coalesce("up", "label")).alias("label"))
        new = store(jump, "neardup-labels")
        changed = new.join(labels.withColumnRenamed("label", "was"), "node").filter("label <> was").limit(1).count()
        labels = new
        if not changed:
            return labels


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            threshold: float = SIMILARITY) -> DataFrame:
    """(node, id, n, label, class_id) of every distinct text with shingles:
    its smallest document id and rows, its component, and the smallest
    document id of the component (null if it has none)."""
    df, n = document_frequencies(docs.select(text_col))
    log_w = log_idf(df, n)
    nodes = store(signatures(docs.select(id_col, text_col), log_w, id_col, text_col), "neardup-nodes")
    links = store(proposals(nodes), "neardup-proposals")
    wanted = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    feats = store(features(docs.select(text_col), wanted, text_col), "neardup-features")
    verified = store(verify(links, feats, log_w, threshold), "neardup-verified")
    labelled = store(nodes.join(components(verified), "node", "left").withColumn(
        "label", F.coalesce("label", "node")), "neardup-labelled")
    joined = join_labels(docs.select(text_col), labelled, feats, log_w, text_col, threshold)
    labelled = labelled.select("node", "id", "n", "label")
    if joined is not None:
        up = components(joined).toDF("label", "__up")
        labelled = labelled.join(up, "label", "left").select(
            "node", "id", "n", F.coalesce("__up", "label").alias("label"))
    names = labelled.groupBy("label").agg(
        F.min("id").alias("class_id"), F.sum("n").alias("class_size"),
        F.min(F.struct(F.col("id").isNull().alias("none"), "id", "node"))["node"].alias("first_node"))
    return store(labelled.join(names, "label"), "neardup-classes")


def with_classes(docs: DataFrame, cls: DataFrame, text_col: str = "text", part: int = 50_000) -> DataFrame:
    """(row, __node, and class columns) of every row of ``docs``, the class
    by its text; rows of very common texts are dealt out by salt. Texts
    without shingles get nulls."""
    salts = F.floor(F.col("n") / part).cast("int")
    right = cls.withColumn("__salt", F.explode(F.sequence(F.lit(0), salts))).select(
        F.col("node").alias("__node"), "__salt", "class_id", "class_size", "first_node", F.col("id").alias("least"))
    # at most rows / part texts can be that common
    big = F.broadcast(cls.filter(F.col("n") >= part).select(F.col("node").alias("__big"), (salts + 1).alias("__m")))
    left = (docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"),
                        F.xxhash64(docs[f"`{text_col}`"]).alias("__node"))
            .join(big, F.col("__node") == F.col("__big"), "left")
            .withColumn("__salt", F.coalesce(F.pmod(F.monotonically_increasing_id(), F.col("__m")).cast("int"), F.lit(0))))
    return left.join(right, ["__node", "__salt"], "left").drop("__big", "__m", "__salt")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    threshold: float = SIMILARITY) -> DataFrame:
    """(id, class_id, class_size) of every document."""
    rows = with_classes(docs.select(id_col, text_col), classes(docs, id_col, text_col, threshold), text_col)
    own = F.col(f"row.`{id_col}`")
    return rows.select(own.alias(id_col), F.when(F.col("first_node").isNull(), own).otherwise(
        F.col("class_id")).alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               threshold: float = SIMILARITY) -> DataFrame:
    """``docs`` without all but one document of each class: the one with the
    smallest id. Texts without shingles all stay."""
    x = with_classes(docs, classes(docs, id_col, text_col, threshold), text_col)
    # rows of the leading text with the leading id; equal rows are told apart below
    lead = (F.col("__node") == F.col("first_node")) & F.col(f"row.`{id_col}`").cast("long").eqNullSafe(F.col("least"))
    free = x.filter(F.col("first_node").isNull()).select("row.*")
    one = x.filter(F.col("first_node").isNotNull() & lead).dropDuplicates(["__node"]).select("row.*")
    return free.unionByName(one)
