"""Approximate nearest neighbours by a forest of random-projection trees.

Each tree halves the vectors again and again by a hyperplane across the line
between two random ones (of a few such pairs the one along which they spread
most), until ``LEAF`` are left. A query walks all trees at once: one
priority queue holds the branches not taken in any tree, ordered by the sum
of squared distances to the hyperplanes passed on the wrong side, and leaves
are visited best first until they hold the search budget. The candidates of
the visited leaves are then scored exactly, in double precision, on the
original vectors.

The forest is fitted on a bounded sample (``SAMPLE`` vectors) and broadcast;
every row is indexed. Equal vectors form one class, searched once: a class
keeps its k + 1 smallest ids, which is all that k neighbours can need, and
its results go back to each of its queries. Inner products become distances
by one more coordinate, sqrt(M^2 - |x|^2), 0 for a query. Work is dealt out
by (tree, run of leaves); a group holds about ``GROUP`` vectors.

The budget is ``BUDGET * N ** POWER`` vectors, counted once per tree they are
found in. On vectors without structure a constant share of recall costs
nearly a constant share of the vectors; that is the data, not the index.

Defined results: vectors that are null, zero, or hold null, NaN or infinite
components take no part, nor do those of another length than the most
common one, nor rows with a null id; ties go to the smaller id; rows that
repeat an id with an equal vector count once, with another vector they ask
each for themselves; an empty table gives no rows; other columns are not
read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sinter.llm.common import ship, store

TREES, LEAF = 12, 128
SAMPLE, SAMPLE_BYTES = 20_000, 64 << 20
BUDGET, POWER = 8.0, 0.8
GROUP = 65_536
PAIRS = 8
_NEAR = 1e-9  # scores this close, relatively, are compared exactly


class Forest:
    """Trees as arrays. ``child`` < 0 names leaf ``-child - 1``; leaves are
    numbered from left to right in each tree."""

    def __init__(self, sample: np.ndarray, n: int, trees: int = TREES, leaf: int = LEAF, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.leaves = 0
        # the share of all vectors that a leaf may hold, in sample vectors
        small = max(1, int(leaf * len(sample) / max(1, n)))
        self.trees = [self._grow(sample, small, rng) for _ in range(trees)]

    def _grow(self, x, small, rng):
        normal, cut, child, n_leaves = [], [], [], 0

        def grow(idx):
            nonlocal n_leaves
            if len(idx) > small:
                split = self._split(x, idx, rng)
                if split is not None:
                    w, t, below = split
                    at = len(normal)
                    normal.append(w)
                    cut.append(t)
                    child.append([0, 0])
                    child[at][0] = grow(idx[below])
                    child[at][1] = grow(idx[~below])
                    return at
            n_leaves += 1
            return -n_leaves

        root = grow(np.arange(len(x)))
        dim = x.shape[1]
        self.leaves = max(self.leaves, n_leaves)
        return (np.array(normal, np.float32).reshape(-1, dim), np.array(cut), child, root)

    @staticmethod
    def _split(x, idx, rng):
        best = None
        some = x[idx[rng.integers(0, len(idx), min(len(idx), 500))]]
        for _ in range(PAIRS):
            a, b = rng.integers(0, len(idx), 2)
            w = x[idx[a]] - x[idx[b]]
            size = np.linalg.norm(w)
            if size < 1e-12:
                continue
            w = w / size
            spread = (some @ w).std()
            if best is None or spread > best[0]:
                best = (spread, w)
        if best is None:
            return None
        p = x[idx] @ best[1]
        t = float(np.median(p))
        below = p <= t
        return None if below.all() or not below.any() else (best[1], t, below)

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """Leaf of every vector in every tree, [trees, vectors]."""
        out = np.zeros((len(self.trees), len(x)), np.int32)
        for k, (normal, cut, child, root) in enumerate(self.trees):
            stack = [(root, np.arange(len(x)))]
            while stack:
                at, idx = stack.pop()
                if not len(idx):
                    continue
                if at < 0:
                    out[k, idx] = -at - 1
                    continue
                below = x[idx] @ normal[at] <= cut[at]
                stack += [(child[at][0], idx[below]), (child[at][1], idx[~below])]
        return out

    def visit(self, q: np.ndarray, sizes: list[np.ndarray], budget: float) -> list[list[int]]:
        """Leaves of each tree that hold the budget, best first over all."""
        side = [normal @ q - cut for normal, cut, _, _ in self.trees]
        queue = [(0.0, k, t[3]) for k, t in enumerate(self.trees)]
        out: list[list[int]] = [[] for _ in self.trees]
        found = 0.0
        while queue and found < budget:
            d, k, at = heapq.heappop(queue)
            child, s = self.trees[k][2], side[k]
            while at >= 0:
                m = s[at]
                near, far = child[at] if m <= 0 else child[at][::-1]
                heapq.heappush(queue, (d + m * m, k, far))
                at = near
            out[k].append(-at - 1)
            found += sizes[k][-at - 1]
        return out


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v, norm) of the rows that take part."""
    v = F.transform(vec_col, lambda x: x.cast("double"))
    x = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter(
        F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda c: (
            c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))))
    x = x.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c))).filter("norm > 0")
    return x


def classes_of(x: DataFrame, k: int, every: int) -> DataFrame:
    """One row per distinct vector: its k + 1 smallest ids, whether any of
    its ids asks, and how many rows have it."""
    n = x.count()
    salts = 1 + n // 200_000  # bounds what one task gathers for a very common vector
    key = x.withColumn("key", F.md5(F.array_join(F.transform("v", lambda c: c.cast("string")), ",").cast("binary")))
    part = (key.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)))
            .groupBy("key", "salt").agg(
                F.slice(F.sort_array(F.collect_set("id")), 1, k + 1).alias("ids"),
                F.max(F.col("id") % every == 0).alias("asks"), F.count("*").alias("n"),
                F.first("v").alias("v"), F.first("norm").alias("norm")))
    return part.groupBy("key").agg(
        F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids"),
        F.max("asks").alias("asks"), F.sum("n").alias("n"), F.first("v").alias("v"), F.first("norm").alias("norm"))


def _matrix(col) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in col]) if len(col) else np.zeros((0, 0))


def _with_extra(x: np.ndarray, most: float) -> np.ndarray:
    """Vectors of equal length: one more coordinate."""
    return np.column_stack([x, np.sqrt(np.maximum(most ** 2 - (x * x).sum(1), 0.0))])


def best_of(group_queries: np.ndarray, leaves: list[np.ndarray], cand: np.ndarray, leaf: np.ndarray, k: int):
    """(query, candidate, score) of each query's k best candidates in the
    leaves that it visits, and all that come within rounding of the k-th."""
    order = np.argsort(leaf, kind="stable")
    cand, leaf = cand[order], leaf[order]
    at = np.concatenate(leaves) if leaves else np.zeros(0, np.int64)
    who = np.repeat(np.arange(len(leaves)), [len(v) for v in leaves])
    by = np.argsort(at, kind="stable")
    at, who = at[by], who[by]
    found = []
    for lo, hi in zip(*_runs(at)):
        a, b = np.searchsorted(leaf, at[lo], "left"), np.searchsorted(leaf, at[lo], "right")
        if a == b:
            continue
        s = group_queries[who[lo:hi]] @ cand[a:b].T
        if b - a > k:
            least = np.partition(s, b - a - k, axis=1)[:, b - a - k]
            row, col = np.nonzero(s >= (least - _NEAR * (1 + np.abs(least)))[:, None])
        else:
            row, col = np.indices(s.shape).reshape(2, -1)
        found.append((who[lo:hi][row], a + col, s[row, col]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    q, c, s = (np.concatenate(f) for f in zip(*found))
    o = np.lexsort((-s, q))
    q, c, s = q[o], c[o], s[o]
    lo, hi = _runs(q)
    least = s[np.minimum(lo + k, hi) - 1]
    keep = s >= np.repeat(least - _NEAR * (1 + np.abs(least)), hi - lo)
    q, c = q[keep], c[keep]
    exact = (group_queries[q] * cand[c]).sum(1)  # one order of addition for every pair
    return q, order[c], exact


def _runs(x: np.ndarray):
    lo = np.flatnonzero(np.diff(x, prepend=x[0] - 1)) if len(x) else np.zeros(0, np.int64)
    return lo, np.append(lo[1:], len(x)).astype(np.int64)


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id",
            vec_col: str = "embedding", trees: int = TREES, leaf: int = LEAF,
            budget: float = BUDGET, power: float = POWER) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row
    whose id is divisible by ``every``, by largest inner product."""
    spark = vectors.sparkSession
    ship(spark)
    x = store(usable(vectors, id_col, vec_col), "ann-vectors")
    dims = x.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    dim = dims[0]["d"] if dims else 0
    x = x.filter(F.size("v") == dim)
    cls = store(classes_of(x, k, every).withColumn("cls", F.xxhash64("key")), "ann-classes")
    stats = cls.agg(F.count("*").alias("n"), F.max("norm").alias("most")).collect()[0]
    n, most = stats["n"], stats["most"] or 0.0
    bound = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * max(1, dim))))
    some = cls.orderBy(F.xxhash64("key"), "key").limit(bound).select("v").collect()
    forest = Forest(_with_extra(_matrix([r[0] for r in some]), most) if some else np.zeros((0, 1)), n, trees, leaf)
    bc = spark.sparkContext.broadcast(forest)
    run = max(1, GROUP // leaf)
    n_groups = -(-forest.leaves // run)

    def index(batches):
        f = bc.value
        for b in batches:
            at = f.leaf_of(_with_extra(_matrix(b["v"]), most))
            for t in range(len(f.trees)):
                yield pd.DataFrame({"grp": t * n_groups + at[t] // run, "leaf": at[t], "cls": b["cls"],
                                    "ids": b["ids"], "v": b["v"]})

    indexed = cls.select("cls", "ids", "v").mapInPandas(
        index, "grp int, leaf int, cls long, ids array<long>, v array<double>")
    sizes = [np.zeros(forest.leaves, np.int64) for _ in range(trees)]

    def count(batches):
        f = bc.value
        for b in batches:
            at = f.leaf_of(_with_extra(_matrix(b["v"]), most))
            t = np.repeat(np.arange(len(at)), at.shape[1])
            key, c = np.unique(t * f.leaves + at.ravel(), return_counts=True)
            yield pd.DataFrame({"t": key // f.leaves, "leaf": key % f.leaves, "c": c})

    # one number per leaf; the forest is bounded, so these are
    for r in (cls.select("v").mapInPandas(count, "t int, leaf int, c long")
              .groupBy("t", "leaf").agg(F.sum("c").alias("c")).collect()):
        sizes[r["t"]][r["leaf"]] = r["c"]
    bs = spark.sparkContext.broadcast(sizes)
    want = budget * n ** power

    def walk(batches):
        f, size = bc.value, bs.value
        for b in batches:
            rows = []
            for c, v in zip(b["cls"], b["v"]):
                q = np.append(np.asarray(v, np.float64), 0.0)
                for t, at in enumerate(f.visit(q, size, want)):
                    at = np.sort(np.array(at, np.int64))
                    g = at // run
                    for lo, hi in zip(*_runs(g)):
                        rows.append((t * n_groups + int(g[lo]), c, v, at[lo:hi]))
            yield pd.DataFrame(rows, columns=["grp", "cls", "v", "leaves"])

    asked = cls.filter("asks").select("cls", "v").mapInPandas(
        walk, "grp int, cls long, v array<double>, leaves array<int>")

    def rank(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        q, c, s = best_of(_matrix(right["v"]), [np.asarray(v, np.int64) for v in right["leaves"]],
                          _matrix(left["v"]), left["leaf"].to_numpy(), k + 1)
        return pd.DataFrame({"cls": right["cls"].to_numpy()[q], "score": s, "ids": left["ids"].to_numpy()[c]})

    def rank_or_none(left, right):
        if len(left) and len(right):
            return rank(left, right)
        return pd.DataFrame({"cls": pd.Series([], dtype="int64"), "score": pd.Series([], dtype="float64"),
                             "ids": pd.Series([], dtype="object")})

    partial = indexed.groupBy("grp").cogroup(asked.groupBy("grp")).applyInPandas(
        rank_or_none, "cls long, score double, ids array<long>")
    flat = F.flatten(F.transform("found", lambda f: F.transform(
        f["ids"], lambda i: F.struct((-f["score"]).alias("neg"), i.alias("id")))))
    lists = (partial.groupBy("cls").agg(F.collect_set(F.struct("score", "ids")).alias("found"))
             .select("cls", F.slice(F.sort_array(flat), 1, k + 1).alias("found")))
    # back to every row that asks; the lists of very common vectors are dealt out
    share = 10_000
    salted = (lists.join(cls.select("cls", "key", "n"), "cls")
              .withColumn("salt", F.explode(F.sequence(F.lit(0), (F.col("n") / (share * every)).cast("int")))))
    key = F.md5(F.array_join(F.transform("v", lambda c: c.cast("string")), ",").cast("binary"))
    ask = (x.filter(F.col("id") % every == 0).select("id", key.alias("key")).distinct()
           .join(cls.filter("asks").select("key", F.col("n").alias("m")), "key")
           .withColumn("salt", F.pmod(F.xxhash64("id"), (F.col("m") / (share * every)).cast("int") + 1).cast("int")))
    got = ask.join(salted, ["key", "salt"]).select(
        F.col("id").alias("query_id"),
        F.slice(F.filter("found", lambda f: f["id"] != F.col("id")), 1, k).alias("found"))
    return got.select("query_id", F.posexplode("found").alias("pos", "f")).select(
        "query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("f.id").alias("vec_id"),
        (-F.col("f.neg")).alias("score"))
