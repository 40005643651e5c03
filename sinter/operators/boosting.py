"""Gradient boosting on per-bin histograms (M7).

Spark's own boosted trees draw columns at every node; here, as the
reference's booster means its settings, a tree draws its columns once and a
round its rows once, leaves are shrunk by ``regLambda``, and a missing value
goes to the side with the larger gain.

Training keeps one stored table of blocks (a row holds the bins, labels, row
keys and margins of one Arrow batch), so a pass hands few large cells to
numpy. Every level of a tree is one pass: tasks add up gradient and row
count per (node, column, bin), one aggregate merges them, and the driver
gets at most ``2^(maxDepth - 1) * columns * (maxBins + 1)`` sums, whatever
the number of rows. Each tree's margins are a cached projection of the blocks
before; every ``REFRESH`` trees the blocks are written, so a lost executor
costs at most that many projections of its own blocks.

Rows with the same bins have the same margin and go to the same nodes. Where
there are at most ``MAX_CELLS`` different rows of bins (measures on a short
scale, or few bins), a block holds the number of that cell instead, a tree
takes one pass (gradient and row count per cell) and its levels are cut on
the driver from those sums; the trees are the same.

Gradients are rounded to a fixed step and summed as 64-bit integers, so sums
don't depend on the order or the cutting of partitions: with ``idCol`` set,
reruns, lost executors and other partitionings give the same trees (the
default column edges come from a quantile sketch and may move with the
partitioning; pass ``edges`` to fix them). Without ``idCol`` row keys are
numbers given when the blocks are written.

Rows whose label is null or not finite take no part, or are refused
(``strict``). A table without rows
gives a model that predicts 0.
"""

from __future__ import annotations

import functools
import json
import math
import sys

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol
from pyspark.ml.regression import RandomForestRegressor
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, functions as F

from sinter.session import scratch_path

# functions that run in tasks travel with them: workers need no copy of the library
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MISSING = 255             # bin of a missing value
MAX_EDGES = 254
REFRESH = 25              # trees between two stored copies of the blocks
PART_ROWS = 2 ** 17       # a table is cut into no more parts than one for so many rows
ROW_BITS = 38             # a rounded gradient; 2^14 of them add up exactly as doubles
SUM_BITS = 62
BLOCKS = "n int, bins binary, label binary, key binary, margin binary"
SUMS = "slot int, g long, h long"
MAX_CELLS = 1 << 17       # different rows of bins that are summed as they are
DRIVER_SUMS = 1 << 21     # sums that tasks may send to the driver unmerged
CELL_BLOCKS = "n int, cell binary, label binary, key binary"
CELL_SUMS = "tree int, g binary, h binary"


def mix32(x):
    """A 32-bit mixer (multiply and xor-shift) of integers below 2^32."""
    x = np.asarray(x, np.uint64)
    for shift, factor in ((16, 0x7FEB352D), (15, 0x846CA68B)):
        x = ((x ^ (x >> np.uint64(shift))) * np.uint64(factor)) & np.uint64(0xFFFFFFFF)
    return x ^ (x >> np.uint64(16))


def drawn_rows(key, seed: int, tree: int, rate: float):
    """Whether each row key is in the tree's sample."""
    if rate >= 1.0:
        return np.ones(len(key), bool)
    salt = mix32((seed * 1_000_003 + tree) & 0xFFFFFFFF)
    return mix32(key.astype(np.uint64) ^ salt) < np.uint64(round(rate * 2 ** 32))


def drawn_columns(n: int, seed: int, tree: int, rate: float) -> list[int]:
    """The tree's columns: ``rate`` of them, one at least."""
    take = max(1, round(rate * n))
    return sorted(np.random.default_rng([seed, tree]).permutation(n)[:take].tolist())


class Tree:
    """A tree as arrays; node i has the children 2i + 1 and 2i + 2."""

    def __init__(self, depth: int):
        n = 2 ** (depth + 1) - 1
        self.depth = depth
        self.column = np.full(n, -1, np.int64)      # -1: no split
        self.cut = np.zeros(n, np.int64)            # bins up to here go left
        self.missing_left = np.zeros(n, bool)
        self.value = np.zeros(n)
        self.gain = np.zeros(n)
        self.g = np.zeros(n)
        self.h = np.zeros(n, np.int64)

    def nodes(self, bins):
        """The last node of each row; ``bins`` has a row for each column."""
        n = bins.shape[1]
        at, rows, flat = np.zeros(n, np.int64), np.arange(n), bins.ravel()
        # side[node, bin]: what is added to 2 * node
        side = np.where(np.arange(256) <= self.cut[:, None], 1, 2)
        side[:, MISSING] = np.where(self.missing_left, 1, 2)
        start = np.maximum(self.column, 0) * n
        stay = self.column < 0
        for _ in range(self.depth):
            if stay[at].all():
                break
            b = flat[start[at] + rows]
            at = np.where(stay[at], at, 2 * at + side.ravel()[at * 256 + b])
        return at

    def scores(self, bins):
        return self.value[self.nodes(bins)]

    def to_list(self):
        used = [i for i in range(len(self.column)) if i == 0 or self.column[(i - 1) // 2] >= 0]
        return [[i, int(self.column[i]), int(self.cut[i]), bool(self.missing_left[i]), float(self.value[i])]
                for i in used]

    @classmethod
    def of_list(cls, depth, nodes):
        t = cls(depth)
        for i, c, cut, left, value in nodes:
            t.column[i], t.cut[i], t.missing_left[i], t.value[i] = c, cut, left, value
        return t


def to_bins(x, edges):
    """Bin numbers, one row for each column of the matrix: the number of edges
    at or below the value."""
    out = np.empty(x.shape[::-1], np.uint8)
    for j, e in enumerate(edges):
        out[j] = np.where(np.isnan(x[:, j]), MISSING, np.searchsorted(e, x[:, j], side="right"))
    return out


def _matrix(column, width: int):
    """A list column as a matrix; a null list or entry is NaN."""
    out = np.full((len(column), width), np.nan)
    for i, row in enumerate(column.to_pylist()):
        if row is not None:
            out[i] = [np.nan if v is None else v for v in row]
    return out


def _dense(column, width: int):
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if flat.null_count or flat.flatten().null_count or len(flat.flatten()) != len(flat) * width:
        return _matrix(flat, width)
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), width)


def _block(row, width: int):
    n = row["n"]
    return (np.frombuffer(row["bins"], np.uint8).reshape(width, n), np.frombuffer(row["label"]),
            np.frombuffer(row["key"], np.uint32), np.frombuffer(row["margin"]))


def _to_blocks(edges, base: float):
    def run(batches):
        for b in batches:
            if b.num_rows == 0:
                continue
            x = _dense(b.column(0), len(edges))
            label = b.column(1).to_numpy(zero_copy_only=False).astype(np.float64)
            key = b.column(2).to_numpy(zero_copy_only=False).astype(np.uint32)
            yield pa.RecordBatch.from_pydict({
                "n": pa.array([len(label)], pa.int32()), "bins": [to_bins(x, edges).tobytes()],
                "label": [label.tobytes()], "key": [key.tobytes()],
                "margin": [np.full(len(label), base).tobytes()]})
    return run


def _renew(tree, width: int):
    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                bins, _, _, margin = _block(row, width)
                row["margin"] = (margin + tree.scores(bins)).tobytes()
                yield pa.RecordBatch.from_pydict({
                    k: pa.array([v], pa.int32() if k == "n" else pa.binary()) for k, v in row.items()})
    return run


def _tally(tree, level, columns, width, cells, step, seed, number, rate):
    """Sums per slot ((node * columns + column) * cells + bin) of one level."""
    first, nodes = 2 ** level - 1, 2 ** level
    last = np.where(np.arange(256) == MISSING, cells - 1, np.arange(256))

    def run(batches):
        g_sum = np.zeros((nodes, len(columns), cells), np.int64)
        h_sum = np.zeros_like(g_sum)
        for b in batches:
            for row in b.to_pylist():
                bins, label, key, margin = _block(row, width)
                at = tree.nodes(bins)
                here = np.flatnonzero(drawn_rows(key, seed, number, rate) & (at >= first))
                at = (at[here] - first) * cells
                g = np.rint((margin[here] - label[here]) * step)
                for j, c in enumerate(columns):
                    slot = at + last[bins[c][here]]
                    g_sum[:, j] += np.bincount(slot, g, nodes * cells).astype(np.int64).reshape(nodes, cells)
                    h_sum[:, j] += np.bincount(slot, minlength=nodes * cells).reshape(nodes, cells)
        used = np.flatnonzero(h_sum)
        yield pa.RecordBatch.from_pydict({
            "slot": pa.array(used, pa.int32()), "g": pa.array(g_sum.ravel()[used], pa.int64()),
            "h": pa.array(h_sum.ravel()[used], pa.int64())})
    return run


def _radix(edges):
    """Place values of the columns' bins in one number, or None if it won't
    fit 62 bits."""
    place, out = 1, []
    for e in edges:
        out.append(place)
        place *= len(e) + 2
    return out if place < 1 << 62 else None


def _codes(bins, edges, radix):
    code = np.zeros(bins.shape[1], np.int64)
    for b, e, place in zip(bins, edges, radix):
        code += np.where(b == MISSING, len(e) + 1, b).astype(np.int64) * place
    return code


def _to_codes(edges, radix):
    """The different codes of each batch."""
    def run(batches):
        for b in batches:
            if b.num_rows:
                code = _codes(to_bins(_dense(b.column(0), len(edges)), edges), edges, radix)
                yield pa.RecordBatch.from_pydict({"code": pa.array(np.unique(code), pa.int64())})
    return run


def _cell_bins(codes, edges, radix):
    """The bins of each code, one row for each column."""
    out = np.empty((len(edges), len(codes)), np.uint8)
    for j, (e, place) in enumerate(zip(edges, radix)):
        digit = codes // place % (len(e) + 2)
        out[j] = np.where(digit == len(e) + 1, MISSING, digit)
    return out


def _to_cell_blocks(edges, radix, codes):
    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1 << 14):    # as many rounded gradients add up exactly
                part = b.slice(at, 1 << 14)
                code = _codes(to_bins(_dense(part.column(0), len(edges)), edges), edges, radix)
                yield pa.RecordBatch.from_pydict({
                    "n": pa.array([len(code)], pa.int32()),
                    "cell": [np.searchsorted(codes, code).astype(np.int32).tobytes()],
                    "label": [part.column(1).to_numpy(zero_copy_only=False).astype(np.float64).tobytes()],
                    "key": [part.column(2).to_numpy(zero_copy_only=False).astype(np.uint32).tobytes()]})
    return run


def _cell_tally(margin, step, draws):
    """Sums per cell of the rows each of ``draws`` (number -> key -> times a
    row is taken) takes; a task sends one row a tree."""
    def run(batches):
        size = len(margin)
        total = {t: (np.zeros(size, np.int64), np.zeros(size, np.int64)) for t in draws}
        for b in batches:
            cols = {c: b.column(i) for i, c in enumerate(b.schema.names)}
            for i in range(b.num_rows):
                cell = np.frombuffer(cols["cell"][i].as_buffer(), np.int32)
                label = np.frombuffer(cols["label"][i].as_buffer())
                key = np.frombuffer(cols["key"][i].as_buffer(), np.uint32)
                g = np.rint((margin[cell] - label) * step)
                for t, draw in draws.items():
                    times = draw(key)
                    if times.dtype == bool:
                        at, gt, ht = cell[times], g[times], None
                    else:
                        at, gt, ht = cell, g * times, times
                    total[t][0][:] += np.bincount(at, gt, size).astype(np.int64)
                    total[t][1][:] += np.bincount(at, ht, size).astype(np.int64)
        yield pa.RecordBatch.from_pydict({
            "tree": pa.array(list(total), pa.int32()), "g": [g.tobytes() for g, _ in total.values()],
            "h": [h.tobytes() for _, h in total.values()]})
    return run


def _cell_slots(batches):
    """The sums of ``_cell_tally`` one by one."""
    for b in batches:
        for row in b.to_pylist():
            g, h = np.frombuffer(row["g"], np.int64), np.frombuffer(row["h"], np.int64)
            used = np.flatnonzero(h)
            yield pa.RecordBatch.from_pydict({
                "tree": pa.array(np.full(len(used), row["tree"]), pa.int32()), "slot": pa.array(used, pa.int32()),
                "g": pa.array(g[used], pa.int64()), "h": pa.array(h[used], pa.int64())})


class Cells:
    """The rows as blocks of cell numbers, and the cells' bins."""

    def __init__(self, blocks: DataFrame, parts: int, bins):
        self.blocks, self.parts, self.bins = blocks, parts, bins

    @classmethod
    def of(cls, rows: DataFrame, edges, n: int):
        """None if there are too many different rows of bins."""
        radix = _radix(edges)
        if radix is None:
            return None
        found = rows.mapInArrow(_to_codes(edges, radix), "code long").distinct().limit(MAX_CELLS + 1).collect()
        if len(found) > MAX_CELLS:
            return None
        codes = np.sort(np.array([r["code"] for r in found], np.int64))
        blocks = rows.mapInArrow(_to_cell_blocks(edges, radix, codes), CELL_BLOCKS)
        spread = rows.sparkSession.sparkContext.defaultParallelism
        parts = max(1, min(spread, -(-n // PART_ROWS)))
        return cls(HistogramBooster._stored(blocks.repartition(parts), rows.sparkSession, parts), parts,
                   _cell_bins(codes, edges, radix))

    def sums(self, margin, step, draws) -> dict:
        """{tree: (g, h) per cell}, exact integers."""
        size = self.bins.shape[1]
        got = self.blocks.mapInArrow(_cell_tally(margin, step, draws), CELL_SUMS)
        out = {t: (np.zeros(size, np.int64), np.zeros(size, np.int64)) for t in draws}
        if self.parts * size * len(draws) <= DRIVER_SUMS:
            for r in got.collect():
                for total, part in zip(out[r["tree"]], (r["g"], r["h"])):
                    total += np.frombuffer(part, np.int64)
            return out
        merged = got.mapInArrow(_cell_slots, "tree int, " + SUMS).groupBy("tree", "slot").agg(
            F.sum("g").alias("g"), F.sum("h").alias("h")).toPandas()
        for t, part in merged.groupby("tree"):
            out[t][0][part["slot"]], out[t][1][part["slot"]] = part["g"], part["h"]
        return out

    def level(self, g, h):
        """Sums per (node, column, bin) of a level, out of those per cell."""
        def found(tree, level, columns, cells):
            first, nodes = 2 ** level - 1, 2 ** level
            at = tree.nodes(self.bins)
            here = np.flatnonzero((h > 0) & (at >= first))
            last = np.where(np.arange(256) == MISSING, cells - 1, np.arange(256))
            sums = [np.zeros((nodes, len(columns), cells), np.int64) for _ in range(2)]
            for total, part in zip(sums, (g[here], h[here])):
                for j, c in enumerate(columns):
                    np.add.at(total, (at[here] - first, j, last[self.bins[c, here]]), part)
            return sums
        return found


def best_split(g, h, lam: float, min_child: float):
    """The best cut of one node from its (column, bin) sums, the last bin
    being the missing values: (gain, column position, cut, missing left) or
    None. Ties go to the first column, the lowest cut, missing to the right."""
    total_g, total_h = g[0].sum(), h[0].sum()
    own = total_g ** 2 / (total_h + lam)
    best = None
    for j in range(len(g)):
        left_g, left_h = np.cumsum(g[j, :-1])[:-1], np.cumsum(h[j, :-1])[:-1]
        for missing_left in (False, True):
            lg, lh = (left_g + g[j, -1], left_h + h[j, -1]) if missing_left else (left_g, left_h)
            rg, rh = total_g - lg, total_h - lh
            fits = (lh >= min_child) & (rh >= min_child)
            if not fits.any():
                continue
            gain = np.where(fits, lg ** 2 / (np.maximum(lh, 1) + lam) + rg ** 2 / (np.maximum(rh, 1) + lam) - own,
                            -np.inf)
            cut = int(np.argmax(gain))
            if gain[cut] > 1e-9 * max(own, 1.0) and (best is None or gain[cut] > best[0]):
                best = float(gain[cut]), j, cut, missing_left
            if h[j, -1] == 0:
                break
    return best


class _BoosterParams(HasFeaturesCol, HasLabelCol, HasPredictionCol):
    maxIter = Param(Params._dummy(), "maxIter", "trees", TypeConverters.toInt)
    stepSize = Param(Params._dummy(), "stepSize", "learning rate", TypeConverters.toFloat)
    maxDepth = Param(Params._dummy(), "maxDepth", "levels of splits", TypeConverters.toInt)
    maxBins = Param(Params._dummy(), "maxBins", "bins of a column (255 at most)", TypeConverters.toInt)
    subsamplingRate = Param(Params._dummy(), "subsamplingRate", "share of rows of a tree", TypeConverters.toFloat)
    columnRate = Param(Params._dummy(), "columnRate", "share of columns of a tree", TypeConverters.toFloat)
    regLambda = Param(Params._dummy(), "regLambda", "added to a leaf's row count", TypeConverters.toFloat)
    minChild = Param(Params._dummy(), "minChild", "least rows of a child", TypeConverters.toFloat)
    seed = Param(Params._dummy(), "seed", "seed of the samples", TypeConverters.toInt)
    idCol = Param(Params._dummy(), "idCol", "unique row key, for repeatable samples", TypeConverters.toString)
    strict = Param(Params._dummy(), "strict", "refuse labels that are null or not finite", TypeConverters.toBoolean)
    edges = Param(Params._dummy(), "edges", "ascending bin edges by column", TypeConverters.identity)

    def __init__(self):
        super().__init__()
        self._setDefault(maxIter=100, stepSize=0.3, maxDepth=6, maxBins=255, subsamplingRate=1.0, columnRate=1.0,
                         regLambda=1.0, minChild=1.0, seed=42, idCol="", edges=None, strict=False)

    def setFeaturesCol(self, value):
        return self._set(featuresCol=value)

    def setLabelCol(self, value):
        return self._set(labelCol=value)

    def setPredictionCol(self, value):
        return self._set(predictionCol=value)


class HistogramBooster(Estimator, _BoosterParams, DefaultParamsReadable, DefaultParamsWritable):
    """Boosted regression trees (squared error) on histograms."""

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", predictionCol="prediction", maxIter=100,
                 stepSize=0.3, maxDepth=6, maxBins=255, subsamplingRate=1.0, columnRate=1.0, regLambda=1.0,
                 minChild=1.0, seed=42, idCol="", edges=None, strict=False):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _rows(self, dataset: DataFrame) -> DataFrame:
        """features array<double>, label, key below 2^32."""
        of = self.getOrDefault
        key = (F.conv(F.substr(F.md5(F.col(of(self.idCol)).cast("string")), F.lit(1), F.lit(8)), 16, 10).cast("long")
               if of(self.idCol) else F.monotonically_increasing_id().bitwiseAND(0xFFFFFFFF))
        x = F.col(of(self.featuresCol))
        if dataset.schema[of(self.featuresCol)].dataType.typeName() != "array":
            x = vector_to_array(x)
        label = F.col(of(self.labelCol)).cast("double")
        return (dataset.select(x.alias("x"), label.alias("label"), F.coalesce(key, F.lit(0)).alias("key"))
                .filter("label is not null and not isnan(label) and abs(label) < double('inf')"))

    def _edges(self, rows: DataFrame, width: int):
        given = self.getOrDefault(self.edges)
        if given is None:
            most = min(self.getOrDefault(self.maxBins), MAX_EDGES + 1)
            probs = [i / most for i in range(1, most)]
            cols = rows.select(*[F.get("x", F.lit(j)).alias(f"x{j}") for j in range(width)])
            given = [sorted(set(e)) for e in
                     cols.approxQuantile(cols.columns, probs, 1.0 / (4 * most))]
        edges = [np.asarray(e, np.float64) for e in given]
        if any(len(e) > MAX_EDGES for e in edges):
            raise ValueError(f"a column may have at most {MAX_EDGES} edges")
        return edges

    def _start(self, dataset):
        """The rows, their number and last part, the step of rounded
        gradients, the mean label and the columns' edges."""
        rows = self._rows(dataset)
        if self.getOrDefault(self.strict) and rows.count() < dataset.count():
            raise ValueError("labels must not be null, NaN or infinite")
        n, top, width, parts = rows.withColumn("part", F.spark_partition_id()).agg(
            F.count(F.lit(1)), F.max(F.abs("label")), F.max(F.size("x")), F.max("part")).first()
        if not n:
            return rows, 0, 0, 1.0, 0.0, []
        # residuals stay within a few times the largest label
        high = int(np.ceil(np.log2(4.0 * top + 1e-300))) if top else 0
        step = 2.0 ** (min(ROW_BITS, SUM_BITS - int(np.ceil(np.log2(n + 1)))) - high)
        base = rows.agg(F.sum(F.rint(F.col("label") * step).cast("long"))).first()[0] / step / n
        return rows, n, parts, step, base, self._edges(rows, width)

    def _fit(self, dataset):
        return self._copyValues(self.grown(dataset)[0])

    def grown(self, dataset):
        """The model and its trees with their gains and sums."""
        of, spark = self.getOrDefault, dataset.sparkSession
        rows, n, parts, step, base, edges = self._start(dataset)
        if not n:
            return BoosterModel(state=json.dumps({"base": 0.0, "depth": 0, "edges": [], "trees": []})), []
        width = len(edges)
        cells = Cells.of(rows, edges, n)
        if cells is not None:
            trees = self._from_cells(cells, edges, step, base)
            cells.blocks.unpersist()
            return self._model(base, edges, trees), trees
        blocks = rows.mapInArrow(_to_blocks(edges, base), BLOCKS)
        # every level reads the blocks: few rows in many tasks, or many in few, would cost each time
        parts = int(parts) + 1
        want = min(max(spark.sparkContext.defaultParallelism, parts), -(-n // PART_ROWS))
        if want != parts:
            blocks = blocks.repartition(want) if want > parts else blocks.coalesce(want)
        blocks = self._stored(blocks, spark)
        trees, old = [], None
        for number in range(of(self.maxIter)):
            tree = self._grow(blocks, width, edges, step, number, old, lone=want == 1)
            trees.append(tree)
            if number + 1 < of(self.maxIter):
                old, fresh = blocks, blocks.mapInArrow(_renew(tree, width), BLOCKS)
                blocks = self._stored(fresh, spark) if (number + 1) % REFRESH == 0 else fresh.persist()
        blocks.unpersist()
        return self._model(base, edges, trees), trees

    def _model(self, base, edges, trees):
        return BoosterModel(state=json.dumps({
            "base": base, "depth": self.getOrDefault(self.maxDepth), "edges": [e.tolist() for e in edges],
            "trees": [t.to_list() for t in trees]}))

    def _from_cells(self, cells, edges, step, base):
        of = self.getOrDefault
        margin, trees = np.full(cells.bins.shape[1], base), []
        seed, rate = of(self.seed), of(self.subsamplingRate)
        for number in range(of(self.maxIter)):
            def draw(key, number=number):
                return drawn_rows(key, seed, number, rate)
            g, h = cells.sums(margin, step, {number: draw})[number]
            tree = self._cut(cells.level(g, h), edges, step, number)
            trees.append(tree)
            margin = margin + tree.scores(cells.bins)
        return trees

    @staticmethod
    def _stored(blocks: DataFrame, spark, parts: int | None = None) -> DataFrame:
        """Written where every executor reads it; the cached copy is a shortcut."""
        path = scratch_path(spark, "booster_blocks")
        blocks.write.parquet(path)
        back = spark.read.parquet(path)
        return (back.repartition(parts) if parts else back).persist()

    def _grow(self, blocks, width, edges, step, number, old=None, lone=False):
        """One tree. ``old`` are the blocks of the tree before, let go once
        the first pass has filled the new ones; ``lone`` blocks (one part) need
        no exchange of sums."""
        of = self.getOrDefault
        before = [old]

        def passed(tree, level, columns, cells):
            tally = _tally(tree, level, columns, width, cells, step, of(self.seed), number, of(self.subsamplingRate))
            sums = blocks.mapInArrow(tally, SUMS)
            found = ((sums.coalesce(1) if lone else sums).groupBy("slot").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
                     .toPandas())
            if before[0] is not None:
                before[0].unpersist()
                before[0] = None
            g, h = (np.zeros((2 ** level, len(columns), cells), np.int64) for _ in range(2))
            g.ravel()[found["slot"]], h.ravel()[found["slot"]] = found["g"], found["h"]
            return g, h

        return self._cut(passed, edges, step, number)

    def _cut(self, sums_of, edges, step, number):
        """One tree, level by level; ``sums_of`` gives a level's sums of
        gradients and rows per (node, column, bin)."""
        of = self.getOrDefault
        lam, depth, rate = of(self.regLambda), of(self.maxDepth), of(self.stepSize)
        columns = drawn_columns(len(edges), of(self.seed), number, of(self.columnRate))
        cells = max(len(edges[c]) for c in columns) + 2
        tree = Tree(depth)
        alive = {0}
        for level in range(depth):
            g, h = sums_of(tree, level, columns, cells)
            after = set()
            for node in sorted(alive):
                k = node - (2 ** level - 1)
                node_g = g[k] / step
                tree.g[node], tree.h[node] = node_g[0].sum(), h[k][0].sum()
                tree.value[node] = -rate * tree.g[node] / ((tree.h[node] + lam) or 1.0)
                best = best_split(node_g, h[k], lam, of(self.minChild)) if tree.h[node] else None
                if best is None:
                    continue
                tree.gain[node], j, cut, left = best
                tree.column[node], tree.cut[node], tree.missing_left[node] = columns[j], cut, left
                low = slice(None, cut + 1)
                sums = [node_g[j][low].sum() + (node_g[j][-1] if left else 0.0),
                        h[k][j][low].sum() + (h[k][j][-1] if left else 0)]
                for child, (cg, ch) in ((2 * node + 1, sums),
                                        (2 * node + 2, (tree.g[node] - sums[0], tree.h[node] - sums[1]))):
                    tree.g[child], tree.h[child] = cg, ch
                    tree.value[child] = -rate * cg / (ch + lam)
                    after.add(child)
            alive = after
            if not alive:
                break
        return tree


def bootstrap(key, seed: int, tree: int):
    """How often each row key is in the tree's bootstrap sample (Poisson, mean 1)."""
    salt = mix32((seed * 1_000_003 + tree) & 0xFFFFFFFF)
    return np.searchsorted(_POISSON, mix32(key.astype(np.uint64) ^ salt).astype(np.float64) / 2 ** 32, side="right")


_POISSON = np.cumsum([np.exp(-1.0) / math.factorial(i) for i in range(13)])


class HistogramForest(HistogramBooster):
    """A regression forest (``maxIter`` trees on bootstrap samples, all columns
    at every node). The sums per cell of ``TREES_A_PASS`` trees come from one
    pass over the rows. Rows with more than ``MAX_CELLS`` different bins go to
    Spark's own forest of the same settings."""

    TREES_A_PASS = 10

    def _fit(self, dataset):
        of = self.getOrDefault
        rows, n, _, step, base, edges = self._start(dataset)
        cells = Cells.of(rows, edges, n) if n else None
        if n and cells is None:
            label = F.col(of(self.labelCol)).cast("double")
            return RandomForestRegressor(
                numTrees=of(self.maxIter), featureSubsetStrategy="all", maxDepth=of(self.maxDepth),
                maxBins=of(self.maxBins), seed=of(self.seed), featuresCol=of(self.featuresCol),
                labelCol=of(self.labelCol), predictionCol=of(self.predictionCol)).fit(
                    dataset.filter(label.isNotNull() & ~F.isnan(label) & (F.abs(label) < float("inf"))))
        if not n:
            return self._copyValues(self.grown(dataset)[0])
        step /= 16.0     # a row may be taken that often
        seed, total = of(self.seed), of(self.maxIter)
        margin, trees = np.full(cells.bins.shape[1], base), []
        for first in range(0, total, self.TREES_A_PASS):
            some = range(first, min(first + self.TREES_A_PASS, total))
            draws = {t: functools.partial(bootstrap, seed=seed, tree=t) for t in some}
            for t, (g, h) in sorted(cells.sums(margin, step, draws).items()):
                tree = self._cut(cells.level(g, h), edges, step, t)
                tree.value /= total
                trees.append(tree)
        cells.blocks.unpersist()
        return self._copyValues(self._model(base, edges, trees))


class BoosterModel(Model, _BoosterParams, DefaultParamsReadable, DefaultParamsWritable):
    """Base value plus the trees' leaf values, by Arrow batches."""

    state = Param(Params._dummy(), "state", "base, edges and trees as JSON", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, state=None):
        super().__init__()
        if state is not None:
            self._set(state=state)

    def _transform(self, dataset):
        shared = dataset.sparkSession.sparkContext.broadcast(self.getOrDefault(self.state))

        @F.pandas_udf("double")
        def score(parts: pd.Series) -> pd.Series:
            model = _loaded(shared.value)
            if not model["edges"] or not len(parts):
                return pd.Series(np.full(len(parts), model["base"]))
            width = len(model["edges"])
            x = np.array([np.full(width, np.nan) if p is None else np.asarray(p, np.float64) for p in parts])
            bins, out = to_bins(x, model["edges"]), np.full(len(parts), model["base"])
            for t in model["trees"]:
                out += t.scores(bins)
            return pd.Series(out)

        x = F.col(self.getOrDefault(self.featuresCol))
        if dataset.schema[self.getOrDefault(self.featuresCol)].dataType.typeName() != "array":
            x = vector_to_array(x)
        return dataset.withColumn(self.getOrDefault(self.predictionCol), score(x))


_LAST: list = [None, None]


def _loaded(state: str):
    """The parsed model; a task keeps the last one."""
    if _LAST[0] is not state and _LAST[0] != state:
        raw = json.loads(state)
        raw["edges"] = [np.asarray(e, np.float64) for e in raw["edges"]]
        raw["trees"] = [Tree.of_list(raw["depth"], t) for t in raw["trees"]]
        _LAST[:] = state, raw
    return _LAST[1]
