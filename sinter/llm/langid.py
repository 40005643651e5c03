"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts, up to ``order`` bytes deep, with
the counts of the byte that followed. A context predicts the bytes it has
seen with count / (total + distinct) and escapes with
distinct / (total + distinct) to the next shorter context, from which the
bytes already predicted are excluded; below order 0 all remaining byte
values are equally likely. The statistics are frozen after training, so the
code length of a byte depends on its context alone and is tabulated once:
row = the longest context that any of the trees holds, column = byte, one
value per language. A text's code length under every language is then a sum
of table rows, found by numpy without a loop over bytes, and the language
with the shortest code wins.

The model is fitted on a bounded sample of labelled rows (``per_lang``
documents of each language, whole texts) and scores every text. Its size is
bounded too: ``max_contexts`` contexts with at least ``min_count`` bytes.

Defined results: a text that is null or has no letter gives ``und`` with
score 0, as does every text if there was nothing to learn from; equal code
lengths go to the language that sorts first; null ids are scored and never
learned from; an empty table gives no rows; other columns are passed on.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sinter.llm.common import byte_slices, crc_of, map_arrow, text_bytes

ORDER = 3
PER_LANG = 500
MAX_CONTEXTS = 12_000
MIN_COUNT = 8
SLICE_BYTES = 1 << 20
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


@dataclass
class Model:
    langs: list[str]
    symbol: np.ndarray   # byte -> symbol; symbol 0 is "before the text" or never seen
    context: np.ndarray  # three symbols before -> row of the table
    bits: np.ndarray     # [language, row * symbols + symbol] code length
    extra: np.ndarray    # bits that a byte of symbol 0 adds: which one it is


def _symbols(data, off, symbol):
    """Symbols of the bytes, and of the 1, 2, 3 bytes before each."""
    s = symbol[data]
    before = []
    for k in (1, 2, 3):
        p = np.zeros_like(s)
        p[k:] = s[:-k]
        for j in range(k):  # nothing comes before a text
            at = off[:-1] + j
            p[at[at < len(s)]] = 0
        before.append(p)
    return s, before


def _tree(s, before, a, order):
    """Counts [context, symbol] of each order as {code: row of counts}."""
    levels, code = [], np.zeros(len(s), np.int64)
    scale = 1
    for k in range(order + 1):
        if k:
            code = code + before[k - 1].astype(np.int64) * scale
            scale *= a
        key, n = np.unique(code * a + s, return_counts=True)
        levels.append((key, n))
    return levels


def train(texts: dict[str, list[str]], order: int = ORDER, max_contexts: int = MAX_CONTEXTS,
          min_count: int = MIN_COUNT) -> Model:
    """Fit the context trees of all languages and tabulate code lengths."""
    if not 1 <= order <= 3:
        raise ValueError("order must be 1, 2 or 3")
    langs = sorted(texts)
    coded = {g: text_bytes(pa.array(texts[g], pa.large_string())) for g in langs}
    seen = np.zeros(256, bool)
    for data, _ in coded.values():
        seen[data] = True
    symbol = np.zeros(256, np.int32)
    symbol[seen] = 1 + np.arange(seen.sum())
    a = int(seen.sum()) + 1
    trees, weight = {}, {}
    for g in langs:
        data, off = coded[g]
        trees[g] = _tree(*_symbols(data, off, symbol), a, order)
        for k, (key, n) in enumerate(trees[g]):
            ctx, inv = np.unique(key // a, return_inverse=True)
            for c, t in zip(ctx.tolist(), np.bincount(inv, n).tolist()):
                if t >= min_count or k == 0:
                    weight[k, c] = max(weight.get((k, c), 0), t)
    # all contexts of order 0 and 1, then those with the most bytes
    ranked = sorted(weight, key=lambda x: (x[0] > 1, -weight[x], x))[:max_contexts]
    kept = [sorted(c for k, c in ranked if k == d) for d in range(order + 1)]
    # a context stays only with its shorter ones, so that suffixes exist
    for d in range(2, order + 1):
        short = set(kept[d - 1])
        kept[d] = [c for c in kept[d] if c % a ** (d - 1) in short]
    row, base = [], 0
    for d in range(order + 1):
        row.append({c: base + i for i, c in enumerate(kept[d])})
        base += len(kept[d])
    bits = np.zeros((base, a, len(langs)), np.float32)
    for j, g in enumerate(langs):
        lower = {}
        for d in range(order + 1):
            key, n = trees[g][d]
            counts = np.zeros((len(kept[d]), a))
            at = np.array([row[d].get(int(c), -1) for c in key // a]) - (base_of(row, d))
            ok = at >= 0
            counts[at[ok], key[ok] % a] = n[ok]
            if d == 0:
                # below order 0: all byte values alike, symbol 0 stands for the unseen ones
                flat = np.ones(a) / 256.0
                flat[0] = (257 - a) / 256.0
                parent = np.broadcast_to(flat, (len(kept[0]), a))
            else:
                parent = lower["p"][[row[d - 1][c % a ** (d - 1)] - base_of(row, d - 1) for c in kept[d]]] \
                    if kept[d] else np.zeros((0, a))
            p = _escape(counts, parent)
            lower["p"] = p
            if len(p):
                b0 = base_of(row, d)
                bits[b0:b0 + len(p), :, j] = -np.log2(np.maximum(p, 1e-300))
    # every triple of symbols -> its longest kept context
    context = np.zeros(a ** order, np.int32)
    triple = np.arange(a ** order)
    context[:] = row[0][0]
    for d in range(1, order + 1):
        look = np.full(a ** d, -1, np.int32)
        for c, i in row[d].items():
            look[c] = i
        got = look[triple % a ** d]
        context = np.where(got >= 0, got, context)
    extra = np.zeros(a, np.float32)
    extra[0] = np.log2(max(1, 257 - a))
    return Model(langs, symbol, context, np.ascontiguousarray(bits.reshape(base * a, len(langs)).T), extra)


def base_of(row, d: int) -> int:
    """First table row of the contexts of order d."""
    return sum(len(r) for r in row[:d])


def _escape(counts: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """Predictions of contexts from their counts and their parents'
    predictions: method C with exclusion."""
    total, kinds = counts.sum(1), (counts > 0).sum(1)
    rest = np.where(counts > 0, 0.0, parent)
    mass = rest.sum(1)
    full = mass <= 0  # every symbol was seen: nothing to escape to
    esc = np.where(full, 0.0, kinds / np.maximum(total + kinds, 1))
    esc = np.where(total == 0, 1.0, esc)
    scale = np.where(full, np.maximum(total, 1), np.maximum(total + kinds, 1))
    return counts / scale[:, None] + rest * (esc / np.where(full, 1.0, mass))[:, None]


def code_lengths(model: Model, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Bits of every text under every language, [texts, languages]."""
    out = np.zeros((len(off) - 1, len(model.langs)))
    a = len(model.extra)
    order = 1
    while a ** order < len(model.context):
        order += 1
    for x, y in byte_slices(off, SLICE_BYTES):
        d, o = data[off[x]:off[y]], off[x:y + 1] - off[x]
        if not len(d):
            continue
        s, before = _symbols(d, o, model.symbol)
        code = before[0]
        scale = a
        for p in before[1:order]:
            code = code + p * np.int32(scale)
            scale *= a
        at = model.context[code] * np.int32(a) + s
        some = np.flatnonzero(np.diff(o))
        starts = o[some]
        for j in range(len(model.langs)):
            out[x + some, j] = np.add.reduceat(model.bits[j].take(at), starts, dtype=np.float64)
        unseen = s == 0
        if unseen.any():
            out[x + some] += np.add.reduceat(unseen * model.extra[0], starts, dtype=np.float64)[:, None]
    return out


def has_letter(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    out = np.zeros(len(off) - 1, bool)
    some = np.flatnonzero(np.diff(off))
    if len(some):
        out[some] = np.logical_or.reduceat(_LETTER[data], off[some])
    for i in some[~out[some]]:  # beyond ASCII
        out[i] = any(c.isalpha() for c in data[off[i]:off[i + 1]].tobytes().decode("utf-8"))
    return out


def sample(docs: DataFrame, learn: Column, per_lang: int = PER_LANG, id_col: str = "doc_id",
           text_col: str = "text", lang_col: str = "lang") -> dict[str, list[str]]:
    """At most ``per_lang`` texts of each language, those with the smallest
    hash of id and text: the same rows whatever the partitions."""
    rows = docs.filter(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}
    out: dict[str, list[str]] = {}
    # a coarse cut by hash, so that few texts reach the exact one
    coarse = F.lit(False)
    h = F.xxhash64(id_col, F.octet_length(text_col))
    span = 1 << 32
    for g, n in sizes.items():
        part = min(span, int(span * 2 * per_lang / n) + 1)
        coarse = coarse | ((F.col(lang_col) == g) & (F.pmod(h, F.lit(span)) < part))
    few = rows.filter(coarse) if sizes else rows
    for g in sorted(sizes):
        one = (few.filter(F.col(lang_col) == g).orderBy(F.pmod(h, F.lit(span)), id_col, F.xxhash64(text_col))
               .limit(per_lang).select(F.col(lang_col).alias("g"), F.col(text_col).alias("t")))
        for r in one.collect():
            out.setdefault(r["g"], []).append(r["t"])
    return out


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text",
            keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, *keep, lang_pred, score, bits_per_byte) of every text."""
    bc = docs.sparkSession.sparkContext.broadcast(model)
    n_keep = 1 + len(keep)
    narrow = docs.select(id_col, *keep, F.col(text_col).alias("__text"))

    def score(batches):
        m = bc.value
        for batch in batches:
            data, off = text_bytes(batch.column(n_keep))
            n = len(off) - 1
            pred, conf, bpb = np.full(n, "und", object), np.zeros(n), np.zeros(n)
            ok = has_letter(data, off)
            if m is not None and ok.any():
                bits = code_lengths(m, data, off)
                best = bits.argmin(1)
                least = bits[np.arange(n), best]
                post = 1.0 / np.exp2(np.maximum(least[:, None] - bits, -1000.0)).sum(1)
                pred[ok] = np.array(m.langs, object)[best[ok]]
                conf[ok] = post[ok]
                bpb[ok] = (least / np.maximum(np.diff(off), 1))[ok]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(n_keep)]
                + [pa.array(pred, pa.string()), pa.array(conf), pa.array(bpb)],
                names=[*batch.schema.names[:n_keep], "lang_pred", "score", "bits_per_byte"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema[:n_keep])
    return map_arrow(narrow, score, f"{schema}, lang_pred string, score double, bits_per_byte double")


def identify(docs: DataFrame, held_out: Column | None = None, id_col: str = "doc_id",
             per_lang: int = PER_LANG, order: int = ORDER) -> DataFrame:
    """Learn from the rows that aren't held out and predict every row.
    Without ``held_out``, rows whose crc32 of the id is 0 mod 5 are."""
    held = F.coalesce(F.pmod(crc_of(F.col(id_col)), F.lit(5)) == 0, F.lit(False)) if held_out is None else held_out
    texts = sample(docs, ~held & F.col(id_col).isNotNull(), per_lang, id_col)
    model = train(texts, order) if texts else None
    rows = docs.withColumn("held_out", held)
    return predict(rows, model, id_col, keep=("held_out",))
