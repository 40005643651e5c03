"""Toxicity by a bidirectional gated recurrent network with attention.

Inputs of a word. Word part: the log-odds of the word between toxic and
other training documents, and a learned vector of its hash row. Character
part: the largest and the mean log-odds of its character n-grams (3, 5 and
6 bytes, word ends marked), and the mean of their learned vectors. A forward
and a backward GRU read windows of ``WINDOW`` words that overlap by a quarter;
attention pools their states and a logistic unit gives the window's logit.
A text's logit is that of its worst window, put on a probability scale by a
logistic fit over the training documents.

Training is numpy back-propagation with Adam. Labels are of whole texts, so
each round scores all windows of the training texts and learns from the
worst window of every text, plus others of texts that aren't toxic. Log-odds
are cross-fitted: a training text sees those of the other half. Near copies
among the training texts count once. The sample is bounded (``PER_CLASS``
texts of each label, ``SAMPLE_BYTES`` of text; a text beyond that is passed
over) and is read by one task, which trains; the driver sees the finished
model only. Words are hashed with fixed seeds, so reruns agree. Scoring
covers all windows of all texts.

Defined results: a null text, an empty one and one without letters have the
score of a text without any window, the share of toxic texts in training at
most; with one label or none to learn from, all scores are 0; null and
repeated labels: a document counts once with its highest label, null labels
don't count; ids may be of any type; an empty table gives no rows; ``score``
and ``reject`` pass other columns on, ``classify`` returns its four.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sinter.llm.common import byte_slices, crc_of, map_arrow, text_bytes
from sinter.llm.tokens import ragged

WINDOW, STRIDE = 32, 16
HIDDEN, VEC = 6, 4
WORD_ROWS, GRAM_ROWS = 1 << 16, 1 << 16
GRAMS = (3, 5, 6)
PER_CLASS = 2500
SAMPLE_BYTES = 64 << 20
CUT = 0.3
SHRINK = 1.3
EPOCHS, BATCH, RATE = 5, 128, 0.02
LEAST_STEPS = 60  # of an epoch
SLICE_BYTES = 4 << 20
_MUL = np.uint64(0x9E3779B97F4A7C15)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[65:91] = _IN_WORD[97:123] = True
_IN_WORD[128:] = True


def words_of(data: np.ndarray, off: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Lower-cased runs of letters, and at which of them each text begins."""
    low = _LOWER[data]
    if len(data) > 1:  # capitals of the Latin-1 block
        wide = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)) + 1
        low[wide] += 32
    inside = _IN_WORD[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    first = off[:-1][off[:-1] < len(data)]
    begin[first] = inside[first]
    at = np.cumsum(inside)  # letters up to and with each byte
    starts = np.flatnonzero(begin)
    bounds = np.append(at[starts] - 1, at[-1] if len(at) else 0).astype(np.int64)
    letters = np.ascontiguousarray(low[inside])
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(letters))
    return words, np.searchsorted(starts, off)


def _hashes(words: pa.Array):
    """Row of each word, rows of all its n-grams, and n-grams per word."""
    data, off = text_bytes(words)
    n = np.diff(off)
    # each word between two marks
    size = n + 2
    o = np.cumsum(size) - size
    b = np.full(int(size.sum()), 1, np.uint64)
    b[ragged(o + 1, n)] = data.astype(np.uint64) + np.uint64(2)
    power = np.uint64(0x100000001B3)
    acc = b.copy()
    rows, lens, word = [], [], np.zeros(len(n), np.uint64)
    with np.errstate(over="ignore"):
        # word hash: positions weighted by powers of an odd number
        pw = np.cumprod(np.full(int(size.max()) if len(size) else 1, power, np.uint64))
        word = np.add.reduceat(b * pw[np.arange(len(b)) - np.repeat(o, size)], o) if len(b) else word
        word = ((word * _MUL) >> np.uint64(64 - 16)).astype(np.int64) % WORD_ROWS
        for k in range(1, max(GRAMS)):
            if k < len(b):
                acc[:-k] = acc[:-k] * power + b[k:]
            if k + 1 in GRAMS:  # every word has at least one of 3 bytes
                c = np.maximum(size - k, 0)
                g = ((acc * _MUL) >> np.uint64(64 - 16)).astype(np.int64) % GRAM_ROWS
                rows.append((o, c, g))
                lens.append(c)
    total = sum(lens)
    out = np.zeros(int(total.sum()), np.int64)
    at = np.cumsum(total) - total
    for (s, c, g) in rows:
        out[ragged(at, c)] = g[ragged(s, c)]
        at = at + c
    return word, out, total


def _mean_by(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Means of consecutive groups of rows; no group is empty."""
    at = np.cumsum(counts) - counts
    return np.add.reduceat(values, at, axis=0) / counts.reshape(-1, *[1] * (values.ndim - 1))


@dataclass
class Model:
    par: dict[str, np.ndarray]
    word_odds: np.ndarray
    gram_odds: np.ndarray
    scale: float = 1.0
    shift: float = 0.0
    empty: float = 0.0


def inputs(par, word_odds, gram_odds, word, gram, n_gram) -> np.ndarray:
    """Input vector of each distinct word."""
    at = np.cumsum(n_gram) - n_gram
    odds = gram_odds[gram]
    return np.column_stack([
        word_odds[word], np.maximum.reduceat(odds, at), _mean_by(odds, n_gram),
        par["Ew"][word], _mean_by(par["Eg"][gram], n_gram)]).astype(np.float32)


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


def forward(par, proj, keep: bool = False, mask=None):
    """Logits of windows. ``proj`` [2, T, B, 3H]: input projections for the
    forward GRU, and for the backward one in reversed order."""
    _, t, b, _ = proj.shape
    h = np.zeros((2, b, HIDDEN), proj.dtype)
    states = np.empty((2, t, b, HIDDEN), proj.dtype)
    memo = []
    for i in range(t):
        x = proj[:, i]
        u = np.matmul(h, par["U"])
        # gates: (1 + tanh) / 2
        zr = x[..., :2 * HIDDEN] + u[..., :2 * HIDDEN]
        np.tanh(zr, out=zr)
        zr *= np.float32(0.5)
        zr += np.float32(0.5)
        z, r = zr[..., :HIDDEN], zr[..., HIDDEN:]
        un = u[..., 2 * HIDDEN:]
        n = r * un
        n += x[..., 2 * HIDDEN:]
        np.tanh(n, out=n)
        new = h - n
        new *= z
        new += n
        if mask is not None:
            m = mask[:, i]
            new = np.where(m, new, h)
        if keep:
            memo.append((h, z, r, un, n))
        h = new
        states[:, i] = h
    both = np.concatenate([states[0], states[1, ::-1]], axis=-1)
    score = both @ par["a"]
    if mask is not None:
        score = np.where(mask[0, :, :, 0], score, np.float32(-1e9))
    w = np.exp(score - score.max(0))
    w /= w.sum(0)
    pooled = np.einsum("tb,tbd->bd", w, both)
    logit = pooled @ par["o"] + par["c"]
    return (logit, (states, memo, both, w, pooled)) if keep else logit


def _windows(n: np.ndarray):
    """(text, first word) of all overlapping windows of texts of n words."""
    k = np.where(n > 0, np.maximum(-(-(n - WINDOW) // STRIDE), 0) + 1, 0)
    text = np.repeat(np.arange(len(n)), k)
    j = np.arange(len(text)) - np.repeat(np.cumsum(k) - k, k)
    return text, np.minimum(j * STRIDE, np.maximum(n[text] - WINDOW, 0))


def _gather(proj_words, index, first, size):
    """Projections [2, T, B, 3H] and mask of windows that begin at ``first``
    in ``index`` and have ``size`` words; short ones are padded."""
    t = int(size.max())
    step = np.arange(t)[:, None]
    inside = step < size[None, :]
    at = first[None, :] + np.minimum(step, size[None, :] - 1)
    word = index[at]
    proj = np.stack([proj_words[0][word], proj_words[1][word[::-1]]])
    if inside.all():
        return proj, None
    return proj, np.stack([inside, inside[::-1]])[..., None]


def window_logits(model: Model, x: np.ndarray, index: np.ndarray, begin: np.ndarray, n: np.ndarray):
    """Logits of all windows of texts: (text of each window, first word, logit)."""
    proj = [x @ model.par["W"][d] + model.par["b"][d] for d in (0, 1)]
    text, start = _windows(n)
    size = np.minimum(n[text], WINDOW)
    first = begin[text] + start
    out = np.empty(len(text), np.float32)
    order = np.argsort(size, kind="stable")  # windows of like length together
    for i in range(0, len(order), 2048):
        some = order[i:i + 2048]
        out[some] = forward(model.par, *_split(_gather(proj, index, first[some], size[some])))
    return text, start, out


def _split(pm):
    return pm[0], False, pm[1]


def text_logits(model: Model, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Largest window logit of every text; -inf without words."""
    out = np.full(len(off) - 1, -np.inf)
    for a, b in byte_slices(off, SLICE_BYTES):
        words, at = words_of(data[off[a]:off[b]], off[a:b + 1] - off[a])
        if not len(words):
            continue
        coded = pc.dictionary_encode(words)
        index = coded.indices.to_numpy(zero_copy_only=False)
        x = inputs(model.par, model.word_odds, model.gram_odds, *_hashes(coded.dictionary))
        n = np.diff(at)
        text, _, logit = window_logits(model, x, index, at[:-1], n)
        best = np.full(b - a, -np.inf)
        some = np.flatnonzero(n)
        best[some] = np.maximum.reduceat(logit, np.searchsorted(text, some))
        out[a:b] = best
    return out


def score_of(model: Model, logits: np.ndarray) -> np.ndarray:
    p = _sigmoid(model.scale * np.where(np.isfinite(logits), logits, 0.0) + model.shift)
    return np.where(np.isfinite(logits), p, model.empty)


def _log_odds(y, z, n1, n0, least):
    """Log-odds of each row between the classes, drawn to 0 by ``SHRINK``
    standard errors; rows in fewer than ``least`` texts have 0."""
    lo = np.log((y + 0.5) / (n1 + 1.0)) - np.log((z + 0.5) / (n0 + 1.0))
    err = SHRINK * np.sqrt(1 / (y + 0.5) + 1 / (n1 + 1.0) + 1 / (z + 0.5) + 1 / (n0 + 1.0))
    lo = np.sign(lo) * np.maximum(np.abs(lo) - err, 0)
    return np.where(y + z >= least, lo, 0.0).astype(np.float32)


def distinct_texts(texts: list[str]) -> list[int]:
    """Texts that share no minhash of 5-word shingles with an earlier one."""
    seen, out = set(), []
    for i, t in enumerate(texts):
        w = t.split()
        h = np.array([xxhash.xxh64_intdigest(" ".join(w[j:j + 5])) for j in range(max(1, len(w) - 4))], np.uint64)
        keys = {(k, int(((h ^ np.uint64(k * 0x5851F42D4C957F2D % (1 << 64))) * _MUL).min())) for k in range(1, 5)}
        if not keys & seen:
            out.append(i)
        seen |= keys
    return out


def train(texts: list[str], labels: list[int], epochs: int = EPOCHS, seed: int = 7,
          toxic_share: float | None = None) -> Model | None:
    """Fit the network on texts with labels 0 and 1; None with one class.
    ``toxic_share``: of all labelled texts, where the sample's is another."""
    pick = [i for i in distinct_texts(texts) if texts[i].strip()]
    y = np.array([labels[i] for i in pick], bool)
    if y.all() or not y.any():
        return None
    rng = np.random.default_rng(seed)
    data, off = text_bytes(pa.array([texts[i] for i in pick], pa.large_string()))
    words, at = words_of(data, off)
    n = np.diff(at)
    coded = pc.dictionary_encode(words)
    index = coded.indices.to_numpy(zero_copy_only=False)
    word, gram, n_gram = _hashes(coded.dictionary)
    half = rng.permutation(len(n)) % 2
    g0 = np.cumsum(n_gram) - n_gram
    wc, gc = (np.zeros((2, 2, rows), np.int64) for rows in (WORD_ROWS, GRAM_ROWS))
    for i in range(len(n)):  # texts that have a row, by half and label
        own = np.unique(index[at[i]:at[i + 1]])
        c = 1 - int(y[i])
        wc[half[i], c, np.unique(word[own])] += 1
        gc[half[i], c, np.unique(gram[ragged(g0[own], n_gram[own])])] += 1
    total = [[int(((half == s) & (y == c)).sum()) for c in (True, False)] for s in (0, 1)]
    # odds that texts of half s see come from the other half
    word_odds = [_log_odds(*wc[1 - s], *total[1 - s], 3) for s in (0, 1)]
    gram_odds = [_log_odds(*gc[1 - s], *total[1 - s], 3) for s in (0, 1)]
    full = [[c[0][k] + c[1][k] for k in (0, 1)] for c in (wc, gc, total)]
    h, v = HIDDEN, VEC
    d = 3 + 2 * v
    par = {"Ew": np.zeros((WORD_ROWS, v)), "Eg": rng.normal(0, 0.05, (GRAM_ROWS, v)),
           "W": rng.normal(0, 0.3, (2, d, 3 * h)), "U": rng.normal(0, 0.3, (2, h, 3 * h)),
           "b": np.zeros((2, 3 * h)), "a": rng.normal(0, 0.1, 2 * h), "o": rng.normal(0, 0.3, 2 * h),
           "c": np.zeros(1)}
    par["b"][:, :h] = 1.0  # keep the state at first
    par = {k: x.astype(np.float32) for k, x in par.items()}
    model = Model(par, word_odds[0], gram_odds[0])
    adam = {k: (np.zeros_like(x), np.zeros_like(x)) for k, x in par.items()}
    step = 0
    # at first all windows look alike: begin with those of the largest odds
    for epoch in range(epochs):
        first, size, target, side = [], [], [], []
        for s in (0, 1):
            x = inputs(par, word_odds[s], gram_odds[s], word, gram, n_gram)
            docs = np.flatnonzero((half == s) & (n > 0))
            if not len(docs):
                continue
            if epoch == 0:
                text, start = _windows(n[docs])
                odds = np.concatenate([[0], np.cumsum(np.maximum(x[:, 0], 0)[index] + np.maximum(x[:, 1], 0)[index])])
                f = at[docs][text] + start
                logit = odds[f + np.minimum(n[docs][text], WINDOW)] - odds[f]
            else:
                text, start, logit = window_logits(model, x, index, at[docs], n[docs])
            order = np.lexsort((-logit, text))
            begin = np.searchsorted(text, np.arange(len(docs)))
            top = order[begin]
            extra = rng.integers(0, len(text), len(docs))
            extra = extra[~y[docs[text[extra]]]]
            for w in (top, extra):
                first.append(at[docs[text[w]]] + start[w])
                size.append(np.minimum(n[docs[text[w]]], WINDOW))
                target.append(y[docs[text[w]]])
                side.append(np.full(len(w), s))
        first, size, target, side = (np.concatenate(z) for z in (first, size, target, side))
        share = target.mean()
        rounds = max(1, -(-LEAST_STEPS // max(1, len(first) // BATCH)))
        for _ in range(rounds):
            perm = rng.permutation(len(first))
            for i in range(0, len(perm), BATCH):
                step += 1
                some = perm[i:i + BATCH]
                _learn(par, adam, step, word_odds, gram_odds, word, gram, n_gram, g0, index,
                       first[some], size[some], target[some].astype(np.float32), side[some],
                       np.where(target[some], 0.5 / share, 0.5 / (1 - share)).astype(np.float32))
    # probability scale: logistic fit of the labels on cross-fitted text logits
    logits = np.full(len(n), -np.inf)
    for s in (0, 1):
        docs = np.flatnonzero((half == s) & (n > 0))
        if len(docs):
            text, _, logit = window_logits(model, inputs(par, word_odds[s], gram_odds[s], word, gram, n_gram),
                                           index, at[docs], n[docs])
            logits[docs] = np.maximum.reduceat(logit, np.searchsorted(text, np.arange(len(docs))))
    ok = np.isfinite(logits)
    share = y.mean() if toxic_share is None else toxic_share
    model.scale, model.shift = _logistic(logits[ok], y[ok].astype(float),
                                         np.where(y[ok], share / y.mean(), (1 - share) / (1 - y.mean())))
    model.word_odds = _log_odds(*full[0], *full[2], 4)
    model.gram_odds = _log_odds(*full[1], *full[2], 4)
    model.empty = float(min(share, CUT / 2))
    return model


def _logistic(x, y, weight, penalty: float = 1e-3):
    """Slope and intercept by Newton steps with a small penalty."""
    m, sd = x.mean(), x.std() + 1e-9
    z = np.column_stack([(x - m) / sd, np.ones_like(x)])
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ beta))
        g = z.T @ (weight * (p - y)) + penalty * len(x) * beta * [1, 0]
        hess = (z * (weight * p * (1 - p))[:, None]).T @ z + np.diag([penalty * len(x), 1e-9])
        move = np.linalg.solve(hess, g)
        beta -= np.clip(move, -5, 5)
        if np.abs(move).max() < 1e-9:
            break
    return float(beta[0] / sd), float(beta[1] - beta[0] * m / sd)


def _sums(rows: np.ndarray, values: np.ndarray):
    """Distinct rows in order, and the sums of their values."""
    by = np.argsort(rows, kind="stable")
    first = np.flatnonzero(np.diff(rows[by], prepend=-1))
    return rows[by][first], np.add.reduceat(values[by], first, axis=0)


def gradients(par, word_odds, gram_odds, word, gram, n_gram, g0, index, first, size, y, side, weight):
    """Gradients of the mean weighted logistic loss of a batch of windows:
    of the weights by name, and of the rows of hash tables as (rows, values)."""
    t, b, kind = int(size.max()), len(first), par["W"].dtype
    pos = np.arange(t)[:, None]
    inside = pos < size[None, :]
    tok = index[first[None, :] + np.minimum(pos, size[None, :] - 1)]
    # distinct (word, half) of the batch
    uniq, inv = np.unique(tok * 2 + side[None, :], return_inverse=True)
    inv = inv.reshape(tok.shape)
    u, half = uniq // 2, uniq % 2
    ng = n_gram[u]
    grams = gram[ragged(g0[u], ng)]
    x = np.empty((len(u), 3 + 2 * VEC), kind)
    at = np.cumsum(ng) - ng
    wo, go = np.stack(word_odds), np.stack(gram_odds)
    x[:, 0] = wo[half, word[u]]
    odds = go[np.repeat(half, ng), grams]
    x[:, 1] = np.maximum.reduceat(odds, at)
    x[:, 2] = np.add.reduceat(odds, at) / ng
    x[:, 3:3 + VEC] = par["Ew"][word[u]]
    x[:, 3 + VEC:] = _mean_by(par["Eg"][grams], ng)
    order = np.stack([inv, inv[::-1]])
    proj = np.stack([(x @ par["W"][k] + par["b"][k])[order[k]] for k in (0, 1)])
    mask = np.stack([inside, inside[::-1]])[..., None]
    logit, (states, memo, both, w, pooled) = forward(par, proj, True, mask)
    g_logit = ((_sigmoid(logit) - y) * weight / b).astype(kind)
    grad = {"o": pooled.T @ g_logit, "c": g_logit.sum(keepdims=True)}
    g_pool = g_logit[:, None] * par["o"][None]
    g_w = np.einsum("bd,tbd->tb", g_pool, both)
    g_s = w * (g_w - (w * g_w).sum(0))
    g_both = w[..., None] * g_pool[None] + g_s[..., None] * par["a"]
    grad["a"] = np.einsum("tb,tbd->d", g_s, both)
    g_states = np.stack([g_both[..., :HIDDEN], g_both[::-1, :, HIDDEN:]])
    g_proj = np.zeros_like(proj)
    grad["U"] = np.zeros_like(par["U"])
    g_h = np.zeros((2, b, HIDDEN), kind)
    ut = par["U"].transpose(0, 2, 1)
    for i in range(t - 1, -1, -1):
        h, z, r, un, n = memo[i]
        g = g_h + g_states[:, i]
        m = mask[:, i]
        g_new = np.where(m, g, 0)
        g_z = g_new * (h - n) * 2 * z * (1 - z)
        g_n = g_new * (1 - z) * (1 - n * n)
        g_r = g_n * un * 2 * r * (1 - r)
        g_u = np.concatenate([g_z, g_r, g_n * r], -1)
        g_proj[:, i] = np.concatenate([g_z, g_r, g_n], -1)
        grad["U"] += np.matmul(h.transpose(0, 2, 1), g_u)
        g_h = np.where(m, 0, g) + g_new * z + np.matmul(g_u, ut)
    grad["b"] = g_proj.sum((1, 2))
    g_x = np.zeros_like(x)
    grad["W"] = np.zeros_like(par["W"])
    for k in (0, 1):
        _, per = _sums(order[k].ravel(), g_proj[k].reshape(-1, 3 * HIDDEN))
        grad["W"][k] = x.T @ per
        g_x += per @ par["W"][k].T
    return grad, {"Ew": _sums(word[u], g_x[:, 3:3 + VEC]),
                  "Eg": _sums(grams, np.repeat(g_x[:, 3 + VEC:] / ng[:, None], ng, axis=0))}


def _learn(par, adam, step, *batch):
    """One Adam step on a batch of windows."""
    grad, tables = gradients(par, *batch)
    for k, g in grad.items():
        m1, m2 = adam[k]
        m1 += 0.1 * (g - m1)
        m2 += 0.001 * (g * g - m2)
        par[k] -= RATE * (m1 / (1 - 0.9 ** step)) / (np.sqrt(m2 / (1 - 0.999 ** step)) + 1e-8)
    # hash rows: plain steps on the rows of the batch
    for name, (rows, g) in tables.items():
        par[name][rows] -= RATE * 5 * g


def sample(docs: DataFrame, labels: DataFrame, learn: Column, per_class: int = PER_CLASS,
           id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, float]:
    """(t, y) of at most ``per_class`` labelled documents of each label, those
    with the smallest hash of the id, in one sorted partition; and the share
    of label 1 among all of them. A document of several rows gives one of its
    texts, not a blank one if it has another."""
    known = (labels.select(F.col("doc_id").alias(id_col), F.col("toxic").cast("int").alias("y"))
             .filter(F.col(id_col).isNotNull() & F.col("y").isin(0, 1) & learn)
             .groupBy(id_col).agg(F.max("y").alias("y")))
    n = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    share = n.get(1, 0) / max(1, sum(n.values()))
    place = [F.xxhash64(id_col), F.col(id_col)]
    first, second = (known.filter(F.col("y") == c).orderBy(*place).limit(per_class) for c in (0, 1))
    # one row an id, so at most 2 * per_class rows
    one = F.min_by("t", F.struct(F.trim("t") == "", F.xxhash64("t")))
    rows = (docs.select(F.col(id_col), F.col(text_col).alias("t")).filter(F.col("t").isNotNull())
            .join(F.broadcast(first.unionByName(second)), id_col).groupBy(id_col, "y").agg(one.alias("t")))
    return rows.repartition(1).sortWithinPartitions(*place).select("t", "y"), share


def score(docs: DataFrame, model: Model | None, text_col: str = "text", cut: float = CUT) -> DataFrame:
    """``docs`` without its text, with score and predicted."""
    names = [c for c in docs.columns if c not in (text_col, "score", "predicted")]
    return _scored(docs.select(*names, text_col), model, len(names), cut).select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], "score", "predicted")


def reject(docs: DataFrame, model: Model | None, text_col: str = "text", cut: float = CUT) -> DataFrame:
    """The rows of ``docs`` that aren't predicted toxic, columns unchanged."""
    kept = _scored(docs, model, docs.columns.index(text_col), cut).filter("predicted = 0")
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def _scored(docs: DataFrame, model: Model | None, text_at: int, cut: float) -> DataFrame:
    """Columns c0, c1, ... of ``docs``, score and predicted."""
    bc = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])

    def run(batches):
        m = bc.value
        for batch in batches:
            data, off = text_bytes(batch.column(text_at))
            p = score_of(m, text_logits(m, data, off)) if m is not None else np.zeros(len(off) - 1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(p), pa.array((p >= cut).astype(np.int32))],
                names=[*batch.schema.names, "score", "predicted"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return map_arrow(rows, run, f"{schema}, score double, predicted int")


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that nothing is learned from: crc32 of the id is 2 mod 4."""
    return F.coalesce(F.pmod(crc_of(F.col(id_col)), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", sample_bytes: int = SAMPLE_BYTES) -> Model | None:
    """Train on the labelled documents that aren't held out."""
    rows, share = sample(docs, labels, ~held_out(id_col), id_col=id_col)

    def learn(batches):
        texts, y, room = [], [], sample_bytes
        for batch in batches:
            for t, label in zip(batch.column(0), batch.column(1).to_pylist()):
                size = t.as_buffer().size
                if size <= room:
                    room -= size
                    texts.append(t.as_py())
                    y.append(label)
        if texts:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(texts, y, toxic_share=share))])], names=["m"])

    trained = map_arrow(rows, learn, "m binary").collect()
    return pickle.loads(trained[0]["m"]) if trained else None


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) of every document."""
    rows = docs.select(id_col, held_out(id_col).alias("held_out"), text_col)
    return score(rows, fit(docs, labels, id_col), text_col)
