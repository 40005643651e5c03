"""Whitening, collocations and SimHash against brute force, and their edge
cases."""
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from sinter.llm import phrases, simhash, whitening
from sinter.llm.common import table

DATA = {"sf0.001": "/root/testdata/sf0.001"}

# ------------------------------------------------------------ whitening
NAN, INF = float("nan"), float("inf")


def matrices():
    rng = np.random.default_rng(3)
    yield np.cov(rng.standard_normal((40, 300)))
    yield np.eye(20)
    yield np.diag([3.0, 3, 3, 1, 1, 0, 0, 0])
    yield np.kron(np.eye(8), np.array([[2.0, 1], [1, 2]]))
    yield np.kron(np.eye(5), np.cov(rng.standard_normal((6, 50))))
    yield np.full((7, 7), 1.0) + np.eye(7)
    yield np.diag(1.0 + 1e-9 * np.arange(12))
    yield np.array([[2.5]])
    yield np.zeros((3, 3))
    x = rng.standard_normal((200, 30)) * np.logspace(0, -4, 30)
    yield x.T @ x


@pytest.mark.parametrize("a", list(matrices()))
def test_leading_eigenvectors(a):
    k = min(16, len(a))
    e, v = whitening.eigen(a, k)
    want = np.linalg.eigvalsh(a)[::-1][:k]
    scale = max(np.abs(a).max(), 1e-300)
    assert np.abs(e - want).max() <= 1e-13 * len(a) * scale
    assert np.abs(a @ v - v * e).max() <= 1e-13 * len(a) * scale
    assert np.abs(v.T @ v - np.eye(k)).max() <= 1e-12


def test_sturm_counts():
    rng = np.random.default_rng(5)
    d, e = rng.standard_normal(30), rng.standard_normal(29)
    values = np.linalg.eigvalsh(np.diag(d) + np.diag(e, 1) + np.diag(e, -1))
    x = np.linspace(-4, 4, 57)
    assert (whitening.count_below(d, e, x) == (values[None, :] < x[:, None]).sum(1)).all()


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "c") for i, v in rows], "vec_id long, embedding array<float>, n string")


def by_brute_force(rows, k=16):
    rows = [(i, np.array(v, np.float64)) for i, v in rows]
    x = np.floor(64 * np.stack([v for _, v in rows])).astype(np.int64) + 1_000_000
    u = np.unique(x, axis=0)
    n, s = len(u), u.sum(0)
    y = u - s / n
    cov = y.T @ y / n
    e = np.linalg.eigvalsh(cov)[::-1][:k]
    dev = [int(sum((n * int(c) - int(t)) ** 2 for c, t in zip(r, s))) for r in x]
    return n, dict(zip([i for i, _ in rows], dev)), e / np.trace(cov), x, u


def test_whitening_equals_brute_force(spark):
    rng = np.random.default_rng(8)
    good = [(i, rng.standard_normal(20).astype(np.float32).tolist()) for i in range(300)]
    good += [(1000, good[0][1]), (1001, good[0][1]), (1000, good[1][1])]
    bad = [(2000, None), (2001, []), (2002, [NAN] * 20), (2003, [INF] + [0.0] * 19), (2004, [None] + [1.0] * 19),
           (2005, [1.0, 2.0])]
    got = whitening.whitened(vectors(spark, good + bad)).toPandas()
    n, dev, explained, x, u = by_brute_force(good)
    assert sorted(got.vec_id) == sorted(i for i, _ in good for _ in range(16))
    assert set(got.n) == {n} and n == 300
    first = got[got.vec_id == 5].sort_values("component")
    assert first.component.tolist() == list(range(1, 17))
    assert set(first.deviation) == {dev[5]}
    assert np.allclose(first.explained, explained, rtol=1e-10)
    assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-10
    # the fit list is white, and projections of equal vectors are equal
    w = got[got.vec_id < 1000].pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.abs(w.T @ w / n - np.eye(16)).max() < 1e-10
    same = got[got.vec_id == 1001].sort_values("component").whitened.to_numpy()
    assert np.allclose(same, got[got.vec_id == 0].sort_values("component").whitened, atol=1e-12)


def test_whitening_of_the_given_vectors(spark):
    d = DATA["sf0.001"]
    got = whitening.whitened(table(spark, d, "embeddings")).toPandas()
    rows = [(r.vec_id, r.embedding) for r in table(spark, d, "embeddings").collect()]
    n, dev, explained, x, u = by_brute_force(rows)
    assert (got.deviation == got.vec_id.map(dev)).all() and set(got.n) == {n}
    assert np.allclose(got.explained, explained[got.component - 1], rtol=1e-9)
    y = u - u.sum(0) / n
    _, v = np.linalg.eigh(y.T @ y / n)
    w = got.sort_values(["vec_id", "component"]).whitened.to_numpy().reshape(len(rows), -1)
    xs = x[np.argsort([i for i, _ in rows])] - u.sum(0) / n
    want = xs @ v[:, ::-1][:, :16]
    want /= np.sqrt((y @ v[:, ::-1][:, :16]).var(0))
    sign = np.sign((w * want).sum(0))
    assert np.abs(w - want * sign).max() < 1e-8


def test_whitening_edges(spark):
    empty = whitening.whitened(vectors(spark, []))
    assert empty.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert empty.count() == 0
    assert whitening.whitened(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (None, [1.0, 2.0])])).count() == 0
    # rank one: one component; a null id stays
    line = whitening.whitened(vectors(spark, [(1, [0.0, 0.0]), (2, [1.0, 2.0]), (None, [2.0, 4.0])])).collect()
    assert sorted(((r.vec_id or 0), r.component) for r in line) == [(0, 1), (1, 1), (2, 1)]
    assert np.allclose([r.explained for r in line], 1.0)
    # entries that exceed 64 bits in the sums stay exact or become null
    wide = spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 2.0])],
                                 "vec_id string, embedding array<double>")
    got = whitening.whitened(wide).collect()
    assert {r.vec_id for r in got} == {"1", "2", "3"}
    assert {r.deviation for r in got if r.vec_id == "1"} == {None}


# ------------------------------------------------------------ collocations
def count_by_brute_force(rows, most=5):
    f, n = Counter(), Counter()
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(low)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, most + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i:i + k])] += 1
    return f, n


def phrases_by_brute_force(rows, threshold, limit):
    f, n = count_by_brute_force(rows)
    out = []
    often = {k: a for k, a in f.items() if a >= threshold and len(k[1]) > 1}
    inside = {}
    for (lang, w), a in often.items():
        for size in range(2, len(w)):
            for i in range(len(w) - size + 1):
                inside.setdefault((lang, w[i:i + size]), []).append(a)
    for (lang, w), a in often.items():
        if any(b >= a for b in inside.get((lang, w), ())):
            continue
        cuts = []
        for k in range(1, len(w)):
            left, right = f[lang, w[:k]], f[lang, w[k:]]
            cuts.append((1000 * a * n[lang] // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        out.append((lang, -score, -a, " ".join(w).encode(), left, right))
    got, rank = [], Counter()
    for lang, s, a, p, left, right in sorted(out):
        rank[lang] += 1
        if rank[lang] <= limit:
            got.append((lang, rank[lang], p.decode(), -a, left, right, n[lang], -s))
    return got


def corpus():
    rng = random.Random(4)
    vocab = ["a", "The", "of", "x|y", "naïve", "ÉTÉ", "日本", "w w", "and", "so"] + [f"v{i}" for i in range(40)]
    rows = [(None, None), ("en", ""), (None, "   "), ("und", "a of a of, a of"), ("en", ".,;:!?\n\r\x0b\x0c")]
    for _ in range(250):
        lang = rng.choice(["en", "en", "de", None, "und", ""])
        words = [rng.choice(vocab[:8] if rng.random() < 0.6 else vocab) for _ in range(rng.randrange(60))]
        if rng.random() < 0.4:
            words[3:3] = "new york stock exchange today".split()
        if rng.random() < 0.3:
            words[1:1] = "the united states".split()
        rows.append((lang, "".join(w + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\r\n"]) for w in words)))
    rows += [("en", "so so so so so so so so")] * 6
    rows.append(("fr", "long words " * 30_000))
    return rows


@pytest.mark.parametrize("threshold,limit", [(3, 2000), (6, 7)])
def test_collocations_equal_brute_force(spark, threshold, limit):
    rows = corpus()
    docs = spark.createDataFrame([(lang, t, 1, "k") for lang, t in rows], "lang string, text string, n int, phrase string")
    got = phrases.collocations(docs.repartition(5), threshold, limit)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == sorted(phrases_by_brute_force(rows, threshold, limit))


def test_chunks_change_nothing(monkeypatch):
    rows = corpus()
    texts = pa.array([t for _, t in rows[:-1]], pa.string())

    def all_grams():
        out = Counter()
        for words in phrases.chunks(texts):
            for k, at, h in phrases.grams(words, np.zeros(len(words), np.uint64)):
                out.update(zip([k] * len(h), h.tolist()))
        return out

    whole = all_grams()
    f, _ = count_by_brute_force([("x", t) for _, t in rows[:-1]])
    assert sorted(whole.values()) == sorted(f.values())
    monkeypatch.setattr(phrases, "CHUNK", 40)
    assert all_grams() == whole


@pytest.mark.parametrize("seed", range(4))
def test_summaries_keep_every_frequent_hash(seed):
    rng = np.random.default_rng(seed)
    stream = rng.zipf(1.3, 60_000).astype(np.uint64) % (1 << 32)
    threshold = 50
    s = phrases.Summary(4 * len(stream) // threshold + 1)
    tight = phrases.Summary(len(stream) // threshold + 1)
    for part in np.array_split(stream, 37):
        h, n = np.unique(part.astype(np.uint32), return_counts=True)
        h, n = phrases.unpack_counts(phrases.pack_counts(h, n), len(h))
        for x in (s, tight):
            x.add(h, n)
            x.merge()
    exact = Counter(stream.astype(np.uint32).tolist())
    often = {h for h, n in exact.items() if n >= threshold}
    for x in (s, tight):
        assert often <= set(x.survivors(threshold).tolist())
        assert len(x.hash) <= x.capacity
        assert x.error * (x.capacity + 1) <= len(stream)
    assert tight.error > 0
    least = {h for h, n in exact.items() if n >= threshold - s.error}
    assert set(s.survivors(threshold).tolist()) <= least


def test_leading_of_salted_groups(spark):
    rows = [("en", f"p{i}", 5 + i % 3, 1, 1, 9, i % 50) for i in range(3000)] + [("de", "q", 5, 1, 1, 9, 1)]
    df = spark.createDataFrame(rows, "lang string, phrase string, a long, l long, r long, n long, score long")
    assert sorted(phrases.leading(df, 20, 100).collect()) == sorted(phrases.leading(df, 20, 10**6).collect())


def test_collocations_of_nothing(spark):
    docs = spark.createDataFrame([], "lang string, text string")
    assert phrases.collocations(docs).count() == 0
    few = spark.createDataFrame([("en", None), (None, "a b")], "lang string, text string")
    assert phrases.collocations(few).count() == 0


# ------------------------------------------------------------ simhash
def fingerprint(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes_by_brute_force(fps):
    """Smallest index reachable over pairs of two or fewer differing bits."""
    f = np.array(fps, np.uint64)
    close = np.bitwise_count(f[:, None] ^ f[None, :]) <= 2
    label = np.arange(len(f))
    while True:
        new = np.array([label[c].min() for c in close])
        if (new == label).all():
            return label.tolist()
        label = new


def test_fingerprints(spark, monkeypatch):
    texts = ["", None, " \t\n", "one", "One two", "one two three", "a b c d", "é É x\x0by z", "  lead  and tail \n",
             "日本 語 です よ", "w w x y", "same word " * 400, "x" * 5000 + " y z"]
    docs = spark.createDataFrame([(i, t, "f") for i, t in enumerate(texts)], "doc_id long, text string, fingerprint string")
    got = {r.doc_id: r.fingerprint for r in simhash.near_duplicates(docs).collect()}
    assert got == {i: f"{fingerprint(t):016x}" for i, t in enumerate(texts)}
    long = ("some words of a text " * 300).encode()
    monkeypatch.setattr(simhash, "CHUNK", 50)
    monkeypatch.setattr(simhash, "FLUSH", 7)
    assert simhash.fingerprints([long, b"a b", long]).tolist() == [fingerprint(long.decode())] * 1 + [
        fingerprint("a b"), fingerprint(long.decode())]


def test_spark_hash_is_the_same(spark):
    got = spark.sql("SELECT xxhash64('a b c') AS h").first().h
    assert got % (1 << 64) == xxhash.xxh64_intdigest(b"a b c", 42)


def planted(rng, families=12):
    out = set(int(x) for x in rng.integers(0, 1 << 64, 300, dtype=np.uint64))
    for _ in range(families):
        base = int(rng.integers(0, 1 << 64, dtype=np.uint64))
        for _ in range(40):
            x = base
            for b in rng.integers(0, 64, int(rng.integers(0, 6))):
                x ^= 1 << int(b)
            out.add(x)
    return sorted(out) + [0, 3, (1 << 64) - 1]


@pytest.mark.parametrize("crowd", [1024, 5, 2])
def test_links_join_what_is_close(spark, crowd):
    fps = list(dict.fromkeys(planted(np.random.default_rng(crowd))))
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    links = simhash.links(df, crowd).collect()
    at = {x: i for i, x in enumerate(signed)}
    group = list(range(len(fps)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for r in links:
        a, b = at[r.a], at[r.b]
        assert (fps[a] ^ fps[b]).bit_count() <= 2
        group[max(root(a), root(b))] = min(root(a), root(b))
    assert [root(i) for i in range(len(fps))] == classes_by_brute_force(fps)


def test_crowd_of_thousands(spark):
    """Thousands of fingerprints within one ball: a crowd under most keys."""
    base = 0x0123456789ABCDEF
    ball = [base] + [base ^ (1 << i) for i in range(64)] + [base ^ (1 << i) ^ (1 << j) for i in range(64) for j in range(i)]
    far = [base ^ 0xFF, base ^ 0xFFFF, base ^ 0xFF ^ (1 << 40)]
    signed = [x - (1 << 64) if x >> 63 else x for x in ball + far]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    from sinter.llm.neardup import components
    labels = {r.node: r.label for r in components(simhash.links(df)).collect()}
    assert len({labels[x] for x in signed[:len(ball)]}) == 1
    assert labels[signed[-3]] == labels[signed[-1]] != labels[signed[0]]
    assert signed[-2] not in labels


def test_components_of_documents(spark):
    d = DATA["sf0.001"]
    docs = table(spark, d, "documents").select("doc_id", "text").limit(200)
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    extra = [(10**6 + i, t) for i, (_, t) in enumerate(rows[:30])] + [(10**7, None), (10**7 + 1, ""), (None, None)]
    both = docs.withColumn("lang", F.lit("x")).unionByName(spark.createDataFrame([(i, t, "x") for i, t in extra], "doc_id long, text string, lang string"))
    got = simhash.near_duplicates(both).collect()
    rows += extra
    label = classes_by_brute_force([fingerprint(t) for _, t in rows])
    want = sorted((i if i is not None else -1, rows[c][0]) for (i, _), c in zip(rows, label))
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.component_id) for r in got) == want


def test_simhash_of_nothing(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    only = simhash.near_duplicates(spark.createDataFrame([(None, None), (None, "a")], "doc_id long, text string")).collect()
    assert [r.component_id for r in only] == [None, None]
