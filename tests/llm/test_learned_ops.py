"""Language id, toxicity, neighbours, URL lists and near duplicates against
brute force or held-out rows, and their edge cases."""
import math
import os
import random
import subprocess
import sys
from datetime import date

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sinter.llm import langid, neardup, neighbours, toxicity, urlfilter
from sinter.llm.common import byte_slices, text_bytes


def words(rng, letters, n):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(2, 8))) for _ in range(n))


def test_byte_slices_cover_every_row():
    off = np.array([0, 5, 5, 30, 31, 31, 90])
    got = list(byte_slices(off, 20))
    assert [x for a, b in got for x in range(a, b)] == list(range(6))
    assert list(byte_slices(np.array([0]), 20)) == []


def ppm_bits(texts, order, text, min_count):
    """Code length of a text by plain dictionaries, one byte at a time."""
    seen = sorted({b for g in texts for t in texts[g] for b in t.encode()})
    sym = {b: i + 1 for i, b in enumerate(seen)}
    a = len(seen) + 1
    out = {}
    for g in texts:
        trees = [dict() for _ in range(order + 1)]
        for t in texts[g]:
            s = [0] * order + [sym[b] for b in t.encode()]
            for i in range(order, len(s)):
                for d in range(order + 1):
                    ctx = tuple(s[i - d:i])
                    c = trees[d].setdefault(ctx, {})
                    c[s[i]] = c.get(s[i], 0) + 1

        def p(ctx):
            if ctx is None:
                flat = [1 / 256] * a
                flat[0] = (257 - a) / 256
                return flat
            low = p(ctx[1:] if ctx else None)
            c = trees[len(ctx)].get(ctx)
            if c is None:
                return low
            total, kinds = sum(c.values()), len(c)
            rest = sum(low[x] for x in range(a) if x not in c)
            if rest <= 0:
                return [c.get(x, 0) / total for x in range(a)]
            return [c[x] / (total + kinds) if x in c else kinds / (total + kinds) * low[x] / rest for x in range(a)]

        s = [0] * order + [sym.get(b, 0) for b in text.encode()]
        bits = 0.0
        for i in range(order, len(s)):
            bits -= math.log2(p(tuple(s[i - order:i]))[s[i]])
            if s[i] == 0:
                bits += math.log2(max(1, 257 - a))
        out[g] = bits
    return out


def test_code_lengths_equal_a_plain_ppm():
    rng = random.Random(0)
    texts = {"a": [words(rng, "abcd", 30) for _ in range(4)], "b": [words(rng, "cdef", 30) for _ in range(4)]}
    # all contexts kept, so that the table holds every tree whole
    model = langid.train(texts, order=2, max_contexts=10**6, min_count=1)
    for t in ("abc dcb fef", "zz top é", "c", texts["a"][0]):
        data, off = text_bytes(pa.array([t]))
        want = ppm_bits(texts, 2, t, 1)
        assert langid.code_lengths(model, data, off)[0] == pytest.approx([want["a"], want["b"]], rel=1e-5)


def test_language_id(spark):
    rng = random.Random(1)
    sets = {"aa": "abcdefgh ", "bb": "ghijklmn", "cc": "éàüöß"}
    data = [(i, words(rng, sets[g], 40), g, 1) for i in range(240) for g in [("aa", "bb", "cc")[i % 3]]]
    data += [(900, None, "aa", 1), (901, "", "aa", 1), (902, "12 34 !!", "bb", 1), (None, "abc", "aa", 1),
             (903, "abcd efg", None, 1), (904, "é", None, 1), (905, "abc " * 40000, None, 1)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, score int")
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert len(got) == len(data)
    assert all(got[d[0]].lang_pred == d[2] for d in data[:240])
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and got[901].score == 0
    assert got[903].lang_pred == "aa" and got[904].lang_pred == "cc" and got[905].lang_pred == "aa"
    assert all(0 <= r.score <= 1 for r in got.values()) and not got[None].held_out
    nothing = langid.identify(docs.selectExpr("doc_id", "text", "CAST(NULL AS string) AS lang"))
    assert {r.lang_pred for r in nothing.collect()} == {"und"}
    assert langid.identify(docs.limit(0)).count() == 0


def tox_data(n, seed):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 8))) for _ in range(400)]
    data = []
    for i in range(n):
        w = [rng.choice(vocab) for _ in range(rng.randrange(5, 300))]
        y = int(i % 4 == 0)
        if y:
            w[rng.randrange(len(w))] = "zorko" + rng.choice(["", "la", "mi", "tu", "ns"])
        data.append((i, " ".join(w), y))
    return data


def test_padding_leaves_the_logit():
    rng = np.random.default_rng(0)
    h, t, b = toxicity.HIDDEN, 5, 3
    par = {"U": rng.normal(0, .3, (2, h, 3 * h)), "a": rng.normal(0, .3, 2 * h), "o": rng.normal(0, .3, 2 * h),
           "c": np.zeros(1)}
    proj = rng.normal(0, .5, (2, t, b, 3 * h))
    logit = toxicity.forward(par, proj)
    assert logit.shape == (b,)
    # padding leaves the logit of the shorter window unchanged
    pad = np.concatenate([proj, proj[:, :2]], 1)
    pad[1] = np.concatenate([proj[1, :2], proj[1]], 0)
    inside = np.ones((2, t + 2, b, 1), bool)
    inside[0, t:], inside[1, :2] = False, False
    assert np.allclose(toxicity.forward(par, pad, False, inside), logit, atol=1e-12)


def test_gradients_are_those_of_the_loss():
    """Every weight and every hash row in use, against central differences
    of the loss, in double precision, with windows of unequal length."""
    rng = np.random.default_rng(1)
    h, v = toxicity.HIDDEN, toxicity.VEC
    spelt = pa.array(["zorko", "a", "bcd", "naïve", "longer"], pa.large_string())
    word, gram, n_gram = toxicity._hashes(spelt)
    g0 = np.cumsum(n_gram) - n_gram
    index = np.array([0, 1, 2, 3, 4, 1, 1, 0, 2])
    first, size = np.array([0, 3, 5, 8]), np.array([4, 3, 4, 1])
    y, side = np.array([1.0, 0, 1, 0]), np.array([0, 1, 0, 1])
    weight = np.array([0.7, 1.3, 0.7, 1.3])
    odds = [rng.normal(0, 1, toxicity.WORD_ROWS) for _ in (0, 1)], [rng.normal(0, 1, toxicity.GRAM_ROWS) for _ in (0, 1)]
    par = {"Ew": rng.normal(0, .3, (toxicity.WORD_ROWS, v)), "Eg": rng.normal(0, .3, (toxicity.GRAM_ROWS, v)),
           "W": rng.normal(0, .3, (2, 3 + 2 * v, 3 * h)), "U": rng.normal(0, .3, (2, h, 3 * h)),
           "b": rng.normal(0, .3, (2, 3 * h)), "a": rng.normal(0, .3, 2 * h), "o": rng.normal(0, .3, 2 * h),
           "c": rng.normal(0, .3, 1)}

    def loss():
        total = 0.0
        for i in range(len(first)):
            at = index[first[i]:first[i] + size[i]]
            grams = [gram[g0[w]:g0[w] + n_gram[w]] for w in at]
            x = np.array([np.concatenate([
                [odds[0][side[i]][word[w]], odds[1][side[i]][g].max(), odds[1][side[i]][g].mean()],
                par["Ew"][word[w]], par["Eg"][g].mean(0)]) for w, g in zip(at, grams)])
            proj = np.stack([(z @ par["W"][k] + par["b"][k])[:, None] for k, z in ((0, x), (1, x[::-1]))])
            p = 1 / (1 + np.exp(-toxicity.forward(par, proj)[0]))
            total -= weight[i] * np.log(p if y[i] else 1 - p)
        return total / len(first)

    grad, rows = toxicity.gradients(par, *odds, word, gram, n_gram, g0, index, first, size, y, side, weight)
    for name, (at, g) in rows.items():
        grad[name] = np.zeros_like(par[name])
        grad[name][at] = g
    assert set(grad) == set(par)
    step = 1e-5
    for name, g in grad.items():
        used = np.unique(rows[name][0]) if name in rows else None
        cells = [(int(r), j) for r in used for j in range(v)] if used is not None else list(np.ndindex(g.shape))
        for c in rng.permutation(len(cells))[:60]:
            keep = par[name][cells[c]]
            par[name][cells[c]] = keep + step
            up = loss()
            par[name][cells[c]] = keep - step
            down = loss()
            par[name][cells[c]] = keep
            assert abs((up - down) / (2 * step) - g[cells[c]]) < 1e-7, (name, cells[c])


def test_training_does_not_depend_on_the_process():
    code = ("import sys; sys.path.insert(0, sys.argv[1]); sys.path.insert(0, sys.argv[2]); import test_learned_ops as t, zlib;"
            "d = t.tox_data(120, 2); m = t.toxicity.train([x[1] for x in d], [x[2] for x in d], epochs=2);"
            "print(zlib.crc32(b''.join(m.par[k].tobytes() for k in sorted(m.par))), m.scale, m.shift)")
    here = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(os.path.dirname(here))
    said = {subprocess.run([sys.executable, "-c", code, root, here], env={**os.environ, "PYTHONHASHSEED": seed},
                           capture_output=True, text=True, check=True, timeout=300).stdout for seed in ("1", "2")}
    assert len(said) == 1


def test_sample_is_bounded_in_bytes_and_ids_may_be_text(spark):
    data = tox_data(300, 9)
    docs = spark.createDataFrame([(f"d{i}", t) for i, t, _ in data] + [("dx", "zorkola " * 400_000)], "doc_id string, text string")
    labels = spark.createDataFrame([(f"d{i}", y) for i, _, y in data] + [("dx", 1)], "doc_id string, toxic int")
    model = toxicity.fit(docs, labels, sample_bytes=1 << 20)
    assert model is not None
    got = toxicity.score(docs, model).collect()
    assert len(got) == 301 and all(0 <= r.score <= 1 for r in got)
    assert toxicity.fit(docs, labels, sample_bytes=10) is None


def test_windows_cover_every_word():
    n = np.array([0, 1, 31, 32, 33, 200])
    text, start = toxicity._windows(n)
    for i, k in enumerate(n):
        s = start[text == i]
        covered = set()
        for x in s:
            covered |= set(range(x, min(k, x + toxicity.WINDOW)))
        assert covered == set(range(k))
        assert (np.diff(s) <= toxicity.STRIDE).all()


def test_toxicity_learns_and_generalises(spark):
    data = tox_data(800, 5)
    docs = spark.createDataFrame([(d[0], d[1], 1) for d in data] + [(5000, None, 1), (5001, "", 1), (5002, "12 !", 1),
                                                                    (None, "zorkola", 1), (5003, "ab " * 30000 + "zorkomi", 1)],
                                 "doc_id long, text string, score int")
    labels = spark.createDataFrame([(d[0], d[2]) for d in data] + [(None, 1), (0, None), (1, 0)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.classify(docs, labels).collect()}
    held = [d for d in data if got[d[0]].held_out]
    right = [got[d[0]].predicted == d[2] for d in held]
    assert len(held) > 100 and sum(right) / len(right) > 0.9
    assert got[5000].predicted == got[5001].predicted == got[5002].predicted == 0
    assert got[5003].predicted == 1 and 0 <= got[None].score <= 1
    none = toxicity.classify(docs, labels.filter("toxic = 0"))
    assert {r.score for r in none.limit(5).collect()} == {0.0}
    model = toxicity.fit(docs, labels)
    kept = toxicity.reject(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.predicted == 0}
    assert toxicity.classify(docs.limit(0), labels).count() == 0


def test_a_repeated_document_leaves_room_for_the_others(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(40)]
                                 + [(i, f"text {i} again {k}") for i in (3, 4, 5, 6) for k in range(500)]
                                 + [(7, " "), (8, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(40)], "doc_id long, toxic int")
    rows, share = toxicity.sample(docs.repartition(4), labels, F.lit(True), per_class=20)
    texts, y = zip(*rows.collect())
    assert sorted(int(t.split()[1]) for t in texts) == list(range(40))
    assert [int(t.split()[1]) % 2 for t in texts] == list(y) and share == 0.5


def vectors(spark, n, dim, seed, extra=()):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)).astype(np.float32)
    x[n // 3: n // 2] = x[0]  # a very common vector
    rows = [(i, [float(v) for v in x[i]], 1) for i in range(n)] + list(extra)
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")


def test_neighbours(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(5000, None, 1), (5020, [0.0] * 16, 1), (5040, [nan] + [1.0] * 15, 1), (5060, [None] + [1.0] * 15, 1),
           (5080, [inf] + [1.0] * 15, 1), (5100, [1.0] * 7, 1), (None, [1.0] * 16, 1)]
    df = vectors(spark, 1500, 16, 1, odd)
    got = {}
    for r in neighbours.nearest(df).collect():
        got.setdefault(r.query_id, []).append(r)
    rows = [(r.vec_id, r.embedding) for r in df.collect() if r.vec_id is not None and r.vec_id < 5000]
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    assert set(got) == {i for i in ids if i % 20 == 0}
    hit = 0
    for q in got:
        s = x @ x[ids == q][0]
        s[ids == q] = -np.inf
        best = ids[np.lexsort((ids, -s))[:20]]
        mine = sorted(got[q], key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 21))
        assert all((a.score, -a.vec_id) >= (b.score, -b.vec_id) for a, b in zip(mine, mine[1:]))
        assert all(r.score == pytest.approx(s[ids == r.vec_id][0], rel=1e-12) for r in mine)
        hit += len(set(best) & {r.vec_id for r in mine})
    assert hit / (20 * len(got)) >= 0.9
    assert neighbours.nearest(df.limit(0)).count() == 0
    few = neighbours.nearest(df.filter("vec_id IN (0, 20, 7)")).collect()
    assert sorted((r.query_id, r["rank"]) for r in few) == [(0, 1), (0, 2), (20, 1), (20, 2)]


def test_recall_on_the_given_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = df.collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
    hit = n = 0
    for r in neighbours.nearest(df).groupBy("query_id").agg({"vec_id": "collect_list"}).collect():
        s = x @ x[ids == r.query_id][0]
        s[ids == r.query_id] = -np.inf
        hit += len(set(ids[np.lexsort((ids, -s))[:20]]) & set(r[1]))
        n += 20
    assert hit / n >= 0.9


def test_url_lists(spark):
    d = date
    entries = spark.createDataFrame([
        ("bad.org", d(2024, 1, 10), "block"), ("bad.org", d(2024, 2, 1), "remove"), ("bad.org", d(2024, 3, 1), "block"),
        ("ok.bad.org", d(2024, 1, 15), "allow"), ("tie.com", d(2024, 1, 1), "allow"), ("tie.com", d(2024, 1, 1), "block"),
        (None, d(2024, 1, 1), "block"), ("x.com", None, "block")], "pattern string, day date, action string")
    cases = [("http://bad.org/a", d(2024, 1, 9), False), ("http://bad.org/a", d(2024, 1, 10), True),
             ("http://u@WWW.Bad.org:80/a", d(2024, 1, 31), True), ("http://bad.org", d(2024, 2, 1), False),
             ("http://bad.org", d(2024, 5, 1), True), ("https://ok.bad.org/", d(2024, 1, 14), True),
             ("https://ok.bad.org/", d(2024, 1, 16), False), ("https://a.ok.bad.org/", d(2024, 3, 16), False),
             ("https://notbad.org/", d(2024, 3, 16), False), ("ftp://tie.com", d(2024, 1, 1), True),
             (None, d(2024, 3, 1), False), ("no url", d(2024, 3, 1), False), ("http://bad.org", None, False),
             ("http://x.com/", d(2025, 1, 1), False), ("http://bad.org", d(2024, 5, 1), True)]
    captures = spark.createDataFrame([(i, u, t, "mine") for i, (u, t, _) in enumerate(cases)],
                                     "page_id long, url string, fetch_day date, pattern string")
    got = {r.page_id: r.blocked for r in urlfilter.judge(captures, entries).collect()}
    assert got == {i: c[2] for i, c in enumerate(cases)}
    assert urlfilter.judge(captures.limit(0), entries).count() == 0
    # hosts of very many labels aren't hosts; a URL may be as long as it likes
    long = spark.createDataFrame([(1, "http://" + "a." * 20_000 + "example", date(2024, 3, 1)),
                                  (2, "http://" + "a." * 123 + "example/" + "p" * 300_000, date(2024, 3, 1))],
                                 "page_id long, url string, fetch_day date")
    hosts = {r.page_id: r.host for r in urlfilter.judge(long, entries).select("page_id", "host").collect()}
    assert hosts[1] is None and len(hosts[2]) == 253
    assert urlfilter.judge(captures, entries.limit(0)).filter("blocked").count() == 0


def brute_classes(texts, threshold):
    data, off = text_bytes(pa.array([t or "" for t in texts], pa.large_string()))
    h, times, per = neardup.shingles(data, off)
    end = np.cumsum(per)
    df = np.bincount(neardup.bucket_of(h), minlength=1 << neardup.DF_BITS)
    idf = np.exp(neardup.log_idf(df, int((per > 0).sum())).astype(float))
    w = [dict(zip(h[e - k:e].tolist(), idf[neardup.bucket_of(h[e - k:e])] * times[e - k:e])) for e, k in zip(end, per)]
    label = list(range(len(texts)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            low = sum(min(v, w[j].get(x, 0)) for x, v in w[i].items())
            high = sum(w[i].values()) + sum(w[j].values()) - low
            if low and low / high >= threshold - 1e-9:
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def test_near_duplicates(spark):
    rng = random.Random(7)
    texts = []
    for _ in range(12):
        base = words(rng, "abcdefgh", 120).split()
        for k in range(6):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, 4, 12])):
                copy[rng.randrange(len(copy))] = words(rng, "xyz", 1)
            texts.append(" ".join(copy))
    passage = words(rng, "mnop", 60)
    texts += [words(rng, "abcd", 40) + " " + passage + " " + words(rng, "abcd", 40) for _ in range(30)]
    texts += [None, "", "  \n ", "", "one two", "one two", "one", "a " * 30000, "a " * 30000]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, class_size int")
    got = {r.doc_id: r for r in neardup.near_duplicates(docs.repartition(4)).collect()}
    assert {i: r.class_id for i, r in got.items()} == dict(enumerate(brute_classes(texts, 0.8)))
    kept = neardup.keep_first(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.class_id for r in got.values()}
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


def test_near_duplicates_of_repeated_rows_and_null_ids(spark):
    rng = random.Random(8)
    t, u = words(rng, "abcdef", 50), words(rng, "ghijk", 50)
    docs = spark.createDataFrame([(5, t), (5, t), (3, t), (None, t), (None, u), (None, u), (None, None), (4, "")],
                                 "doc_id long, text string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.class_id or -1, r.class_size) for r in
                 neardup.near_duplicates(docs).collect())
    assert got == [(False, 3, 3, 4), (False, 4, 4, 1), (False, 5, 3, 4), (False, 5, 3, 4),
                   (True, 0, -1, 1), (True, 0, -1, 2), (True, 0, -1, 2), (True, 0, 3, 4)]
    kept = sorted((r.doc_id or 0, r.text or "") for r in neardup.keep_first(docs).collect())
    assert kept == sorted([(0, ""), (0, u), (3, t), (4, "")])


def test_samples_agree_as_often_as_sets_are_alike():
    rng = np.random.default_rng(3)
    a = np.sort(rng.choice(1 << 32, 600, False).astype(np.uint64))
    for same in (0.9, 0.6):
        n = int(600 * 2 * same / (1 + same))
        hits = []
        for _ in range(30):
            keep = rng.choice(a, n, False)
            b = np.sort(np.append(keep, rng.choice(1 << 32, 600 - n, False).astype(np.uint64)))
            w = np.zeros(1200, np.float32)
            s = neardup.samples(np.append(a, b), w, np.array([600, 600]))
            hits.append((s[0] == s[1]).mean())
        assert abs(np.mean(hits) - n / (1200 - n)) < 0.05


def test_buckets_larger_than_a_part_stay_linked(spark, monkeypatch):
    monkeypatch.setattr(neardup, "HEAVY", 8)
    rng = random.Random(9)
    base = words(rng, "abcdefgh", 200).split()
    texts = []
    for _ in range(60):
        copy = list(base)
        copy[rng.randrange(len(copy))] = words(rng, "xyz", 1)
        texts.append(" ".join(copy))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.class_id for r in neardup.near_duplicates(docs).collect()} == {0}


def matrix_classes(texts, threshold):
    """As ``brute_classes``, for texts that repeat no shingle."""
    data, off = text_bytes(pa.array(texts, pa.large_string()))
    h, times, per = neardup.shingles(data, off)
    assert (times == 1).all() and (per > 0).all()
    bucket = neardup.bucket_of(h)
    idf = np.exp(neardup.log_idf(np.bincount(bucket, minlength=1 << neardup.DF_BITS), len(texts)).astype(float))
    vocab, at = np.unique(h, return_inverse=True)
    x = np.zeros((len(texts), len(vocab)))
    x[np.repeat(np.arange(len(texts)), per), at] = np.sqrt(idf[bucket])
    low = x @ x.T
    total = np.diag(low)
    alike = low / (total[:, None] + total[None, :] - low)
    label = np.arange(len(texts))
    while True:
        new = np.where(alike >= threshold, label[None, :], len(texts)).min(1)
        if (new == label).all():
            return alike, label.tolist()
        label = new


def family(rng, letters, n, twins):
    """Texts that share a passage, about 0.7 alike; the first ``twins`` of
    them have one more text each that is over 0.8 alike."""
    def word(k):
        return "".join(rng.choice(k) for _ in range(9))

    passage = " ".join(word(letters) for _ in range(70))
    own = [[word("abcdefgh") for _ in range(9)] for _ in range(n)]
    pairs = [o[:2] + [word("xyz")] + o[3:] for o in own[:twins]]
    return [passage + " " + " ".join(o) for o in own + pairs]


def test_twins_in_a_family_with_a_passage(spark):
    n, twins = 1500, 100
    texts = family(random.Random(10), "mnop", n, twins)
    alike, expected = matrix_classes(texts, 0.8)
    assert expected == [i if i < n else i - n for i in range(n + twins)]
    assert 0.65 < np.median(alike) < 0.77
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(docs.repartition(4)).collect()}
    assert got == dict(enumerate(expected))


def test_split_buckets_lose_no_pair(spark, monkeypatch):
    rng = random.Random(12)
    one = family(rng, "mnop", 150, 30)
    # a second family round the same passage, whose classes are paths, not stars
    passage, paths = one[0].split()[:70], []
    for c in range(6):
        copy = passage + words(rng, "qrstuv", 14).split()
        for k in range(6):
            copy = list(copy)
            copy[71 + 2 * k] = words(rng, "wxyz", 1) + f"z{c}z{k}"
            paths.append(" ".join(copy))
    texts = one + paths
    _, expected = matrix_classes(texts, 0.8)
    assert 150 < len(set(expected)) < 160
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for heavy, part in ((8, 16), (4096, 40)):
        monkeypatch.setattr(neardup, "HEAVY", heavy)
        monkeypatch.setattr(neardup, "PART", part, raising=False)
        got = {r.doc_id: r.class_id for r in neardup.near_duplicates(docs).collect()}
        assert got == dict(enumerate(expected)), (heavy, part)


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.node: r.label for r in neardup.components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
