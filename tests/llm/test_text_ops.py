"""Token files, packing, chat formatting, mixing and quality rules against
brute force, and their edge cases."""
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from sinter.llm import chat, mixing, packing, quality, tokenfile
from sinter.llm.tokens import Encoder, default_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = ["", None, " \n\t ", "a  b  c\n\n d", "x'stop don't  \n", "tail<|endoftext|>", " é“, x,.!? 12a",
       "\n\nfoo\tbar  ", "日本 語。a", "a 　 b", "I'll we've'S", "tab\t\tx \r\n y", "wörter" * 3000,
       "the same text", "the same text", "😀 😀  ok"]


def rows(spark, texts, lang="en", source="s"):
    return spark.createDataFrame([(i, t, lang, source, 1, "x") for i, t in enumerate(texts)],
                                 "doc_id long, text string, lang string, source string, n_chars long, score string")


@pytest.fixture(scope="module")
def bpe():
    tok = Encoder(default_path()).tok
    return lambda t: tok.encode(t or "", add_special_tokens=False).ids + [0]


def test_ids_equal_the_librarys(bpe):
    import pyarrow as pa
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice(" \n\t.,'ab1éÉ #-Z") for _ in range(rng.randrange(60))) for _ in range(600)]
    enc = Encoder(default_path())
    ids, n = enc.encode(pa.array(texts, pa.string()))
    end = np.cumsum(n)
    for t, e, k in zip(texts, end, n):
        assert ids[e - k:e].tolist() == bpe(t)[:-1], t


def test_block_round_trip():
    rng = np.random.default_rng(0)
    for top in (2, 300, 70_000, 1 << 25):
        lengths = rng.integers(0, 50, 40)
        ids = rng.integers(0, top, lengths.sum()).astype(np.uint32)
        named = pa.array([None if i % 3 == 1 else -i for i in range(len(lengths))], pa.int64())
        back, n, docs = tokenfile.unpack_block(tokenfile.pack_block(ids, lengths, named))
        assert docs.equals(named)
        assert (back == ids).all() and (n == lengths).all()
    back, n, _ = tokenfile.unpack_block(tokenfile.pack_block(np.zeros(0, np.uint32), np.zeros(2, np.int64), pa.array([1, 2])))
    assert len(back) == 0 and n.tolist() == [0, 0]
    with pytest.raises(ValueError):
        tokenfile.unpack_block(tokenfile.pack_block(ids, lengths, named)[:-1])


def test_token_file(spark, bpe):
    got = tokenfile.token_file(rows(spark, ODD).repartition(3)).orderBy("doc_id").collect()
    at = 0
    for r, t in zip(got, ODD, strict=True):
        raw = np.array(bpe(t), "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(raw), zlib.crc32(raw.tobytes()))
        at += len(raw)
    assert tokenfile.token_file(rows(spark, [])).count() == 0
    # null and repeated ids, and one row repeated very often
    many = spark.createDataFrame([(None, "a b"), (None, None), (3, "x")] + [(7, "same text")] * 3000, "doc_id long, text string")
    back = tokenfile.token_file(many.repartition(3)).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in back) == [(False, 0)] * 2 + [(True, 3)] + [(True, 7)] * 3000
    end = 0
    for r in sorted(back, key=lambda r: r.start):
        assert r.start == end
        end += r.n_tokens


def test_packing(spark, bpe):
    pieces = packing.packed_sequences(rows(spark, ODD).repartition(3), window=64).collect()
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_seq.setdefault(p.sequence_id, []).append(p)
    for i, t in enumerate(ODD):
        ids, at = np.array(bpe(t), "<u4"), 0
        for p in sorted(by_doc[i], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(ids[at:at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for s, ps in by_seq.items():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == 64 or s == max(by_seq)
    assert packing.packed_sequences(rows(spark, [])).count() == 0


def turns(spark, data):
    return spark.createDataFrame([(c, t, r, x, 1) for c, t, r, x in data],
                                 "conv_id long, turn long, role string, text string, extra int")


def test_chat_round_trip(spark):
    nasty = ["\\### Assistant: </turn> ok", "####", "\\h\\e\\b", "<</turn>", "", "a\n### User: b</turn>\n", "\\", "é😀"]
    data = [(c, k, ("user", "assistant")[k % 2], x) for c in range(3) for k, x in enumerate(nasty)]
    data += [(9, 0, "assistant", "first"), (9, 1, "odd:role</turn>", None), (None, 0, None, "lost"),
             (8, 0, "system", "s"), (8, 1, "user", "u"), (8, 2, "assistant", "a"), (8, 2, "assistant", "a")]
    out = chat.format_conversations(turns(spark, data))
    got = {r.conv_id: r for r in chat.read_back(out).collect()}
    by = {}
    for c, t, r, x in data:
        by.setdefault(c, []).append((t, r or "", x or ""))
    for c, rs in by.items():
        rs.sort()
        said = "".join(f"{r}\n{x}\n" for _, r, x in rs)
        loss = "".join(x for _, r, x in rs if r == "assistant")
        assert got[c].n_turns == len(rs)
        assert got[c].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert got[0].valid and not got[9].valid and not got[None].valid and not got[8].valid
    assert chat.format_conversations(turns(spark, [])).count() == 0


def test_mixing_targets():
    t = mixing.targets([("a", 100), ("b", 100), (None, 10), ("c", 0)])
    # weights a 3, b 1, c 2, null 3; c and null stop at twice their size
    assert t["c"] == 0 and t[None] == 20 and sum(t.values()) == pytest.approx(315)
    assert t["a"] == pytest.approx(200) and t["b"] == pytest.approx(95)
    assert mixing.targets([]) == {}


def test_mixing_takes_the_targets(spark):
    rng = random.Random(2)
    data = [(i, " ".join("w" * rng.randrange(1, 4) for _ in range(rng.randrange(0, 40))), rng.choice("aaaab"), 1)
            for i in range(600)] + [(1000, None, None, 1), (1001, "x y", None, 1)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string, score int")
    got = mixing.mix(docs, keep=("score",)).collect()
    assert len(got) == len(data)
    for s in ("a", "b", None):
        of = [r for r in got if r.source == s]
        size = sum(len(WORD.findall(d[1] or "")) for d in data if d[2] == s)
        assert {r.source_size for r in of} == {size}
        assert abs(sum(r.taken for r in of) - of[0].target) <= 40
        assert all(r.taken in (0, r.size, 2 * r.size) for r in of)
    again = {r.doc_id: r.taken for r in mixing.mix(docs.repartition(5)).collect()}
    assert again == {r.doc_id: r.taken for r in got}
    times = Counter(r.doc_id for r in mixing.mixture(docs).collect())
    assert {r.doc_id: r.times for r in got if r.times} == dict(times)
    assert mixing.mixture(docs).columns == docs.columns
    assert mixing.mix(docs.limit(0)).count() == 0


def brute_statistics(t):
    t = t or ""
    w = WORD.findall(t)
    seen = {}
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i:i + 8]), []).append(i)
    covered = {j for v in seen.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    lines = [s for s in t.split("\n") if WORD.search(s)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))


def test_quality_statistics(spark):
    rng = random.Random(3)
    texts = ODD + [" ".join(rng.choice("abc") for _ in range(rng.randrange(60))) for _ in range(80)]
    texts += ["\n".join(rng.choice(["a b", " ", "", "c#$", "a b "]) for _ in range(12)) for _ in range(40)]
    texts += ["x y z w v u t s r " * 400]
    got = {r.doc_id: r for r in quality.with_statistics(rows(spark, texts)).collect()}
    for i, t in enumerate(texts):
        e = brute_statistics(t)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == e, t
        assert r.base_failed == (e[0] < 20 or 100 * e[4] > 30 * e[0])
    assert quality.with_statistics(rows(spark, [])).count() == 0


def test_binomial_bound():
    for n, p in ((5, 0.3), (40, 0.05), (700, 0.0125), (3000, 0.01)):
        total = 0.0
        for k in range(0, min(n, 60)):
            total += math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
                              + k * math.log(p) + (n - k) * math.log1p(-p))
            assert quality.binomial_cdf(k, n, p) == pytest.approx(min(total, 1.0), rel=1e-9)
    assert quality.binomial_cdf(5, 5, 0.3) == 1.0


def test_cutoffs_need_evidence_and_keep_the_risk():
    rules = {"r": (10, 20, 30)}
    good = {"n": 5000, ("r", 10): 400, ("r", 20): 3, ("r", 30): 0}
    bad = {"n": 500, ("r", 10): 490, ("r", 20): 480, ("r", 30): 400}
    assert quality.choose({"en": {1: good, 0: bad}}, cost=20, rules=rules) == {("en", "r"): 20}
    assert quality.choose({"en": {1: good, 0: bad}}, cost=1000, rules=rules) == {("en", "r"): 30}
    few = {"n": 30, ("r", 10): 0, ("r", 20): 0, ("r", 30): 0}
    assert quality.choose({"en": {1: few, 0: bad}}, rules=rules) == {}
    assert quality.choose({}, rules=rules) == {}


def test_cutoffs_are_tested_in_sequence():
    """The most lenient first, each at delta / (strata x rules), up to the
    first failure; a tested order needs fewer good documents."""
    rules = {"r": (10, 20, 30)}
    bad = {"n": 50, ("r", 10): 50, ("r", 20): 40, ("r", 30): 30}
    for n, sure in ((59, True), (58, False)):        # 0.95 ** 59 < 0.05 < 0.95 ** 58
        good = {"n": n, ("r", 10): 0, ("r", 20): 0, ("r", 30): 0}
        assert bool(quality.choose({"en": {1: good, 0: bad}}, rules=rules)) == sure
    # a stricter cutoff behind a failed one isn't looked at
    good = {"n": 500, ("r", 10): 0, ("r", 20): 400, ("r", 30): 0}
    assert quality.choose({"en": {1: good, 0: bad}}, rules=rules) == {("en", "r"): 30}


def test_given_labels_certify_cutoffs(spark):
    d = "/root/testdata/sf0.1"
    stats = quality.store(quality.with_statistics(spark.read.parquet(f"{d}/documents.parquet")), "statistics")
    got = quality.calibrate(stats, spark.read.parquet(f"{d}/labels.parquet"))
    assert got


def test_false_rejections_stay_below_the_risk(spark):
    """Held-out good documents are lost no more often than the risk says."""
    rng = random.Random(4)

    def text(bad):
        return " ".join(rng.choice(["wo", "rd", "te"]) + str(rng.randrange(900)) + ("#$%" if bad and rng.random() < .7 else "")
                        for _ in range(40))

    data = [(i, text(i % 4 == 0), ("en", "de")[i % 2 == 0 and i % 8 < 4], int(i % 4 != 0)) for i in range(4000)]
    docs = spark.createDataFrame([d[:3] for d in data], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(d[0], d[3]) for d in data if d[0] % 3], "doc_id long, quality int")
    got = quality.judge(docs, labels).collect()
    good = [r.kept for r in got if data[r.doc_id][3] and r.doc_id % 3 == 0]
    bad = [r.kept for r in got if not data[r.doc_id][3] and r.lang == "en" and r.doc_id % 3 == 0]
    assert 1 - sum(good) / len(good) <= quality.RISK
    assert sum(bad) == 0
    kept = quality.keep_good(docs.withColumnRenamed("lang", "lang").selectExpr("*", "1 AS n_words"), labels)
    assert kept.columns == ["doc_id", "text", "lang", "n_words"]
    assert kept.filter("n_words <> 1").count() == 0
    none = quality.judge(docs.limit(20), labels.limit(0)).collect()
    assert all(r.kept for r in none)
