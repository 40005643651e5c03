"""The pipeline's stages against their operators, on the smallest tables."""
from collections import Counter

import corpus_pipeline as P
from conftest import SMALL
from sinter.llm import mixing, neardup, quality, queries, toxicity
from sinter.llm.common import store, table


def test_stages_take_effect(spark):
    docs, labels = table(spark, SMALL, "documents"), table(spark, SMALL, "labels")
    cols, seen = docs.columns, {}
    for name, stage in P.STAGES:
        seen[name] = (docs, store(stage(spark, docs, SMALL), f"test-{name}"))
        docs = seen[name][1]
        assert (docs.columns == cols) == (name != "packing")

    def ids(df):
        return sorted(r.doc_id for r in df.select("doc_id").collect())

    before, after = seen["quality_rules"]
    assert ids(after) == ids(quality.judge(before, labels).filter("kept"))
    before, after = seen["toxicity"]
    assert ids(after) == ids(toxicity.classify(before, labels).filter("predicted = 0"))
    before, after = seen["near_duplicates"]
    assert ids(after) == sorted({r.class_id for r in neardup.near_duplicates(before).collect()})
    before, after = seen["mixing"]
    times = {r.doc_id: r.times for r in mixing.mix(before).collect() if r.times}
    assert Counter(ids(after)) == Counter(times)
    before, after = seen["packing"]
    per = Counter(ids(before))
    tokens = {r.doc_id: r.n_tokens for r in queries.QUERIES["op5_token_file"](spark, SMALL).collect()}
    got = Counter()
    for r in after.collect():
        got[r.doc_id] += r.length
    assert got == Counter({i: n * tokens[i] for i, n in per.items()})


def test_run_and_empty_documents(spark, tmp_path):
    assert P.run(spark, SMALL).count() > 0
    for t in ("documents", "labels"):
        table(spark, SMALL, t).limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert P.run(spark, str(tmp_path)).count() == 0
