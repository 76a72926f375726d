"""The pipeline against a brute-force version of its stages, and stage by stage on odd rows."""

import collections

import corpus_pipeline
from faultline.llm import langid, mixing
from tests.llm.test_operators import near_by_force


def test_run(spark, docs, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir).collect()
    known = {r.doc_id for r in langid.predict(docs, langid.fit(docs.filter(langid.fold(docs["doc_id"], 4) != 2))).collect() if r.lang_pred != "und"}
    texts = {r.doc_id: r.text or "" for r in docs.collect() if r.doc_id in known}
    last = {}
    for d in sorted(texts):
        last[texts[d]] = d
    near = near_by_force([(d, t) for t, d in last.items()], 5, 80)
    kept = [d for d, (_, c) in near.items() if d == c]
    mixed = mixing.mix(docs.filter(docs["doc_id"].isin(kept))).collect()
    want = collections.Counter({r.doc_id: r.copies for r in mixed if r.copies})
    assert collections.Counter(r.doc_id for r in out if r.piece == 0) == want


def test_stages_on_odd_rows(spark, odd, nothing):
    rows = odd
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(spark, rows, "")
        if name != "packing":
            assert rows.columns == odd.columns
    assert rows.count() > 0
    rows = nothing
    for _, stage in corpus_pipeline.STAGES:
        rows = stage(spark, rows, "")
    assert rows.count() == 0
