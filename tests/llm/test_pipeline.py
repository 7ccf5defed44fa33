from __future__ import annotations

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from gridrank.llm import mil_quality, store

DATA = "/root/testdata/sf0.001"


def test_each_stage_takes_effect(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names = docs.columns
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    before = docs
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = store.keep(stage(spark, before, DATA), "stage")
        assert after.columns == names, name
        kept.append((before, after))
        before = after
    (a, b), (c, d), (e, f) = kept
    scored = {r.doc_id: r.score for r in mil_quality.score(a, mil_quality.train(a, labels)).collect()}
    words = {r.doc_id: bool((r.text or "").split()) for r in a.collect()}
    assert {r.doc_id for r in b.collect()} == {i for i, s in scored.items() if s >= 0.5 or not words[i]}
    good = {r.doc_id for r in labels.where("quality = 1").collect()} & set(scored)
    assert np.mean([scored[i] >= 0.5 for i in good]) >= 0.99
    from test_jaccard_join import brute

    groups = brute([(r.doc_id, r.text, None) for r in c.collect()])
    assert {r.doc_id for r in d.collect()} == {i for (_, i), _, component in groups if component == i}
    from test_secret_scan import brute as spans

    was = {r.doc_id: r.text for r in e.collect()}
    for r in f.collect():
        assert not spans(r.text) and r.n_chars == len(r.text)
        assert r.text == was[r.doc_id] or "[SECRET]" in r.text
    pieces = corpus_pipeline.packing(spark, f, DATA).collect()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert sum(p.length for p in pieces) == sum(len(library.encode(r.text, add_special_tokens=False).ids) + 1 for r in f.collect())


def test_run_applies_all_stages(spark):
    assert set(corpus_pipeline.run(spark, DATA).columns) == {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}
