"""The pipeline's stages, each on its predecessor's output."""

from __future__ import annotations

import corpus_pipeline
from support import SF, from_elsewhere

from millrace.llm.common import cut


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = kept[name] = cut(stage(spark, docs, SF), name)
        if name != "token_output":
            assert docs.columns == columns
    rows = {name: df.collect() for name, df in kept.items()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = {r.doc_id for r in rows["quality_classifier"]}
    assert sum((doc in good) == bool(q) for doc, q in labels.items()) >= 0.97 * len(labels)
    sets = {r.doc_id: shingles(r.text) for r in rows["quality_classifier"]}
    stayed = {r.doc_id for r in rows["simhash_near_dedup"]}
    likeness = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    for doc in sets:
        others = [likeness(doc, other) for other in sets if other != doc]
        if doc not in stayed:
            assert max(others) >= 0.6
    pairs = [(a, b) for a in stayed for b in stayed if a < b and likeness(a, b) >= 0.9]
    assert not pairs
    mixed = rows["mixing"]
    assert {r.doc_id for r in mixed} <= {r.doc_id for r in rows["benchmark_decontamination"]} <= stayed
    tokens = sorted(rows["token_output"], key=lambda r: r.start)
    assert [r.doc_id for r in tokens] == sorted(r.doc_id for r in mixed)
    at = 0
    for r in tokens:
        assert r.start == at
        at += r.n_tokens


def test_queries_with_python_workers_run_without_the_repository_on_their_path(tmp_path):
    names = ["op1_language_id", "op3_chat_format", "op4_simhash", "op6_token_output", "op7_secret_scan", "op8_quality", "pipeline"]
    assert from_elsewhere(tmp_path, names) == names
