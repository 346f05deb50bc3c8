"""Each stage of the pipeline against brute force over what the stage before it kept."""

import os

import brute
import pyarrow.parquet as pq

import corpus_pipeline
from llm import shared


def test_stages(spark, data):
    data = os.path.join(os.path.dirname(data), "sf0.01")  # the smallest has too few labels to learn from
    docs = spark.read.parquet(os.path.join(data, "documents.parquet"))
    labels = {r["doc_id"]: r["toxic"] for r in pq.read_table(os.path.join(data, "labels.parquet")).to_pylist()}
    items = [(r["item_id"], r["text"]) for r in pq.read_table(os.path.join(data, "benchmark.parquet")).to_pylist()]
    kept, columns = {}, docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = shared.cut(stage(spark, docs, data), "test")
        rows = docs.collect()
        kept = {r["doc_id"]: r["text"] for r in rows}
        if name != "mixing":
            assert docs.columns == columns
        if name == "toxicity":
            assert set(kept) < set(before)
            gone = [labels[i] for i in set(before) - set(kept) if labels.get(i) is not None]
            assert sum(gone) >= 0.7 * len(gone)
        if name == "jaccard_join":
            classes = brute.jaccard(list(before.items()))
            assert set(kept) == {i if n == 0 else c for i, n, c in classes}
        if name == "decontamination":
            assert set(kept) == {r[0] for r in brute.benchmark(list(before.items()), items) if not r[-1]}
        if name == "pii":
            assert set(kept) == set(before)
            assert all(r[1:5] == (0, 0, 0, 0) for r in brute.personal(list(kept.items())))
            clean = {r[0] for r in brute.personal(list(before.items())) if not any(r[1:5])}
            assert sum(kept[i] == before[i] for i in clean) >= 0.9 * len(clean)
        if name == "mixing":
            assert all(r["text"] == before[r["doc_id"]] for r in rows) and len(rows) > 0
