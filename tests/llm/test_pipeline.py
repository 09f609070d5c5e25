"""The corpus pipeline: its contract and its stages' effects."""

from collections import Counter

import corpus_pipeline
from hopweave.llm import neardup, pii, quality


def test_stages_in_order(spark, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "simhash near-dedup", "pii", "source mixing", "best-fit packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, sf).cache()
        assert kept.columns == docs.columns and 0 < kept.count() <= 3 * docs.count()
    assert not any(any(s.values()) for s in (pii.find(r.text)[1] for r in kept.select("text").distinct().collect()))
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, sf).toPandas()
    words = lambda texts: Counter(w for t in texts for w in (t or "").split())
    assert words(packed["text"]) == words(r.text for r in kept.collect())


def test_run_equals_the_stages(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    labels, docs = spark.read.parquet(f"{sf}/labels.parquet"), spark.read.parquet(f"{sf}/documents.parquet")
    good = quality.keep_good(docs, labels)
    one = neardup.keep_one(good)
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} <= {r.doc_id for r in one.select("doc_id").collect()}
    assert out.count() > 0
