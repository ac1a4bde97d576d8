"""The pipeline against a brute-force version of its stages, and the registry."""

import hashlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from tests.llm.test_dedup import brute_components, brute_fingerprint, brute_lines
from tests.llm.test_search import brute_windows
from wardwise.llm import bpe, toxicity
from wardwise.llm.queries import BPE_RANKS, training_labels


def test_stages_and_registry():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "byte_bpe"]
    names = set(__spark_entry__.queries())
    assert {n.split("_")[0] for n in names if n.startswith("op") and n[2].isdigit()} == {f"op{k}" for k in range(1, 14)} and "pipeline" in names


def test_run_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    lexicon = toxicity.train(docs, training_labels(spark, sf))
    rows = [r for r in docs.collect() if lexicon.score(r.text or "") < 0.5]
    cleaned = [t for t, _, _ in brute_lines([(r.source, r.text) for r in rows], 5)]
    text = {r.doc_id: t for r, t in zip(rows, cleaned, strict=True)}
    root = brute_components(list(text), [brute_fingerprint(t) for t in text.values()])
    text = {i: t for i, t in text.items() if root[i] == i}
    clean = {i for i, _, hits, _ in brute_windows(list(text.items()), items, 10) if not hits}
    encoder = bpe.bpe(public_tokenizers.path(BPE_RANKS), public_tokenizers.PATTERN)
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert set(got) == clean
    for i, r in got.items():
        ids = encoder.encode(text[i] or "")
        assert bytes(r.ids) == ids and r.n_tokens == len(np.frombuffer(ids, "<u4"))
        assert r.decoded_sha256 == hashlib.sha256((text[i] or "").encode()).hexdigest()


def test_stages_take_odd_documents(spark, docs, no_docs, sf):
    for start in (docs.withColumn("score", F.lit("clash")), no_docs):
        df = start
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, df, sf)
            assert out.columns == df.columns
            df = spark.createDataFrame(out.collect(), out.schema)
        last = corpus_pipeline.STAGES[-1][1](spark, df, sf)
        assert last.count() == df.count()
