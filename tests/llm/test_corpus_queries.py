"""Registered queries against their SQL, and the pipeline's stages, on the smallest tables."""

from __future__ import annotations

import compare
import pytest
from conftest import SMALL

from emberlake.llm.catalog import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    assert compare.compare(QUERIES[name](spark, SMALL), duck, ORACLE_SQL[name]) == ""


def test_toxicity_query(spark):
    rows = QUERIES["op5_toxicity"](spark, SMALL).collect()
    assert len(rows) == 200 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = kept
        kept = stage(spark, kept, SMALL)
        kept = spark.createDataFrame(kept.collect(), kept.schema)
        assert kept.columns == docs.columns and kept.count() > 0
        if name in ("toxicity", "near_duplicates"):
            assert kept.subtract(before).count() == 0
        if name == "secrets":
            assert kept.count() == before.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, SMALL)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in kept.select("doc_id").distinct().collect()}


def test_pipeline_run_equals_brute_force(spark):
    import re
    import zlib
    from collections import Counter

    import corpus_pipeline
    import numpy as np
    from test_corpus_operators import check_packing, components_of
    from tokenizers import Tokenizer

    from emberlake.llm import bpe, mixing, secret_scan, toxicity

    table = spark.read.parquet(f"{SMALL}/documents.parquet")
    docs = sorted((r.asDict() for r in table.collect()), key=lambda r: r["doc_id"])
    model = toxicity.train(table, spark.read.parquet(f"{SMALL}/labels.parquet"))
    docs = [d for d in docs if toxicity.Scorer(model).score([d["text"]])[0] < toxicity.THRESHOLD]
    found = components_of([d["text"] for d in docs])
    docs = [d for i, d in enumerate(docs) if not found[i][0] or found[i][1] == i]
    for d in docs:
        spans = sorted((m.start(), m.end()) for r in secret_scan.MASKED for m in re.finditer(r.pattern, d["text"] or "") if len(m.group(r.group)) >= r.least)
        out, at = "", 0
        for a, b in spans:
            if a >= at:
                out += d["text"][at:a] + "[SECRET]"
            at = max(at, b)
        if spans:
            d["text"] = out + d["text"][at:]
            d["n_chars"] = len(d["text"])
    masked = spark.createDataFrame([tuple(d[c] for c in table.columns) for d in docs], table.schema)
    copies = {r.doc_id: r.copies for r in mixing.mix(masked).collect()}
    library, want = Tokenizer.from_file(bpe.tokenizer_path("word_bpe_49k.json")), Counter()
    for d in docs:
        ids = np.array(library.encode(d["text"] or "", add_special_tokens=False).ids + [0], "<u4")
        for k in range(0, len(ids), 2048):
            want[d["doc_id"], k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes())] += copies[d["doc_id"]]
    got = corpus_pipeline.run(spark, SMALL).toPandas()
    check_packing(got)
    assert Counter(zip(got.doc_id, got.piece, got.start, got.length, got.ids_crc32)) == +want
