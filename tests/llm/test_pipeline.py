"""Each stage on what the one before it kept."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import pytest

import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
import oracle
from tagtide.llm import common, lines, mixing, pieces, quality, simhash
from tagtide.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not Path(SF_DIR).is_dir(), reason="the given tables are not here")


@needs_tables
def test_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    results = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF_DIR).persist()
        results.append((docs, out))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        docs = out
    (raw, good), (_, lined), (_, single), (_, mixed), (_, encoded) = results
    passed = {r.doc_id for r in quality.assess(raw).where("kept").collect()}
    assert {r.doc_id for r in good.collect()} == passed and 0 < len(passed) < raw.count()
    assert Counter((r.doc_id, r.text) for r in lined.collect()) == Counter((r.doc_id, r.text) for r in lines.dedup_lines(good).collect())
    assert {r.doc_id for r in single.collect()} == {r.component_id for r in simhash.near_duplicates(lined).collect()}
    taken = {r.id: r.repeats for r in mixing.mix(single)[0].collect()}
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({k: n for k, n in taken.items() if n})
    assert encoded.count() == mixed.count() and encoded.where("NOT lossless").count() == 0
    decoded = pieces.decode_documents(encoded, corpus_pipeline.PIECES)
    assert Counter((r.doc_id, r.text) for r in decoded.collect()) == Counter((r.doc_id, r.text) for r in mixed.collect())
    whole = corpus_pipeline.run(spark, SF_DIR)
    assert Counter((r.doc_id, tuple(r.pieces)) for r in whole.collect()) == Counter((r.doc_id, tuple(r.pieces)) for r in encoded.collect())


@needs_tables
@pytest.mark.parametrize("name", list(QUERIES))
def test_queries_run_on_whole_tables(spark, name):
    df = QUERIES[name].run(spark, SF_DIR)
    source = "embeddings" if name.startswith("op2_") else "documents"
    n = df.count()
    assert n > 0 if name.startswith("op7_") else n == spark.read.parquet(f"{SF_DIR}/{source}.parquet").count()


@needs_tables
@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql])
def test_queries_equal_their_sql(spark, name):
    assert oracle.difference(QUERIES[name].run(spark, SF_DIR), QUERIES[name].sql, oracle.connect(SF_DIR)) is None


def test_near_dedup_is_by_simhash_and_then_by_shingles(spark):
    """Fingerprints within 2 bits fall although few shingles are shared, and near copies although their bits differ."""
    base = [f"w{i}" for i in range(60)]
    changed = [w if i % 30 else f"{w}x" for i, w in enumerate(base)]
    rows = [(0, " ".join(base)), (1, " ".join(changed)), (2, "one two three four"), (3, "one  two three four five"), (4, "alone"), (None, "alone")]
    prints = [simhash.fingerprint(t.encode()) for _, t in rows]
    assert (prints[0] ^ prints[1]).bit_count() > 2
    words = {}
    for i in range(20_000):  # two texts of other words whose fingerprints are within 2 bits
        text = f"a{i % 200} b{i // 200}"
        near = [words[k] for k in {simhash.fingerprint(text.encode()) ^ (1 << b) for b in range(64)} if k in words]
        words[simhash.fingerprint(text.encode())] = text
        if near:
            rows += [(10, near[0]), (11, text)]
            break
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.simhash_near_dedup(spark, docs, "").collect()}
    joined = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs.where("doc_id IS NOT NULL")).collect()}
    assert 1 not in kept and kept <= {k for k, c in joined.items() if k == c}


def test_batches_of_a_worker_are_bounded(spark):
    """Texts of 30 MB come in parts of some 8 MB, and what a session asks for stays."""

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows], "mb": [batch.nbytes / 1e6]})

    docs = spark.range(300, numPartitions=1).select("id", F.repeat(F.lit("word "), 20_000).alias("text"))
    found = common.map_arrow(docs, sizes, "n long, mb double").collect()
    assert sum(r.n for r in found) == 300 and max(r.mb for r in found) < 9
    try:
        spark.conf.set(common.BATCH_SETTING, "2m")
        found = common.map_arrow(docs, sizes, "n long, mb double").collect()
        assert sum(r.n for r in found) == 300 and max(r.mb for r in found) < 3
    finally:
        spark.conf.unset(common.BATCH_SETTING)
