import os

import pytest
from test_decontaminate import brute as hits
from test_ngram_join import brute as linked

import corpus_pipeline
from tidemark.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the synthetic tables")
def test_each_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    named = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "mixing", "sharding"]
    kept = named["quality"](spark, docs, SF)
    assert kept.columns == docs.columns
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = kept.collect()
    ids = {r.doc_id for r in rows}
    assert sum((d in ids) == bool(q) for d, q in label.items()) >= 0.95 * len(label)

    kept = spark.createDataFrame(rows, docs.schema)
    got = named["near_duplicates"](spark, kept, SF)
    assert got.columns == docs.columns
    want = {c for _, _, c in linked([r.doc_id for r in rows], [r.text for r in rows], 5, 80, 100)}
    rows = [r for r in rows if r.doc_id in want]
    assert sorted(map(str, got.collect())) == sorted(map(str, rows))

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = spark.createDataFrame(rows, docs.schema)
    got = named["decontamination"](spark, kept, SF)
    clean = {d for d, _, _, _, bad in hits([(r.doc_id, r.text) for r in rows], items, 13) if not bad}
    rows = [r for r in rows if str(r.doc_id) in clean]
    assert sorted(map(str, got.collect())) == sorted(map(str, rows))

    kept = spark.createDataFrame(rows, docs.schema)
    mixed = named["mixing"](spark, kept, SF)
    assert mixed.columns == docs.columns
    size = sum(len((r.text or "").encode().split()) for r in rows)
    taken = sum(len((r.text or "").encode().split()) for r in mixed.collect())
    longest = {}
    for r in rows:
        longest[r.source] = max(longest.get(r.source, 0), len((r.text or "").encode().split()))
    assert abs(taken - 1.5 * size) <= sum(longest.values()) / 2 + len(longest)
    assert {r.text for r in mixed.collect()} <= {r.text for r in rows}
    shards = named["sharding"](spark, mixed, SF)
    assert shards.count() == mixed.count()

    final = corpus_pipeline.run(spark, SF)
    assert sorted(map(str, final.collect())) == sorted(map(str, shards.collect()))


def test_queries_are_registered():
    assert sorted({int(k[2:].split("_")[0]) for k in queries.QUERIES if k.startswith("op")}) == list(range(1, 14))
    assert set(queries.ORACLES) <= set(queries.QUERIES)
