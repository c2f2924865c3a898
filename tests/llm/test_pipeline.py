"""The pipeline's stages against brute force, each on its own input."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


def test_stages_against_brute_force(spark):
    from driftline.llm.rule_ensemble import train
    from test_line_chunks import brute as brute_lines
    from test_mbs_packing import check
    from test_simhash_ball import brute as brute_groups
    from test_winnow import brute as brute_hits

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_duplicates", "decontamination", "packing"]

    kept = stages["quality"](spark, docs, SF)
    model = train(docs, labels.filter(F.crc32(F.col("doc_id").cast("string")) % 3 != 1))
    scores = {r.doc_id: r.p for r in docs.select("doc_id", model.score(F.col("text")).alias("p")).collect()}
    rows = {r.doc_id: r.text for r in kept.collect()}
    assert set(rows) == {d for d, p in scores.items() if p >= 0.5}

    lines = stages["lines"](spark, kept, SF)
    assert lines.columns == docs.columns
    left = {r.doc_id: r for r in lines.collect()}
    want = brute_lines(list(rows.items()))
    assert {d: r.text for d, r in left.items()} == {d: w[0] for d, w in want.items()}
    assert all(r.n_chars == len(r.text) for r in left.values())

    single = stages["near_duplicates"](spark, lines, SF)
    groups = brute_groups([(d, r.text) for d, r in left.items()])
    alone = {r.doc_id: r.text for r in single.collect()}
    assert single.columns == docs.columns and sorted(alone) == sorted({c for _, _, c in groups})

    clean = stages["decontamination"](spark, single, SF)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    fine = {r.doc_id: r.text for r in clean.collect()}
    assert clean.columns == docs.columns and set(fine) == {d for d, _, n, _ in brute_hits(list(alone.items()), items) if not n}

    check(list(fine.items()), stages["packing"](spark, clean, SF).collect(), 2048)
    out = corpus_pipeline.run(spark, SF)
    assert sorted({r.doc_id for r in out.collect()}) == sorted(fine)


def test_odd_rows_and_clashing_columns(docs, corpus):
    rows = list(enumerate(corpus)) + [(3, corpus[3]), (3, corpus[3]), (None, corpus[7]), (None, None), (900, "x" * 3_000_000)]
    table = docs(rows)
    stages = dict(corpus_pipeline.STAGES)
    for name in ("lines", "near_duplicates", "decontamination"):
        out = stages[name](table.sparkSession, table, SF)
        assert out.columns == table.columns
        found = out.collect()
        assert all((r.shard, r.slot, r.th, r.fp, r.id, r.row) == (7, 7, 7, "x", "y", 7) for r in found)
        if name == "lines":
            assert sorted(str(r.doc_id) for r in found) == sorted(str(r[0]) for r in rows)
        assert 900 in {r.doc_id for r in found}
    packed = stages["packing"](table.sparkSession, table, SF).collect()
    assert {r.doc_id for r in packed} == {r[0] for r in rows}


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.collect() == []
