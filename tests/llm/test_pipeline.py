from __future__ import annotations

import pytest

import corpus_pipeline
from tests.llm.common import ROWS, documents
from tests.llm.test_near_and_licenses import lower, roots
from tests.llm.test_simhash_sets import brute_links, brute_set


def test_stages_against_brute_force(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"]
    before = docs.toPandas()
    for name, stage in corpus_pipeline.STAGES:
        path = f"{tmp_path}/{name}"
        stage(spark, docs, small).write.parquet(path)
        docs = spark.read.parquet(path)
        after = docs.toPandas()
        if name != "packing":
            assert docs.columns == columns
        if name == "toxicity":
            assert set(after["doc_id"]) <= set(before["doc_id"]) and len(after) > 0.7 * len(before)
        elif name == "exact_dedup":
            want = before.assign(k=before["text"].map(lower)).groupby("k")["doc_id"].max()
            assert sorted(after["doc_id"]) == sorted(want)
        elif name == "near_dedup":
            rows = before.sort_values("doc_id")
            parts = roots(len(rows), brute_links([brute_set(t) for t in rows["text"]]))
            assert sorted(after["doc_id"]) == [d for i, d in enumerate(rows["doc_id"]) if parts[i] == i]
        elif name == "mixing":
            assert set(after["doc_id"]) <= set(before["doc_id"]) and after["doc_id"].value_counts().max() <= 2
        else:
            assert after.groupby("sequence_id")["length"].sum().max() <= 2048
            assert set(after["doc_id"]) == set(before["doc_id"])
        before = after


@pytest.mark.parametrize("rows", [ROWS, []], ids=["odd", "empty"])
def test_stages_take_odd_rows_and_empty_tables(spark, small, tmp_path, rows):
    docs = documents(spark, rows, clash=bool(rows))
    columns, ids = docs.columns, {r[0] for r in rows}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, small).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert {r.doc_id for r in docs.select("doc_id").collect()} <= ids
        if name != "packing":
            assert docs.columns == columns
        if name == "near_dedup" and rows:
            kept = sorted(r.doc_id for r in docs.select("doc_id").collect())
            assert len(set(kept) & {4, 5, 12}) == len(set(kept) & {6, 14}) == 1
