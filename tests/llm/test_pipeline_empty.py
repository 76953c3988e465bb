"""The pipeline on empty tables."""

import pytest

import corpus_pipeline

TABLES = {"documents": "doc_id long, text string, lang string, source string, n_chars long", "labels": "doc_id long, quality int, toxic int", "benchmark": "item_id long, text string"}
ROWS = {"documents": [(1, "one two three four", "en", "a", 18), (2, None, None, None, None), (3, "", "en", "b", 0)], "labels": [(1, 1, 0)], "benchmark": [(1, "five six seven eight")]}


@pytest.mark.parametrize("empty", [("documents",), ("labels", "benchmark"), ("documents", "labels", "benchmark")])
def test_empty_tables(spark, tmp_path, empty):
    for name, schema in TABLES.items():
        spark.createDataFrame([] if name in empty else ROWS[name], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    kept = sorted(r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert kept == ([] if "documents" in empty else [1, 2, 3])
