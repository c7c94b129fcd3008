import zlib

import corpus_pipeline as pipeline


def test_the_last_stage_returns_token_ids(spark):
    docs = spark.createDataFrame([(1, "some words here"), (2, None)], "doc_id long, text string")
    rows = pipeline.packed(spark, docs, "").collect()
    assert {r["doc_id"] for r in rows} == {1, 2} and all(zlib.crc32(r["ids"]) == r["ids_crc32"] for r in rows)
