"""The last stage of the pipeline keeps columns that are named like its own."""

import corpus_pipeline


def test_shards_keep_clashing_columns(spark):
    docs = spark.createDataFrame([(i, "text " * i, f"own {i}", "kept") for i in range(40)], "doc_id bigint, text string, size string, shard string")
    found = corpus_pipeline.shards(spark, docs, "")
    assert found.columns == ["doc_id", "text", "size", "shard", "_size", "text_crc32", "law", "_shard", "slot", "grown_shard"]
    assert {(r["doc_id"], r["size"], r["shard"], r["_size"]) for r in found.collect()} == {(i, f"own {i}", "kept", 5 * i + 8) for i in range(40)}
