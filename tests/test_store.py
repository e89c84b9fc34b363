"""The document store: commits, retries, compaction, and look-ups that read a constant number of files."""

import pytest
from pyspark.sql import functions as F

from ledgerline.sources import documents


def rows_of(spark, first, last):
    return spark.range(first, last).select(
        "id", F.concat(F.lit("name-"), (F.col("id") % 50).cast("string")).alias("document_name"), F.lit("invoice").alias("document_type"),
        F.timestamp_seconds(F.col("id")).alias("created_at"), F.sha2(F.col("id").cast("string"), 256).alias("metadata"),
    )


def die():
    raise KeyboardInterrupt


def test_a_killed_append_leaves_nothing_visible(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    documents.append_documents(rows_of(spark, 0, 100), path, "a")
    with monkeypatch.context() as patch:  # the job dies after its rows are written and before they are committed
        patch.setattr(documents.F, "current_timestamp", die)
        with pytest.raises(KeyboardInterrupt):
            documents.append_documents(rows_of(spark, 100, 200), path, "b")
    assert spark.read.parquet(f"{path}/rows").count() == 200
    assert documents.read_documents(spark, path).count() == 100
    assert documents.stored_by_id(spark, path, 150).count() == 0
    for _ in range(2):
        documents.append_documents(rows_of(spark, 100, 200), path, "b")
    stored = documents.read_documents(spark, path)
    assert stored.count() == 200 and stored.select("id").distinct().count() == 200


def test_lookups_read_as_many_files_however_large_the_store(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(documents, "PART_ROWS", 500)
    path, read, whole = str(tmp_path / "store"), [], []
    for batch, (first, last) in enumerate([(0, 1000), (1000, 4000), (4000, 16000)]):
        documents.append_documents(rows_of(spark, first, last), path, f"batch-{batch}")
        documents.compact(spark, path)
        assert [r.id for r in documents.stored_by_id(spark, path, 42).collect()] == [42]
        files = lambda df: df.select(F.input_file_name()).distinct().count()
        read.append(files(documents._visible(spark, path, "rows", F.lit(42))))
        whole.append(files(documents._visible(spark, path, "rows")))
    assert read == [1, 1, 1] and whole[0] < whole[1] < whole[2]
    assert documents.stored_by_name(spark, path, "name-7").first().id == 15957
    assert documents.stored_by_name(spark, path, "nobody").count() == 0 and documents.stored_by_id(spark, path, -1).count() == 0
    assert documents.read_documents(spark, path).count() == 16000


def test_a_batch_written_again_after_a_compaction_counts_once(spark, tmp_path):
    path = str(tmp_path / "store")
    documents.append_documents(rows_of(spark, 0, 10), path, "a")
    documents.append_documents(rows_of(spark, 10, 20), path, "b")
    documents.compact(spark, path)
    documents.append_documents(rows_of(spark, 20, 25), path, "c")
    documents.append_documents(rows_of(spark, 10, 18), path, "b")
    assert sorted(r.id for r in documents.read_documents(spark, path).collect()) == [*range(18), *range(20, 25)]
    assert documents.stored_by_id(spark, path, 19).count() == 0 and documents.stored_by_id(spark, path, 12).count() == 1
    documents.compact(spark, path)
    assert sorted(r.id for r in documents.read_documents(spark, path).collect()) == [*range(18), *range(20, 25)]


def test_tasks_that_write_stay_small_however_large_the_batch(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(documents, "PART_ROWS", 500)
    path = str(tmp_path / "store")
    documents.append_documents(rows_of(spark, 0, 16000), path, "a")
    stored = documents._visible(spark, path, "rows").withColumn("file", F.input_file_name())
    parts = stored.groupBy("key_part").agg(F.count("id").alias("n"), F.countDistinct("file").alias("files")).collect()
    assert len(parts) == 32 and max(r.n for r in parts) < 750 and {r.files for r in parts} == {1}
    own = spark.range(32).select(F.col("id").cast("int").alias("key_part")).repartitionById(32, F.col("key_part"))
    assert own.groupBy(F.spark_partition_id()).count().count() == 32  # no task gets two parts
    assert [r.id for r in documents.stored_by_id(spark, path, 42).collect()] == [42]
