"""Responses checked as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ledgerline.functions.numeric import DEFAULT_TOLERANCE
from ledgerline.plans.reconcile import validate_responses
from ledgerline.sources.files import RESPONSE_SCHEMA


def stream_checks(
    responses: DataFrame, out_path: str, checkpoint: str, work_path: str, tolerance: float = DEFAULT_TOLERANCE, available_now: bool = True
) -> StreamingQuery:
    """Write the checks of a stream of responses to ``out_path``, one folder per micro-batch.

    A document is whole in its response, so a micro-batch needs no state of earlier ones and the batch job runs
    unchanged on it; its typed tables go below ``work_path``. Each batch overwrites its own folder, so a batch repeated after a failure adds nothing twice.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        checks = validate_responses(batch, f"{work_path}/batch_id={batch_id}", tolerance)
        checks.write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}")

    writer = responses.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_response_stream(spark: SparkSession, path: str, fmt: str = "json", files_per_batch: int | None = None) -> DataFrame:
    """Stream of response files dropped into a folder."""
    reader = spark.readStream.schema(RESPONSE_SCHEMA).format(fmt)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)
