"""Readers of document files and of model responses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerline.operators.triage import extension_of

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"
RESPONSE_SCHEMA = "doc_id string, document_type string, raw string"


def as_files(df: DataFrame) -> DataFrame:
    """Columns (path, name, extension, length, content) of binary-file rows."""
    name = F.element_at(F.split("path", "/"), -1)
    return df.select("path", name.alias("name"), extension_of(name).alias("extension"), "length", "content")


def scan_files(spark: SparkSession, path: str) -> DataFrame:
    """Files below a folder; without ``content`` in the query only the listing is read.

    Spark's file sources leave out files of 0 bytes; where those matter they come from the table of arrivals.
    """
    return as_files(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))


def scan_responses(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Model responses as (doc_id, document_type, raw)."""
    return spark.read.schema(RESPONSE_SCHEMA).format(fmt).load(path)
