"""Helpers shared by the operators: saved intermediate tables, size-checked look-ups, word splitting."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: A look-up table of at most so many rows is broadcast; a larger one is joined by its key, with the hot side salted.
BROADCAST_ROWS = 20_000


#: Rows of text in an Arrow batch at most: what a Python worker holds at once stays small.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch size to BATCH_ROWS where it is larger."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one in spark.checkpoint.dir; a temporary one only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="llm-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends here and lost executors cost nothing."""
    path = work_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_bytes(texts: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; a null is an empty text."""
    return [x or b"" for x in texts.cast(pa.binary()).to_pylist()]


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


def digest_bits(*parts: Column | str) -> Column:
    """52 pseudo-random bits of the joined parts, as a fraction in [0, 1)."""
    joined = F.concat_ws("|", *(F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts))
    return F.conv(F.substring(F.md5(joined), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def crc_of_id(column: str = "doc_id") -> Column:
    """crc32 of the id written as text; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def lookup(df: DataFrame, table: DataFrame, key: str, n_rows: int, salts: int = 64) -> DataFrame:
    """Left join with a table of one row per non-null key: broadcast up to BROADCAST_ROWS rows, else with salted keys."""
    if n_rows <= BROADCAST_ROWS:
        return df.join(F.broadcast(table), key, "left")
    salt = free_name(df, "salt_no")
    left = df.withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.lit(salts)))
    right = table.withColumn(salt, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    return left.join(right, [key, salt], "left").drop(salt)
