"""Session builder with the settings the jobs rely on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def get_session(app_name: str = "ledgerline", master: str | None = None, **conf: str) -> SparkSession:
    """Build a session; dots in option names are written as double underscores."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def compiled_methods(df: DataFrame) -> DataFrame:
    """Give up fused stages whose code the JVM would not compile: beyond 8000 bytes a method is interpreted, several times slower."""
    df.sparkSession.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return df


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder under the shared one in spark.checkpoint.dir; a temporary one only in local mode, where all share it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    root = root or tempfile.mkdtemp(prefix="ledgerline-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
