"""The document store: an append-only Parquet table with commits, keyed look-ups, and the queries on it.

A store is a folder of three tables. `rows` holds the documents, `names` a narrow line (name, id, created_at) for each, both
in one partition folder per attempt to write a batch and per hash part of their key. `commits` has a row for every finished
attempt. Readers take, of each batch, the attempt committed last and nothing else: an append that was killed leaves files that
no reader sees, and a batch written again replaces itself. Compaction writes the visible rows anew as one attempt that stands
for all batches, in as many parts as their number asks for, so a look-up by key reads one part of few attempts.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SUMMARY_COLUMNS = ["id", "document_name", "document_type", "processing_status", "created_at", "metadata"]
DEFAULT_LIMIT, MAX_LIMIT = 50, 100  # fixed values
#: Least hash parts of an appended batch, and rows that a part of a batch or of a compacted store has.
APPEND_PARTS, PART_ROWS = 8, 1_000_000
_OWN = ["append_attempt", "key_part", "append_batch"]


def _part(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(parts)).cast("int")


def _write(df: DataFrame, path: str, parts: int, batches: list[str]) -> None:
    """Write rows and names of one attempt, then commit it for the batches; the commit is a single small file.

    Each part is one task, so that a task sorts about PART_ROWS rows however many there are in all.
    """
    attempt = uuid.uuid4().hex
    names = df.select("document_name", "id", "created_at", "append_batch")
    for table, rows, key in (("rows", df, "id"), ("names", names, "document_name")):
        own = rows.withColumn("append_attempt", F.lit(attempt)).withColumn("key_part", _part(F.col(key), parts))
        own = own.repartitionById(parts, F.col("key_part")).sortWithinPartitions("key_part", key)
        own.write.mode("append").partitionBy("append_attempt", "key_part").parquet(f"{path}/{table}")
    commit = df.sparkSession.createDataFrame([(b, attempt, parts) for b in batches], "batch string, attempt string, parts int")
    commit.withColumn("committed_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{path}/commits")


def append_documents(df: DataFrame, path: str, batch: str | None = None) -> None:
    """Append a batch of documents; id and created_at are assigned where they are absent.

    An assigned id is the batch and the row's number in it, hence unique. A batch appended again under its name replaces
    itself, so a job that names its batches can be repeated; without a name every call is a new batch.
    """
    batch = batch or uuid.uuid4().hex
    if "created_at" not in df.columns:
        df = df.withColumn("created_at", F.current_timestamp())
    if "id" not in df.columns:
        df = df.withColumn("id", F.concat_ws("-", F.lit(batch), F.monotonically_increasing_id().cast("string")))
    _write(df.withColumn("append_batch", F.lit(batch)), path, max(APPEND_PARTS, -(-df.count() // PART_ROWS)), [batch])


def _live(spark: SparkSession, path: str) -> list:
    """The attempts that count, with their parts and those of their batches that were written again later; few after a compaction."""
    try:
        commits = spark.read.parquet(f"{path}/commits")
    except AnalysisException:
        return []
    last = commits.groupBy("batch").agg(F.max_by("attempt", "committed_at").alias("last"))
    is_last = F.col("attempt") == F.col("last")
    per_attempt = commits.join(last, "batch").groupBy("attempt", "parts").agg(F.count_if(is_last).alias("n"), F.collect_set(F.when(~is_last, F.col("batch"))).alias("stale"))
    return per_attempt.where("n > 0").collect()


def _visible(spark: SparkSession, path: str, table: str, key: Column | None = None) -> DataFrame:
    """Committed rows; with a key only those of its part of each attempt, which prunes all other folders."""
    wanted, stale = F.lit(False), F.lit(False)
    live = _live(spark, path)
    for parts in sorted({r["parts"] for r in live}):
        mine = F.col("append_attempt").isin(sorted(r["attempt"] for r in live if r["parts"] == parts))
        wanted = wanted | (mine if key is None else mine & (F.col("key_part") == _part(key, parts)))
    for r in live:
        if r["stale"]:
            stale = stale | ((F.col("append_attempt") == r["attempt"]) & F.col("append_batch").isin(sorted(r["stale"])))
    return spark.read.parquet(f"{path}/{table}").where(wanted).where(~stale)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    return _visible(spark, path, "rows").drop(*_OWN)


def compact(spark: SparkSession, path: str) -> None:
    """Write all committed rows as one attempt that stands for every batch; what it replaces stays on disk, unread."""
    rows = _visible(spark, path, "rows").drop("append_attempt", "key_part")
    batches = [r["batch"] for r in spark.read.parquet(f"{path}/commits").select("batch").distinct().collect()]
    _write(rows, path, max(1, -(-rows.count() // PART_ROWS)), batches)


def stored_by_id(spark: SparkSession, path: str, document_id: int | str) -> DataFrame:
    """The document of an id: one part of each attempt is read."""
    key = F.lit(document_id)
    return _visible(spark, path, "rows", key).where(F.col("id") == key).drop(*_OWN)


def stored_by_name(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The newest document of a name, found in the narrow table of names and then by its id."""
    found = _visible(spark, path, "names", F.lit(name)).where(F.col("document_name") == name)
    newest = found.agg(F.max(F.struct("created_at", "id"))).first()[0]
    return stored_by_id(spark, path, newest["id"]) if newest else read_documents(spark, path).limit(0)


def list_documents(
    documents: DataFrame,
    skip: int = 0,
    limit: int = DEFAULT_LIMIT,
    document_type: str | None = None,
    processing_status: str | None = None,
    before: tuple | None = None,
) -> DataFrame:
    """One page of the newest documents. ``before`` = (created_at, id) of the last row seen pages by key, which costs
    the same at any depth; ``skip`` has to rank every row it leaves out."""
    if skip < 0 or not 1 <= limit <= MAX_LIMIT:
        raise ValueError("skip must not be negative and limit must lie between 1 and 100")
    if document_type:
        documents = documents.where(F.col("document_type") == document_type)
    if processing_status:
        documents = documents.where(F.col("processing_status") == processing_status)
    if before:
        stamp, last_id = F.lit(before[0]), F.lit(before[1])
        documents = documents.where(
            (F.col("created_at") < stamp) | ((F.col("created_at") == stamp) & (F.col("id") < last_id))
        )
    page = documents.select([c for c in SUMMARY_COLUMNS if c in documents.columns])
    page = page.orderBy(F.desc("created_at"), F.desc("id"))
    return (page.offset(skip) if skip else page).limit(limit)


def document_by_name(documents: DataFrame, name: str) -> DataFrame:
    """The newest document of that name."""
    return documents.where(F.col("document_name") == name).orderBy(F.desc("created_at"), F.desc("id")).limit(1)


def document_by_id(documents: DataFrame, document_id: int | str) -> DataFrame:
    return documents.where(F.col("id") == document_id)


def latest_documents(documents: DataFrame) -> DataFrame:
    """Newest version of every name: narrow keys are aggregated map-side, then each payload is joined once by its id."""
    keys = documents.groupBy("document_name").agg(F.max(F.struct("created_at", "id"))["id"].alias("id"))
    return documents.join(keys.select("id"), "id", "left_semi").select(*documents.columns)
