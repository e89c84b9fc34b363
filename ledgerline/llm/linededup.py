"""Line dedup that can be undone: sharded cuckoo filters over exact reference counts.

A line's key is the line without ASCII white space at its ends, A-Z in lower case. A key of at least LENGTH code points that
MIN_DOCS documents hold is repeated: it loses its lines in all documents but the one of the largest doc_id that holds it.

The state of a LineIndex is a folder of tables that are only written anew or added to:

- `postings`: one batch of (key, doc_id, text, line) for every insertion, where keys and texts are pairs of 64-bit hashes;
- `deletions`: the doc_ids that were taken out, with the number of the batch up to which that holds;
- `counts`: for every key the exact number of documents that hold it and the largest of them;
- `filters`: for every shard of keys a cuckoo filter of the fingerprints of its repeated keys.

`insert` adds the counts of a batch, `delete` takes those of documents away (and looks up the largest holder of their keys
anew); the keys that become repeated are then inserted in their shard's filter, those that no longer are are deleted from it.
Inserting after deleting gives the state as if it had never happened. A shard that overflows has all filters built again
from the counts, over twice the shards. `drops` sends postings to the filter of their shard, so only lines of probably repeated
keys go on to the exact counts, which decide; what a filter lets through by mistake is dropped there.

A document is a doc_id: its rows count once; null doc_ids are one document, smaller than all others. A null or empty text is
one empty line, and short keys are never dropped. Lines are told apart by 128 bits. Texts of any length are taken whole; an empty
table gives no rows. Columns of other names are ignored by the index and kept by `dedup`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import free_name, saved, small_batches, work_folder

LENGTH = 20
MIN_DOCS = 3
BLANKS = " \t\n\x0b\x0c\r"
#: Repeated keys that a shard is made for, and the slots of its filter: twice as many, four in a bucket.
SHARD_KEYS = 1 << 16
SLOTS = 4
#: A shard's postings are cut by document into so many pieces, each with a copy of its filter, so that a hot key is spread.
PIECES = 16
KICKS = 500


def key_of(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _pair(text: Column) -> list[Column]:
    """128 bits of a text as two integers."""
    return [F.xxhash64(text), F.xxhash64(F.lit(1), text)]


# --- cuckoo filters --------------------------------------------------------------------------------------------------


class Cuckoo:
    """Fingerprints of 16 bits in buckets of SLOTS; a key's second bucket follows from its first one and the fingerprint."""

    def __init__(self, table: np.ndarray):
        self.table, self.mask = table, len(table) - 1

    @classmethod
    def empty(cls, keys: int = SHARD_KEYS) -> "Cuckoo":
        buckets = 1 << max(2, (max(keys, 1) * 2 // SLOTS - 1).bit_length())
        return cls(np.zeros((buckets, SLOTS), np.uint16))

    @classmethod
    def load(cls, data: bytes) -> "Cuckoo":
        return cls(np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy())

    def dump(self) -> bytes:
        return self.table.tobytes()

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprint, first and second bucket of keys (64 bits each)."""
        keys = keys.view(np.uint64)
        prints = (keys >> np.uint64(48)).astype(np.int64)
        prints[prints == 0] = 1
        first = (keys & np.uint64(0xFFFFFFFF)).astype(np.int64) & self.mask
        return prints, first, first ^ self._step(prints)

    def _step(self, prints):
        return (prints * 0x5BD1E995 >> 7 | 1) & self.mask

    def contains(self, keys: np.ndarray) -> np.ndarray:
        prints, first, second = self.places(keys)
        of = prints.astype(np.uint16)[:, None]
        return (self.table[first] == of).any(axis=1) | (self.table[second] == of).any(axis=1)

    def insert(self, keys: np.ndarray) -> bool:
        """Add keys that are not in it yet; False if the filter is too full for all of them."""
        for mark, bucket, other in zip(*(x.tolist() for x in self.places(keys))):
            if not (self._put(bucket, mark) or self._put(other, mark) or self._kick(other, mark)):
                return False
        return True

    def _put(self, bucket: int, mark: int) -> bool:
        row = self.table[bucket]
        for slot in range(SLOTS):
            if not row[slot]:
                row[slot] = mark
                return True
        return False

    def _kick(self, bucket: int, mark: int) -> bool:
        for turn in range(KICKS):
            slot = (turn + mark) % SLOTS
            mark, self.table[bucket, slot] = int(self.table[bucket, slot]), mark
            bucket ^= int(self._step(mark))
            if self._put(bucket, mark):
                return True
        return False

    def delete(self, keys: np.ndarray) -> None:
        """Take out keys that are in it, one fingerprint each."""
        for mark, *buckets in zip(*(x.tolist() for x in self.places(keys))):
            for bucket in buckets:
                slots = np.flatnonzero(self.table[bucket] == mark)
                if len(slots):
                    self.table[bucket, slots[0]] = 0
                    break


def _change_filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (shard, change, key, filter) sorted by shard and change to (shard, filter): the old filter is a row with change
    null, deletions have -1, insertions 1. A filter that overflows is written as null."""
    shard, held, full = None, None, False
    pending: dict[int, list] = {-1: [], 1: []}

    def flush():
        nonlocal full
        for change, run in pending.items():
            if run and not full:
                keys = np.concatenate(run)
                if change < 0:
                    held.delete(keys)
                elif not held.insert(keys):
                    full = True
            run.clear()

    def result():
        flush()
        return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([None if full else held.dump()], pa.binary())], names=["shard", "filter"])

    for batch in batches:
        shards, changes, keys = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "change", "key"))
        filters = batch.column("filter")
        starts = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
        for a, b in zip(starts, starts[1:]):
            if a == b:
                continue
            if shards[a] != shard:
                if shard is not None:
                    yield result()
                shard, full, held = int(shards[a]), False, Cuckoo.empty()
            if filters[a].is_valid:
                held = Cuckoo.load(filters[a].as_py())
            for change in pending:
                run = keys[a:b][changes[a:b] == change]
                if len(run):
                    pending[change].append(run.astype(np.int64))
            flush()
    if shard is not None:
        yield result()


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard and piece, the filter first, to the postings whose key the filter may hold."""
    at, held = None, None
    for batch in batches:
        filters, postings = batch.column("filter"), batch.drop_columns(["filter"])
        shard, piece = (batch.column(c).to_numpy() for c in ("shard", "piece"))
        keys = batch.column("k1").fill_null(0).to_numpy()
        cuts = np.flatnonzero((np.diff(shard) != 0) | (np.diff(piece) != 0)) + 1
        starts = [0, *cuts.tolist(), len(shard)]
        keep = np.zeros(len(shard), bool)
        for a, b in zip(starts, starts[1:]):
            if a == b:
                continue
            if (shard[a], piece[a]) != at:
                at, held = (shard[a], piece[a]), None
            if filters[a].is_valid:
                held, a = Cuckoo.load(filters[a].as_py()), a + 1
            if held is not None and a < b:
                keep[a:b] = held.contains(keys[a:b])
        yield postings.filter(pa.array(keep))


# --- the index -------------------------------------------------------------------------------------------------------


class LineIndex:
    """Line dedup over a growing and shrinking set of documents; all state lies in the folder."""

    def __init__(self, spark: SparkSession, folder: str | None = None, shard_keys: int = SHARD_KEYS):
        small_batches(spark)
        self.spark, self.folder, self.shard_keys = spark, folder or work_folder(spark, "line-index"), shard_keys
        self.shards, self.step = 1, 0
        self.postings: list[tuple[int, DataFrame]] = []
        self.deletions: list[tuple[int, DataFrame]] = []
        self.counts: DataFrame | None = None
        self.filters: DataFrame | None = None

    def _saved(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}-{self.step}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _shard(self) -> Column:
        return F.pmod(F.col("k2"), F.lit(self.shards)).cast("bigint")

    def live(self) -> DataFrame:
        """Postings of the documents that are in the index."""
        found = None
        for step, batch in self.postings:
            for later, gone in self.deletions:
                if later > step:
                    batch = batch.join(gone, batch["doc_id"].eqNullSafe(gone["gone_id"]), "left_anti")
            found = batch if found is None else found.union(batch)
        return found

    @staticmethod
    def _counted(postings: DataFrame) -> DataFrame:
        """(k1, k2, n_docs, top_doc): the documents are told apart first, both steps combine before they shuffle."""
        once = postings.groupBy("k1", "k2", "doc_id").agg(F.count(F.lit(1)))
        return once.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("top_doc"))

    def insert(self, docs: DataFrame) -> None:
        """Add documents of (doc_id, text); the lines of a doc_id that is there already are added to it."""
        self.step += 1
        line = F.posexplode(F.transform(lines_of(F.col("text")), key_of)).alias("line", "key")
        keyed = docs.select("doc_id", *(c.alias(n) for c, n in zip(_pair(F.coalesce("text", F.lit(""))), ("t1", "t2"))), line).where(F.char_length("key") >= LENGTH)
        batch = self._saved(keyed.select(*(c.alias(n) for c, n in zip(_pair(F.col("key")), ("k1", "k2"))), "doc_id", "t1", "t2", "line"), "postings")
        earlier, self.postings = self.live(), [*self.postings, (self.step, batch)]
        if earlier is None:
            self._settle(self._counted(batch))
            return
        pairs = batch.groupBy("k1", "k2", "doc_id").agg(F.count(F.lit(1)).alias("n"))
        known = earlier.select(F.col("k1").alias("o1"), F.col("k2").alias("o2"), F.col("doc_id").alias("known_id"))
        fresh = pairs.join(known, (pairs["k1"] == known["o1"]) & (pairs["k2"] == known["o2"]) & pairs["doc_id"].eqNullSafe(known["known_id"]), "left_anti")
        added = fresh.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("top_doc"))
        both = self.counts.union(added).groupBy("k1", "k2").agg(F.sum("n_docs").alias("n_docs"), F.max("top_doc").alias("top_doc"))
        self._settle(both)

    def delete(self, ids: DataFrame) -> None:
        """Take out the documents of the ids in the first column."""
        self.step += 1
        ids = ids.toDF("gone_id").distinct()
        gone = self._saved(ids, "deletions")
        live = self.live()
        touched = live.join(gone, live["doc_id"].eqNullSafe(gone["gone_id"]), "left_semi").groupBy("k1", "k2").agg(F.lit(True).alias("touched"))
        self.deletions = [*self.deletions, (self.step, gone)]
        again = self._counted(self.live().join(touched, ["k1", "k2"], "left_semi"))
        self._settle(self.counts.join(touched, ["k1", "k2"], "left_anti").union(again))

    def _settle(self, counts: DataFrame) -> None:
        """Write the new counts, and carry the keys that cross MIN_DOCS over to the filters."""
        before, self.counts = self.counts, self._saved(counts, "counts")
        repeated = lambda df: df.where(F.col("n_docs") >= MIN_DOCS).select("k1", "k2")
        if self.filters is not None:
            now, was = repeated(self.counts), repeated(before)
            changes = now.join(was, ["k1", "k2"], "left_anti").withColumn("change", F.lit(1)).union(was.join(now, ["k1", "k2"], "left_anti").withColumn("change", F.lit(-1)))
            if self._write_filters(changes, self.filters):
                return
        self.shards = max(self.shards, -(-repeated(self.counts).count() // self.shard_keys))
        while not self._write_filters(repeated(self.counts).withColumn("change", F.lit(1)), None):
            self.shards *= 2

    def _write_filters(self, changes: DataFrame, old: DataFrame | None) -> bool:
        rows = changes.select(self._shard().alias("shard"), "change", F.col("k1").alias("key"), F.lit(None).cast("binary").alias("filter"))
        if old is not None:
            rows = rows.union(old.select("shard", F.lit(None).cast("int").alias("change"), F.lit(0).cast("bigint").alias("key"), "filter"))
        rows = rows.repartition("shard").sortWithinPartitions("shard", F.col("change").asc_nulls_first())
        written = self._saved(rows.mapInArrow(_change_filters, "shard bigint, filter binary"), f"filters-{self.shards}")
        if written.where(F.col("filter").isNull()).limit(1).count():
            return False
        self.filters = written
        return True

    def drops(self) -> DataFrame:
        """(doc_id, t1, t2, line) of every line that goes."""
        piece = lambda: F.sequence(F.lit(0), F.lit(PIECES - 1))
        filters = self.filters.select("shard", F.explode(piece()).alias("piece"), "filter")
        live = self.live().withColumn("shard", self._shard()).withColumn("piece", F.pmod(F.xxhash64("doc_id", "t1"), F.lit(PIECES)).cast("int"))
        names = ["k1", "k2", "doc_id", "t1", "t2", "line"]
        sent = filters.select("shard", "piece", "filter", *(F.lit(None).cast(live.schema[c].dataType).alias(c) for c in names))
        both = sent.union(live.select("shard", "piece", F.lit(None).cast("binary"), *names))
        both = both.repartition("shard", "piece").sortWithinPartitions("shard", "piece", F.col("filter").isNull())
        kinds = ", ".join(f"{c} {live.schema[c].dataType.simpleString()}" for c in ["shard", "piece", *names])
        hits = both.mapInArrow(_probe, kinds).drop("shard")
        repeated = self.counts.where(F.col("n_docs") >= MIN_DOCS).select("k1", "k2", "top_doc", F.explode(piece()).alias("piece"))
        return hits.join(repeated, ["k1", "k2", "piece"]).where(~F.col("doc_id").eqNullSafe(F.col("top_doc"))).select("doc_id", "t1", "t2", "line")


def dedup(docs: DataFrame, index: LineIndex | None = None) -> DataFrame:
    """docs with a struct column of n_lines, n_dropped and the kept text, by an index of docs or by the given one that holds them."""
    if index is None:
        index = LineIndex(docs.sparkSession)
        index.insert(docs.select("doc_id", "text"))
    by_text = index.drops().distinct().groupBy("doc_id", "t1", "t2").agg(F.collect_list("line").alias("dropped"))
    gone = saved(by_text.select(F.col("doc_id").alias("of_id"), "t1", "t2", "dropped"), "line-drops")
    h1, h2, o1, o2, own, list_name, out = (free_name(docs, x) for x in ("h1", "h2", "o1", "o2", "own_id", "dropped_lines", "lines"))
    gone = gone.toDF(own, o1, o2, list_name)
    first, second = _pair(F.coalesce("text", F.lit("")))
    keyed = docs.withColumn(h1, first).withColumn(h2, second)
    joined = keyed.join(gone, (F.col(h1) == F.col(o1)) & (F.col(h2) == F.col(o2)) & F.col("doc_id").eqNullSafe(F.col(own)), "left")
    lines = lines_of(F.col("text"))
    places = F.sequence(F.lit(0), F.size(lines) - 1)
    kept = F.when(F.col(list_name).isNull(), F.coalesce("text", F.lit(""))).otherwise(
        F.array_join(F.transform(F.array_except(places, F.col(list_name)), lambda i: F.get(lines, i)), "\n")
    )
    found = F.struct(F.size(lines).cast("bigint").alias("n_lines"), F.coalesce(F.size(list_name), F.lit(0)).cast("bigint").alias("n_dropped"), kept.alias("text"))
    return joined.select(*docs.columns, found.alias(out))
