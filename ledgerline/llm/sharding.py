"""Shards of near-equal bytes by sampled splitters.

The key of a record is (hash of its text, doc_id, row number), so equal texts stand side by side and share a shard unless
their group straddles a cut. A sample of keys, drawn with a chance in proportion to the record's weight, gives the quantile
boundaries of many fine ranges; the exact weight of each range is then summed, and every range that is overfull, or holds
one of the cuts between shards, is sampled again and subdivided, down to single records where need be (a hot text divides
by doc_id, repeated rows by row number). Shards are runs of whole fine ranges. Only boundaries and sums per range, whose
number is bounded by MAX_RANGES, reach the driver.

Null texts count no bytes and form one group with empty ones; null doc_ids sort first; repeated rows are all placed; an
empty table gives an empty result. Columns of docs are kept as they are.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import free_name, saved

SHARDS = 24
#: A record weighs its UTF-8 bytes and so much besides.
OVERHEAD = 8
#: Fine ranges per shard at least, rows of a fine range at most, and what their number may reach.
RANGES_PER_SHARD, ROWS_PER_RANGE, MAX_RANGES = 32, 500_000, 200_000
#: Keys sampled for each boundary that is wanted.
SAMPLES = 12
ROUNDS = 4
_LEAST = -(1 << 63)

Key = tuple[int, int, int]


def size_of(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("bigint")


def range_numbers(keys: np.ndarray, splitters: np.ndarray) -> np.ndarray:
    """How many of the sorted splitters (n x 3) are at most each key (m x 3)."""

    def search(at: np.ndarray, low: int, high: int, column: int) -> np.ndarray:
        part = splitters[low:high, column]
        left = low + np.searchsorted(part, keys[at, column], "left")
        right = low + np.searchsorted(part, keys[at, column], "right")
        out = right.copy()
        tied = np.flatnonzero(left < right)
        if column < 2 and len(tied):
            order = tied[np.argsort(left[tied], kind="stable")]
            for group in np.split(order, np.flatnonzero(np.diff(left[order])) + 1):
                out[group] = search(at[group], left[group[0]], right[group[0]], column + 1)
        return out

    return search(np.arange(len(keys)), 0, len(splitters), 0)


def _ranger(splitters: list[Key], spark):
    table = spark.sparkContext.broadcast(np.array(splitters, dtype=np.int64).reshape(-1, 3))

    @F.arrow_udf("int")
    def number(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for columns in batches:
            keys = np.stack([c.to_numpy(zero_copy_only=False) for c in columns], axis=1)
            yield pa.array(range_numbers(keys, table.value), pa.int32())

    return number("key_text", "key_id", "key_row")


def place(keyed: DataFrame, shards: int) -> tuple[list[Key], list[int], list[int]]:
    """Splitters of the fine ranges, and the shard and first slot of each range."""
    spark = keyed.sparkSession
    total, rows = keyed.agg(F.sum("size"), F.count(F.lit(1))).first()
    if not rows:
        return [], [0], [0]
    weight = F.col("size") / float(total) + F.lit(1.0 / rows)  # both sums are 1, so that ranges are bounded in bytes and in rows
    wanted = min(MAX_RANGES // 2, max(shards * RANGES_PER_SHARD, rows // ROWS_PER_RANGE))
    full = 2.0 / wanted
    splitters: list[Key] = []
    open_ranges: dict[int, int] = {0: wanted}
    for step in range(ROUNDS + 1):
        ranged = keyed.withColumn("range_no", _ranger(splitters, spark)) if splitters else keyed.withColumn("range_no", F.lit(0))
        sums = {r["range_no"]: r for r in ranged.groupBy("range_no").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"), F.sum(weight).alias("w")).collect()}
        numbers = range(len(splitters) + 1)
        ends, done = [], 0
        for no in numbers:
            done += sums[no]["bytes"] if no in sums else 0
            ends.append(done)
        if step:
            cuts = {bisect.bisect_left(ends, total * s / shards) for s in range(1, shards)}
            open_ranges = {no: max(2, round(2 * sums[no]["w"] / full)) for no in sums if sums[no]["w"] > 2 * full}
            open_ranges |= {no: max(open_ranges.get(no, 0), 16) for no in cuts if no in sums and sums[no]["n"] > 1}
        if step == ROUNDS or not open_ranges or len(splitters) > MAX_RANGES:
            break
        rates = [(no, float(k * SAMPLES / sums[no]["w"])) for no, k in open_ranges.items()]
        drawn = ranged.join(F.broadcast(spark.createDataFrame(rates, "range_no int, rate double")), "range_no")
        chance = F.pmod(F.xxhash64("key_text", "key_id", "key_row", F.lit(step)), F.lit(1 << 40)) / float(1 << 40)
        sample = drawn.where(chance < F.col("rate") * weight).select("range_no", "key_text", "key_id", "key_row").collect()
        by_range: dict[int, list[Key]] = {}
        for r in sample:
            by_range.setdefault(r["range_no"], []).append((r["key_text"], r["key_id"], r["key_row"]))
        new = set(splitters)
        for no, keys in by_range.items():
            keys.sort()
            parts = open_ranges[no]
            new |= {keys[len(keys) * i // parts] for i in range(1, parts)}
        if len(new) == len(splitters):
            break
        splitters = sorted(new)
    shard, slot, shard_of, first, before = 0, 0, [], [], 0
    for no in numbers:
        middle = (before + ends[no]) / 2
        now = max(shard, min(shards - 1, int(middle * shards / total)))
        slot = slot if now == shard else 0
        shard = now
        shard_of.append(shard)
        first.append(slot)
        slot += sums[no]["n"] if no in sums else 0
        before = ends[no]
    return splitters, shard_of, first


def assign(docs: DataFrame, shards: int = SHARDS, carry: list[str] | None = None) -> DataFrame:
    """The carried columns of docs (all by default) and a last struct column: size, text_crc32, shard, slot (from 0, gapless).

    What is carried is saved once with keys (the row number makes repeated rows distinct and has to stay as it is); the passes for
    sums and samples read the narrow key columns of that table alone.
    """
    spark = docs.sparkSession
    carried = docs.columns if carry is None else carry
    body = F.struct(*(F.col(c) for c in carried)).alias("doc")
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = saved(
        docs.select(
            body,
            F.xxhash64(text).alias("key_text"),
            F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LEAST)).alias("key_id"),
            F.monotonically_increasing_id().alias("key_row"),
            size_of(F.col("text")).alias("size"),
            F.crc32(text.cast("binary")).alias("crc"),
        ),
        "shard-keys",
    )
    splitters, shard_of, first = place(keyed.select("key_text", "key_id", "key_row", "size"), shards)
    ranges = spark.createDataFrame(list(zip(range(len(shard_of)), shard_of, first)), "range_no int, shard int, first bigint")
    ranged = keyed.withColumn("range_no", _ranger(splitters, spark)) if splitters else keyed.withColumn("range_no", F.lit(0))
    inside = Window.partitionBy("range_no").orderBy("key_text", "key_id", "key_row")
    numbered = ranged.withColumn("at", F.row_number().over(inside) - 1).join(F.broadcast(ranges), "range_no")
    name = free_name(docs, "shard")
    placed = F.struct("size", F.col("crc").alias("text_crc32"), "shard", (F.col("first") + F.col("at")).alias("slot")).alias(name)
    return numbered.select("doc.*", placed)
