"""Exact substring dedup by fixed-block anchors: every word covered by a repeated window of words goes.

A text is cut into reference blocks of BLOCK words that do not overlap. A window of `window` words always contains a whole
block if BLOCK is at most (window + 1) / 2, so both occurrences of a repeat contain a block that the other one's rolling
windows meet.

1. Probe: every rolling window of BLOCK words is hashed; a batch of texts sends its hashes, sorted, at most two of each, to
   buckets whose number follows the input, with the hashes of its blocks. A bucket names the block hashes met twice or more.
2. The named hashes are joined back with the blocks (row by row, so that Spark can split a hot hash).
3. Extend: around the hit blocks of a text, every window of `window` words is hashed with over 64 bits; counts are summed in
   buckets as before, and windows met twice or more are exact repeats. Runs of them are the maximal repeats.
4. What repeats in a bucket is joined back to the batches that asked, and the words that it covers are removed.

Anchors only choose what is looked at in step 3; a false hit costs work and changes nothing. No pair of occurrences is ever
formed, so groups of copies cost what their words cost. Null texts have no words; a repeated row is one more occurrence of
all its windows; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import saved, text_bytes

WINDOW = 35
BLOCK = 18
#: Words of a batch, and rolling windows of a bucket, about.
BATCH, BUCKET = 500_000, 200_000
_LOW = 24
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9))
_BASES = (0x2545F4914F6CDD1D, 0xD1342543DE82EF95)


class _Words(dict):
    """64-bit hashes of words; a cache of bounded size."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = x = xxhash.xxh64_intdigest(word)
        return x


class Rolling:
    """Hashes of all runs of k words, by a polynomial over 64-bit words: prefix sums make every run's hash one difference."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.powers = self.inverses = np.ones(1, dtype=np.uint64)

    def __call__(self, words: np.ndarray, k: int) -> np.ndarray:
        n = len(words)
        if n < k:
            return np.zeros(0, dtype=np.uint64)
        if len(self.powers) < n:
            size = max(n, 4096) * 2
            factors = np.full((2, size), 1, dtype=np.uint64)
            factors[:, 1:] = np.array([[self.base], [self.inverse]], dtype=np.uint64)
            self.powers, self.inverses = np.cumprod(factors, axis=1, dtype=np.uint64)
        sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(words * self.powers[:n], dtype=np.uint64)))
        x = (sums[k:] - sums[:-k]) * self.inverses[: n - k + 1]
        x = (x ^ (x >> np.uint64(31))) * _MIX[1]
        return (x ^ (x >> np.uint64(29))) * _MIX[0]


class Hasher:
    def __init__(self):
        self.words, self.rolling = _Words(), [Rolling(b) for b in _BASES]

    def of(self, text: bytes) -> np.ndarray:
        words = text.split()
        return np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))


def _packed(values: np.ndarray) -> bytes:
    """Sorted codes as compressed differences, bytes of equal rank together."""
    steps = np.diff(values.astype(np.uint32), prepend=np.uint32(0))
    return zstandard.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), dtype=np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint32).reshape(-1), dtype=np.uint32)


def _at_most_two(values: np.ndarray) -> np.ndarray:
    """Sorted values, of equal ones two at most."""
    values = np.sort(values)
    return values if len(values) < 3 else np.concatenate((values[:2], values[2:][values[2:] != values[:-2]]))


def _twice(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return np.unique(values[1:][values[1:] == values[:-1]])


def _anchor_codes(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """A bucket number and the low bits of the hash, as one number."""
    bucket = (hashes >> np.uint64(_LOW)) % np.uint64(buckets)
    return ((bucket << np.uint64(_LOW)) | (hashes & np.uint64((1 << _LOW) - 1))).astype(np.int64)


def _cut(codes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Sorted codes by bucket."""
    bucket = codes >> _LOW
    starts = np.flatnonzero(np.diff(bucket, prepend=-1))
    for start, end in zip(starts.tolist(), [*starts[1:].tolist(), len(codes)]):
        yield int(bucket[start]), codes[start:end] & ((1 << _LOW) - 1)


def _prober(buckets: int):
    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()

        def rows(rolled: list[np.ndarray]) -> pa.RecordBatch:
            windows = _at_most_two(np.concatenate(rolled))
            blocks = dict(_cut(np.unique(np.concatenate([r[::BLOCK] for r in rolled]))))
            cut = list(_cut(windows))
            return pa.RecordBatch.from_arrays(
                [pa.array([b for b, _ in cut], pa.int64()), pa.array([_packed(x) for _, x in cut], pa.binary()), pa.array([_packed(blocks[b]) if b in blocks else None for b, _ in cut], pa.binary())],
                names=["bucket", "windows", "blocks"],
            )

        held, size = [], 0
        for batch in batches:
            for text in text_bytes(batch.column(0)):
                codes = _anchor_codes(hasher.rolling[0](hasher.of(text), BLOCK), buckets)
                if len(codes):
                    held.append(codes)
                    size += len(codes)
                if size >= BATCH:
                    yield rows(held)
                    held, size = [], 0
        if held:
            yield rows(held)

    return probe


def _met(group: pa.Table) -> pa.Table:
    """The block codes of a bucket that two or more rolling windows have."""
    twice = _twice(np.concatenate([_unpacked(x) for x in group.column("windows").to_pylist()]))
    parts = [_unpacked(x) for x in group.column("blocks").to_pylist() if x]
    blocks = np.unique(np.concatenate(parts)) if parts else np.zeros(0, dtype=np.uint32)
    bucket = group.column("bucket")[0].as_py()
    return pa.table({"code": pa.array((np.intersect1d(twice, blocks, assume_unique=True).astype(np.int64)) | (bucket << _LOW), pa.int64())})


def _block_codes(buckets: int):
    @F.arrow_udf("array<bigint>")
    def codes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hasher = Hasher()
        for texts in batches:
            parts = [texts.slice(i, 256) for i in range(0, len(texts), 256)]
            yield pa.concat_arrays([pa.array([_anchor_codes(hasher.rolling[0](hasher.of(t), BLOCK)[::BLOCK], buckets) for t in text_bytes(p)], pa.list_(pa.int64())) for p in parts])

    return codes


def _candidates(words: int, blocks: list[int], window: int) -> np.ndarray:
    """Starts of the windows that contain a hit block."""
    starts = np.asarray(blocks, dtype=np.int64) * BLOCK
    at = np.unique((starts[:, None] - np.arange(window - BLOCK + 1)[None, :]).reshape(-1))
    return at[(at >= 0) & (at <= words - window)]


class Windows:
    """Hashes and buckets of a text's candidate windows."""

    def __init__(self, buckets: int, window: int):
        self.hasher, self.buckets, self.window = Hasher(), np.uint64(buckets), window

    def of(self, text: bytes, blocks: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        words = self.hasher.of(text)
        at = _candidates(len(words), blocks, self.window)
        first, second = self.hasher.rolling
        return at, first(words, self.window)[at] if len(at) else np.zeros(0, np.uint64), second(words, self.window)[at] % self.buckets if len(at) else np.zeros(0, np.uint64)

    def batches(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        """(row numbers, starts, hashes, buckets) of about BATCH candidates each; rows are (row_no, body, blocks)."""
        held, size = [], 0
        for batch in batches:
            for no, body, blocks in zip(*(batch.column(i).to_pylist() for i in range(3))):
                at, hashes, bucket = self.of(zstandard.decompress(body), blocks)
                if len(at):
                    held.append((np.full(len(at), no, dtype=np.int64), at, hashes, bucket.astype(np.int64)))
                    size += len(at)
                if size >= BATCH:
                    yield tuple(map(np.concatenate, zip(*held)))
                    held, size = [], 0
        if held:
            yield tuple(map(np.concatenate, zip(*held)))


def _by_bucket(bucket: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    order = np.argsort(bucket, kind="stable")
    starts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    ends = np.append(starts[1:], len(bucket))
    return order, list(zip(bucket[order][starts].tolist(), starts.tolist(), ends.tolist()))


def _counter(buckets: int, window: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, hashes, bucket in Windows(buckets, window).batches(batches):
            order, cuts = _by_bucket(bucket)
            data = [_at_most_two(hashes[order[a:b]]).tobytes() for _, a, b in cuts]
            yield pa.RecordBatch.from_arrays([pa.array([c[0] for c in cuts], pa.int64()), pa.array(data, pa.binary())], names=["bucket", "hashes"])

    return count


def _repeated(group: pa.Table) -> pa.Table:
    twice = _twice(np.concatenate([np.frombuffer(x, dtype=np.uint64) for x in group.column("hashes").to_pylist()]))
    return pa.table({"bucket": group.column("bucket")[:1], "repeated": pa.array([twice.tobytes()], pa.binary())})


def _pack_places(rows: np.ndarray, starts: np.ndarray, base: int) -> bytes:
    """Row numbers (from base on, in order) and starts, as compressed differences with bytes of equal rank together."""
    steps = np.stack((np.diff(rows, prepend=base), starts)).astype(np.int64)
    return zstandard.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(2, -1, 8).transpose(0, 2, 1)).tobytes(), 1)


def _unpack_places(data: bytes, base: int) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zstandard.decompress(data), dtype=np.uint8).reshape(2, 8, -1)
    steps = np.ascontiguousarray(planes.transpose(0, 2, 1)).view(np.int64).reshape(2, -1)
    return base + np.cumsum(steps[0]), steps[1]


def _asker(buckets: int, window: int):
    """A row for each batch and bucket; base, the first row of the batch, names the batch."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, at, hashes, bucket in Windows(buckets, window).batches(batches):
            order, cuts = _by_bucket(bucket)
            base = int(rows[0])
            parts = [order[a:b] for _, a, b in cuts]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([c[0] for c in cuts], pa.int64()),
                    pa.array([base] * len(cuts), pa.int64()),
                    pa.array([hashes[p].tobytes() for p in parts], pa.binary()),
                    pa.array([_pack_places(rows[p], at[p], base) for p in parts], pa.binary()),
                ],
                names=["bucket", "base", "hashes", "places"],
            )

    return ask


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by bucket, the bucket's repeated hashes first, the asked places whose windows are repeated.

    One bucket's list is held at a time, and it is sent once, whatever the number of batches that ask.
    """
    own, known = None, None
    for batch in batches:
        bases, found = [], []
        for i, (bucket, base) in enumerate(zip(batch.column("bucket").to_pylist(), batch.column("base").to_pylist())):
            if base is None:
                own, known = bucket, np.frombuffer(batch.column("hashes")[i].as_py(), dtype=np.uint64)
                continue
            if own != bucket:  # nothing repeated here
                continue
            asked = np.frombuffer(batch.column("hashes")[i].as_buffer(), dtype=np.uint64)
            hit = known[np.minimum(np.searchsorted(known, asked), len(known) - 1)] == asked
            if hit.any():
                rows, starts = _unpack_places(batch.column("places")[i].as_buffer(), base)
                bases.append(base)
                found.append(_pack_places(rows[hit], starts[hit], base))
        yield pa.RecordBatch.from_arrays([pa.array(bases, pa.int64()), pa.array(found, pa.binary())], names=["base", "places"])


def answers_of(asked: DataFrame, repeated: DataFrame) -> DataFrame:
    """(base, places) of the repeated windows: both sides meet by sorting within their bucket, neither is copied."""
    known = repeated.select("bucket", F.lit(None).cast("bigint").alias("base"), F.col("repeated").alias("hashes"), F.lit(None).cast("binary").alias("places"))
    both = known.union(asked.select("bucket", "base", "hashes", "places")).repartition("bucket")
    return both.sortWithinPartitions("bucket", F.col("base").asc_nulls_first()).mapInArrow(_answer, "base bigint, places binary")


def _by_row(group: pa.Table) -> pa.Table:
    """The answers to a batch (bounded by BATCH), as one binary of starts for each of its rows."""
    base = group.column("base")[0].as_py()
    rows, starts = map(np.concatenate, zip(*(_unpack_places(x, base) for x in group.column("places").to_pylist())))
    order, cuts = _by_bucket(rows)
    starts = starts[order].astype(np.int32)
    return pa.table({"row_no": pa.array([c[0] for c in cuts], pa.int64()), "starts": pa.array([starts[a:b].tobytes() for _, a, b in cuts], pa.binary())})


def removed_mask(words: int, starts: np.ndarray, window: int) -> np.ndarray:
    """Which words a window covers that begins at one of the starts."""
    change = np.zeros(words + 1, dtype=np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + window, -1)
    return np.cumsum(change[:-1]) > 0


def _described():
    """Number of words, hash of the words joined by a space, and the compressed text."""

    @F.arrow_udf("struct<n_words: bigint, sha256: string, body: binary>")
    def describe(texts: pa.Array) -> pa.Array:
        rows = []
        for i in range(len(texts)):
            text = text_bytes(texts.slice(i, 1))[0]
            words = text.split()
            rows.append({"n_words": len(words), "sha256": hashlib.sha256(b" ".join(words)).hexdigest(), "body": zstandard.compress(text, 1)})
        return pa.array(rows, pa.struct([("n_words", pa.int64()), ("sha256", pa.string()), ("body", pa.binary())]))

    return describe


def _remover(window: int):
    @F.arrow_udf("struct<kept: string, n_removed: bigint>")
    def remove(bodies: pa.Array, starts: pa.Array) -> pa.Array:
        rows = []
        for body, at in zip(bodies.to_pylist(), starts.to_pylist()):
            if not at:  # no repeat: kept as it is
                rows.append(None)
                continue
            words = zstandard.decompress(body).split()
            gone = removed_mask(len(words), np.frombuffer(at, dtype=np.int32).astype(np.int64), window)
            rows.append({"kept": b" ".join(w for w, g in zip(words, gone.tolist()) if not g).decode("utf-8", "replace"), "n_removed": int(gone.sum())})
        return pa.array(rows, pa.struct([("kept", pa.string()), ("n_removed", pa.int64())]))

    return remove


def dedup(docs: DataFrame, window: int = WINDOW, bucket: int = BUCKET) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay joined by one space; null where nothing goes) and kept_sha256."""
    if BLOCK > (window + 1) // 2:
        raise ValueError(f"a window needs {2 * BLOCK - 1} words at least")
    docs = docs.select("doc_id", "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, math.ceil(size / 6 / bucket))
    key = [F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-1)).alias("k1"), F.xxhash64("doc_id", "text").alias("k2")]
    probes = docs.select("text").mapInArrow(_prober(buckets), "bucket bigint, windows binary, blocks binary")
    met = saved(probes.groupBy("bucket").applyInArrow(_met, "code bigint"), "substring-met")
    blocks = docs.select(*key, F.posexplode(_block_codes(buckets)("text")).alias("block", "code"))
    hits = blocks.join(met, "code", "left_semi").groupBy("k1", "k2").agg(F.collect_set("block").alias("hit"))
    facts = docs.select("doc_id", *key, _described()("text").alias("d")).select("doc_id", "k1", "k2", "d.*")
    held = facts.join(hits, ["k1", "k2"], "left").withColumn("body", F.when(F.col("hit").isNotNull(), F.col("body"))).drop("k1", "k2")
    held = saved(held.withColumn("row_no", F.monotonically_increasing_id()), "substring-held")
    asking = held.where(F.col("hit").isNotNull()).select("row_no", "body", "hit")
    counts = asking.mapInArrow(_counter(buckets, window), "bucket bigint, hashes binary")
    repeated = saved(counts.groupBy("bucket").applyInArrow(_repeated, "bucket bigint, repeated binary").where(F.length("repeated") > 0), "substring-repeated")
    asked = asking.mapInArrow(_asker(buckets, window), "bucket bigint, base bigint, hashes binary, places binary")
    starts = answers_of(asked, repeated).groupBy("base").applyInArrow(_by_row, "row_no bigint, starts binary")
    out = held.join(starts, "row_no", "left").withColumn("cut", _remover(window)("body", "starts"))
    return out.select("doc_id", "n_words", F.coalesce("cut.n_removed", F.lit(0)).cast("bigint").alias("n_removed"), F.col("cut.kept").alias("kept"), F.coalesce(F.sha2("cut.kept", 256), "sha256").alias("kept_sha256"))
