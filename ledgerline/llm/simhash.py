"""Near-duplicate documents: SimHash fingerprints, a byte-position inverted index with count filtering, components.

A fingerprint has eight positional bytes. Two fingerprints that differ in at most two bits share at least six of them, so
among the four pairs of neighbouring positions at least two pairs are shared whole. The index therefore lists fingerprints
under each of the six choices of two pairs (four positional bytes together), which keeps lists short where a list under one
byte would hold a 256th of everything. Pairs that meet in a list have their shared positional bytes tallied, are retained
from six on, and verified by their differing bits. A list of more than LONG fingerprints is never paired up: its members go
under the values that differ from them in no or one bit, and members under one value (they differ in two bits at most, and
all such pairs meet somewhere) are linked to the smallest of them. No link is lost, and rows stay linear in members.

Copies further apart than that (keep_one_of_copies, for pipelines) are found by longer fingerprints of the same kind.

Null and empty texts have fingerprint zero; repeated rows link like other copies; a component without any non-null doc_id
has a null component_id; an empty table gives an empty result.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from ledgerline.llm.common import free_name, saved, text_bytes

SEED = 42
MAX_BITS = 2
SHARED_BYTES = 8 - MAX_BITS
LONG = 16
#: Wide fingerprints: words of 64 bits, and bits that may differ.
WORDS, WIDE_BITS = 4, 40
#: Texts whose shingle counts have at least this cosine meet under a shingle; those of at most WHOLE shingles, where they share any.
COSINE, WHOLE = 0.65, 64
#: Shingles of one text in COMMON, and of LEAST texts, are frequent and put last, the most frequent at the end; that orders them and leaves none out.
COMMON, LEAST = 1000, 5
#: Counters of a task that looks for frequent shingles (16 MB), and texts it should see at least.
COUNTERS, TEXTS_A_TASK = 1 << 22, 5000
#: Low bits of a listed value that name the text; the others name the shingle.
TEXT_BITS = 28
#: Rounds that thin out the edges before components are looked for.
SMALL_STARS = 3
#: Each row goes under as many choices of three positional bytes; above about 1e9 different texts take four a choice.
CHOICES = [sorted(random.Random(i).sample(range(8 * WORDS), 3)) for i in range(64)]
_PAIR = 0xFFFF
#: Masks of two of the four pairs of positions.
MASKS = [(_PAIR << 16 * i) | (_PAIR << 16 * j) for i in range(4) for j in range(i + 1, 4)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits."""
    total = np.zeros(64, dtype=np.int64)
    for start in range(0, len(hashes), 255):  # at most 255, so that counters of one byte do not overflow
        bits = np.unpackbits(hashes[start : start + 255].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.view(np.uint64).sum(axis=0, dtype=np.uint64).view(np.uint8)
    return total


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """Hashes of the shingles of a text, repeats included; the whole of a text of fewer words, none of a text of none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[: 1 - size].tolist(), ends[size - 1 :].tolist())
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in spans], dtype=np.uint64)


def simhash(text: bytes, size: int = 3) -> int:
    """Unsigned fingerprint of a text's word shingles."""
    hashes = shingle_hashes(text, size)
    if not len(hashes):
        return 0
    over = bit_counts(hashes) * 2 > len(hashes)
    return int(np.packbits(over, bitorder="little").view(np.uint64)[0])


@F.arrow_udf(LongType())
def fingerprint_of(texts: pa.Array) -> pa.Array:
    return pa.array((_signed(simhash(t)) for t in text_bytes(texts)), pa.int64())


def as_hex(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def _shared_bytes(xor: Column) -> Column:
    same = [(xor.bitwiseAND(F.lit(_signed(0xFF << 8 * i))) == 0).cast("int") for i in range(8)]
    return sum(same[1:], same[0])


def links(prints: DataFrame) -> DataFrame:
    """Edges (a, b) between distinct fingerprints; they connect exactly what links of at most MAX_BITS bits connect."""
    keys = F.array(*(F.struct(F.lit(i).alias("mask"), F.col("fingerprint").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(MASKS)))
    index = prints.select("fingerprint", F.explode(keys).alias("at")).select("fingerprint", "at.mask", "at.key")
    lists = index.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    index = saved(index.join(lists, ["mask", "key"]), "simhash-index")
    short = index.where(F.col("n") <= LONG)
    xor = F.col("a").bitwiseXOR(F.col("b"))
    a, b = (short.select("mask", "key", F.col("fingerprint").alias(x)) for x in ("a", "b"))
    found = a.join(b, ["mask", "key"]).where((F.col("a") < F.col("b")) & (_shared_bytes(xor) >= SHARED_BYTES) & (F.bit_count(xor) <= MAX_BITS))
    crowded = index.where(F.col("n") > LONG).select("fingerprint").distinct()
    flips = F.array(F.lit(0).cast("bigint"), *(F.lit(_signed(1 << i)) for i in range(64)))
    near = saved(crowded.select("fingerprint", F.explode(flips).alias("flip")).select("fingerprint", F.col("fingerprint").bitwiseXOR(F.col("flip")).alias("value")), "simhash-values")
    hubs = near.groupBy("value").agg(F.min("fingerprint").alias("b"), F.max("fingerprint").alias("top")).where("b < top").select("value", "b")
    starred = near.join(hubs, "value").where("fingerprint > b").select(F.col("fingerprint").alias("a"), "b")
    return found.select("a", "b").unionByName(starred).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge: smallest labels spread along edges, and labels jump to their label's label."""
    both = saved(edges.select("a", "b").union(edges.select("b", "a")).toDF("node", "other"), "graph-edges")
    labels = saved(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("root")), "graph-labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), F.col("root").alias("seen")), "other").groupBy("node").agg(F.min("seen").alias("seen"))
        spread = saved(labels.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "seen").alias("root")), "graph-spread")
        if spread.where("root < old").isEmpty():
            return labels
        up = spread.select(F.col("node").alias("root"), F.col("root").alias("top"))
        labels = saved(spread.join(up, "root").select("node", F.col("top").alias("root")), "graph-labels")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, fp (long), fingerprint (hex), root (its component's fingerprint), component_id."""
    prints = saved(docs.select("doc_id", fingerprint_of("text").alias("fp")), "simhash-prints")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    distinct = saved(distinct.withColumnRenamed("fp", "fingerprint"), "simhash-distinct")
    roots = components(links(distinct.select("fingerprint"))).withColumnRenamed("node", "fingerprint")
    rooted = distinct.join(roots, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    rooted = saved(rooted, "simhash-roots")
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = saved(rooted.join(smallest, "root").select(F.col("fingerprint").alias("fp"), "root", "component_id"), "simhash-classes")
    return prints.join(classes, "fp").select("doc_id", "fp", as_hex(F.col("fp")).alias("fingerprint"), "root", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of docs of each component, that of the smallest doc_id, with docs' own columns."""
    rows = saved(near_duplicates(docs), "simhash-rows")
    best = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp")).alias("best"))
    fp, idn, fpn = (free_name(docs, x) for x in ("fp_now", "id_kept", "fp_kept"))
    stays = best.select(F.col("best.doc_id").alias(idn), F.col("best.fp").alias(fpn))
    held = docs.join(stays.select(idn).distinct(), F.col("doc_id").eqNullSafe(F.col(idn)), "left_semi")
    held = held.withColumn(fp, fingerprint_of("text"))
    held = held.join(stays, F.col("doc_id").eqNullSafe(F.col(idn)) & (F.col(fp) == F.col(fpn)), "left_semi")
    return held.dropDuplicates(["doc_id", fp]).select(*docs.columns)


# ---- near copies further apart than MAX_BITS: wide fingerprints


def mixed(hashes: np.ndarray, word: int) -> np.ndarray:
    """The hashes of one more family, by multiplying and shifting."""
    x = (hashes ^ (hashes >> np.uint64(31))) * np.uint64((0x9E3779B97F4A7C15 * (2 * word + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def wide_simhash(text: bytes, size: int = 3) -> np.ndarray:
    """WORDS unsigned 64-bit words of fingerprint of a text's word shingles; zeros without a word."""
    hashes = shingle_hashes(text, size)
    if not len(hashes):
        return np.zeros(WORDS, dtype=np.uint64)
    counts = np.concatenate([bit_counts(mixed(hashes, i)) for i in range(WORDS)])
    return np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)


@F.arrow_udf(ArrayType(LongType()))
def wide_fingerprint_of(texts: pa.Array) -> pa.Array:
    return pa.array([wide_simhash(t).view(np.int64).tolist() for t in text_bytes(texts)], pa.list_(pa.int64()))


def _tree_edges(prints: np.ndarray, ids: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect the prints of a list exactly as all pairs of at most WIDE_BITS bits do: from each to the smallest it is connected with."""
    edges, left = [], np.arange(len(prints))
    while len(left):
        todo, left = [int(left[0])], left[1:]
        group = list(todo)
        while todo and len(left):
            at = todo.pop()
            near = np.bitwise_count(prints[left] ^ prints[at]).sum(axis=1) <= WIDE_BITS
            found = left[near].tolist()
            group += found
            todo += found
            left = left[~near]
        nodes = ids[group]
        least = int(nodes.min())
        edges += [(x, least) for x in nodes.tolist() if x != least]
    return edges


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of the lists in rows sorted by their key; one list is held at a time, 48 bytes a member."""
    key, held = None, []

    def edges_of(parts: list) -> list[tuple[int, int]]:
        if sum(len(ids) for ids, _ in parts) < 2:
            return []
        ids, prints = (np.concatenate([part[i] for part in parts]) for i in (0, 1))
        if len(ids) > 64:  # equal lists of several tasks come under one key
            ids, first = np.unique(ids, return_index=True)
            prints = prints[first]
        return _tree_edges(prints, ids)

    for batch in batches:
        if not batch.num_rows:
            continue
        keys, ids = batch.column("key").to_numpy(), batch.column("node").to_numpy()
        prints = np.stack([batch.column(f"w{i}").to_numpy() for i in range(WORDS)], axis=1).view(np.uint64)
        starts = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1))
        ends = np.append(starts[1:], len(keys))
        out = []
        many = (ends - starts > 1) | (starts == 0) | (ends == len(keys))  # a list of one row inside a batch meets nobody
        for a, b in zip(starts[many].tolist(), ends[many].tolist()):
            if key is not None and keys[a] != key:
                out += edges_of(held)
                held = []
            key = keys[a]
            held.append((ids[a:b].copy(), prints[a:b].copy()))
        if out:
            yield _edge_batch(out)
    if held:
        yield _edge_batch(edges_of(held))


def _edge_batch(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([e[i] for e in edges], pa.int64()) for i in (0, 1)], names=["a", "b"])


def listed(text: bytes, text_key: int, last: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Values under which a text is listed: one for each shingle of its prefix, with the text's TEXT_BITS below.

    Every text orders its shingles alike: by hash, those of last (sorted) behind, by their ranks. What is behind the prefix has
    a norm under COSINE of the whole, so of two texts with that cosine each has the first shingle they share in its prefix.
    """
    shingles, counts = np.unique(shingle_hashes(text, 3), return_counts=True)
    if len(shingles) > WHOLE:
        if len(last):
            at = np.minimum(np.searchsorted(last, shingles), len(last) - 1)
            order = np.argsort(np.where(last[at] == shingles, ranks[at] + 1, 0), kind="stable")
            shingles, counts = shingles[order], counts[order]
        mass = np.cumsum(counts.astype(np.float64) ** 2)
        shingles = shingles[: int(np.searchsorted(mass, (1 - COSINE**2) * mass[-1], side="right")) + 1]
    low = np.uint64((1 << TEXT_BITS) - 1)
    return ((shingles * np.uint64(0x9E3779B97F4A7C15)) & ~low | np.uint64(text_key & int(low))).view(np.int64)


def _shared_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, short) of the shingles that several texts list, from sorted values; equal lists of a task once, under one key."""
    seen: set[int] = set()

    def of(values: np.ndarray) -> pa.RecordBatch:
        values = values[np.concatenate(([True], values[1:] != values[:-1]))]
        at = values >> TEXT_BITS
        starts = np.concatenate(([0], np.flatnonzero(at[1:] != at[:-1]) + 1))
        sizes = np.diff(np.append(starts, len(values)))
        short = values & ((1 << TEXT_BITS) - 1)
        keys = np.add.reduceat(mixed(short.astype(np.uint64) + np.uint64(1), 1), starts).view(np.int64)
        new = np.zeros(len(keys), dtype=bool)
        for i in np.flatnonzero(sizes > 1).tolist():
            key = int(keys[i])
            if key not in seen:
                seen.add(key)
                new[i] = True
        rows = np.repeat(new, sizes)
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(keys, sizes)[rows]), pa.array(short[rows])], names=["key", "short"])

    held, n = [], 0
    for batch in batches:
        held.append(batch.column(0).to_numpy())
        n += len(held[-1])
        if n >= 1 << 17:
            values = np.concatenate(held)
            cut = int(np.searchsorted(values >> TEXT_BITS, values[-1] >> TEXT_BITS))  # the last list may go on
            if cut:
                yield of(values[:cut])
            held, n = [values[cut:].copy()], 0
    if sum(map(len, held)):
        yield of(np.concatenate(held))


def frequent_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles in a thousandth (COMMON) or more of all texts of docs (text_key, text), sorted, and their ranks, the rarest first.

    The counts are exact, over every text. A shingle of a thousandth of all texts is in a thousandth of some task's texts; so tasks
    first count shingles by COUNTERS buckets, and only shingles of buckets with so many in some task are counted one by one.
    At most COMMON times the mean number of shingles a text has are frequent.
    """
    n = docs.count()

    def distinct_of(batch: pa.RecordBatch) -> np.ndarray:
        return np.concatenate([np.zeros(0, dtype=np.uint64), *(np.unique(shingle_hashes(x, 3)) for x in text_bytes(batch.column("text")))])

    def bucket(shingles: np.ndarray) -> np.ndarray:
        return (shingles & np.uint64(COUNTERS - 1)).astype(np.int64)

    def full_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, texts = np.zeros(COUNTERS, dtype=np.int32), 0
        for batch in batches:
            at, more = np.unique(bucket(distinct_of(batch)), return_counts=True)
            counts[at] += more.astype(np.int32)
            texts += batch.num_rows
        words = np.packbits((counts > 0) & (counts >= texts / COMMON), bitorder="little").view(np.int64)
        some = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(words[some])], names=["word", "bits"])

    few = docs.coalesce(max(docs.sparkSession.sparkContext.defaultParallelism, n // TEXTS_A_TASK))
    found = few.mapInArrow(full_buckets, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).collect()
    full = np.zeros(COUNTERS // 64, dtype=np.int64)
    full[[r["word"] for r in found]] = [r["bits"] for r in found]

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_full = np.unpackbits(full.view(np.uint8), bitorder="little").astype(bool)
        for batch in batches:
            own = distinct_of(batch)
            yield pa.RecordBatch.from_arrays([pa.array(own[is_full[bucket(own)]].view(np.int64))], names=["shingle"])

    often = docs.mapInArrow(shingles, "shingle bigint").groupBy("shingle").count().where(F.col("count") >= max(LEAST, -(-n // COMMON)))
    found = np.array([r["shingle"] for r in often.orderBy(F.desc("count"), "shingle").collect()], dtype=np.int64).view(np.uint64)[::-1]
    ranks = np.argsort(found)
    return found[ranks], ranks


def shingle_lists(docs: DataFrame, prints: DataFrame) -> DataFrame:
    """Rows (key, node, w0, ...) in which the texts of docs (text_key, text) that share a shingle of their prefixes have one key."""
    last, ranks = frequent_shingles(docs)

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # a task lists copies once
        for batch in batches:
            found = [np.zeros(0, dtype=np.int64)]
            for key, text in zip(batch.column("text_key").to_pylist(), text_bytes(batch.column("text"))):
                if key not in seen:
                    seen.add(key)
                    found.append(listed(text, key, last, ranks))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found))], names=["value"])

    found = docs.where("text is not null").mapInArrow(values, "value bigint")
    found = found.repartition(F.shiftright("value", TEXT_BITS)).sortWithinPartitions("value")
    found = found.mapInArrow(_shared_lists, "key bigint, short bigint")
    short = F.col("text_key").bitwiseAND(F.lit((1 << TEXT_BITS) - 1)).alias("short")
    texts = prints.select(short, "node", *(f"w{i}" for i in range(WORDS))).distinct()
    # texts of one short name are all put into its lists, and meet each other under it: that adds meetings and loses none
    return found.join(texts, "short").drop("short").unionByName(texts.withColumnRenamed("short", "key"))


def wide_links(prints: DataFrame, lists: DataFrame | None = None) -> DataFrame:
    """Edges (a, b) between nodes of prints (node, w0, w1, ...) that meet under a choice of positional bytes and are near.

    Rows of lists (key, node, w0, w1, ...) with one key meet as well.
    """

    def byte(position: int) -> Column:
        return F.shiftrightunsigned(f"w{position // 8}", 8 * (position % 8)).bitwiseAND(F.lit(255))

    keys = []
    for n, choice in enumerate(CHOICES):
        key = F.lit(n).cast("bigint")
        for position in choice:
            key = F.shiftleft(key, 8).bitwiseOR(byte(position))
        keys.append(key)
    words = [f"w{i}" for i in range(WORDS)]
    index = prints.select(F.explode(F.array(*keys)).alias("key"), "node", *words)
    if lists is not None:
        index = index.unionByName(lists)
    index = index.repartition("key").sortWithinPartitions("key")
    edges = index.mapInArrow(_meet, "a bigint, b bigint").distinct()
    for _ in range(SMALL_STARS):  # a node's smaller neighbours go under the smallest of them: connects the same, with fewer edges
        edges = edges.withColumn("least", F.min("b").over(Window.partitionBy("a")))
        ends = F.array(F.struct("a", F.col("least").alias("b")), F.struct(F.col("b").alias("a"), F.col("least").alias("b")))
        edges = edges.select(F.explode(ends).alias("e")).select("e.a", "e.b").where("a > b").distinct()
    return edges


def keep_one_of_copies(docs: DataFrame) -> DataFrame:
    """One row of docs of each group of near copies, that of the smallest doc_id, with docs' own columns.

    Near are texts whose fingerprints of WORDS * 64 bits over three-word shingles differ in at most WIDE_BITS bits. They meet
    under CHOICES of three positional bytes, which miss some, and under the shingles of their prefixes (listed), which miss none
    whose counts of shingles have a cosine of COSINE, nor any of two texts of at most WHOLE shingles that share one. At that
    cosine about 70 bits differ; 40 or fewer, by a chance of about 1e-5, and less the lower the cosine is. Texts
    that share 0.8 of their five-word shingles differ in about 30 bits, texts of other words in 128. A list links its members as
    all its pairs would, whatever their number; groups are the components.

    Texts without a word (null, empty, white space) are one group; rows without a doc_id stay only where their group has no
    other, repeated rows once; an empty table gives an empty result.
    """
    words = [F.col("print")[i].alias(f"w{i}") for i in range(WORDS)]
    prints = saved(docs.select("doc_id", F.xxhash64("text").alias("text_key"), wide_fingerprint_of("text").alias("print")).select("doc_id", "text_key", *words, F.xxhash64("print").alias("node")), "copies-prints")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key", "n")
    names = [f"w{i}" for i in range(WORDS)]
    rows = prints.groupBy("node", *names, "doc_id", "text_key").agg(F.count(F.lit(1)).alias("n"))
    distinct = saved(rows.groupBy("node", *names).agg(F.min(order).alias("best")), "copies-distinct")
    texts = docs.select(F.xxhash64("text").alias("text_key"), "text")
    roots = components(wide_links(distinct.select("node", *names), shingle_lists(texts, prints)))
    rooted = distinct.select("node", "best").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    best = rooted.groupBy("root").agg(F.min("best").alias("best"))
    a, b, n = (free_name(docs, x) for x in ("row_key", "row_key_too", "n_rows"))

    def keys(doc_id: Column, text_key: Column) -> list[Column]:
        return [F.xxhash64(F.lit(x), doc_id.isNull(), doc_id, text_key).alias(y) for x, y in ((1, a), (2, b))]

    stays = best.select(*keys(F.col("best.doc_id"), F.col("best.text_key")), F.col("best.n").alias(n))
    stays = saved(stays.groupBy(a, b).agg(F.sum(n).alias(n)), "copies-stay")
    held = docs.select("*", *keys(F.col("doc_id"), F.xxhash64("text"))).join(stays, [a, b])
    once, repeated = held.where(F.col(n) == 1), held.where(F.col(n) > 1).dropDuplicates([a, b])  # texts that come once need no shuffle
    return once.unionByName(repeated).select(*docs.columns)
