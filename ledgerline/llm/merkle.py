"""Merkle dataset manifest as a postorder append log.

Every document becomes a leaf, the leaves of a source form a tree of ARITY children a node in the order of doc_id, and the
roots of the sources (null first, then bytewise) form one more tree of the same kind, whose root stands for the data set.

Builders are aligned: the leaves of a tree are cut into blocks of ARITY ** HEIGHT, and one builder appends the nodes of one
block in completion order, so the log of a block is a postorder, and its last node is the block's root. The block roots are
the leaves of the next tier, until a tree has one node. No builder holds more than a block, however large a source is.
Where a node stands in such a log follows from the sizes of the subtrees before it (`position`), so a proof reads the
siblings of a leaf straight from the log of its block, then those of the block's root one tier up.

`manifest` returns the tables, `prove` the sibling path of every leaf, `folded` the root that a leaf and its path give.

A null value is written `-`. Leaves of equal doc_id are ordered by their digest, null doc_ids come first, and repeated rows
are leaves of their own (equal ones are interchangeable). A source of one leaf has that leaf as its root; an empty table has
no leaves and the root is None. Columns other than those that are hashed play no part, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import crc_of_id, saved, small_batches

ARITY = 3
#: Levels that one builder completes; a block has ARITY ** HEIGHT leaves at most.
HEIGHT = 7
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_SEGMENT = "tree string, block bigint, n bigint, m int, nodes binary"
_UP = "before array<string>, after array<string>, subroot binary"


def leaf_of(columns: list[Column]) -> Column:
    """Digest of the values, each with its length before it, as 32 bytes."""
    parts = []
    for column in columns:
        text = column.cast("string")
        parts.append(F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)))
    return F.unhex(F.sha2(F.concat(*parts), 256))


def tree_of(source: Column) -> Column:
    """Name of a source's tree: bytewise order puts the null source first."""
    return F.when(source.isNull(), "n").otherwise(F.concat(F.lit("s"), source.cast("string")))


def levels(n: int) -> int:
    """Levels above n leaves."""
    height = 0
    while n > 1:
        n, height = -(-n // ARITY), height + 1
    return height


def position(height: int, index: int, n: int) -> int:
    """Place in the log of node `index` of a level, in a tree of n leaves.

    The node completes `height` places after its last leaf; before that leaf stand the leaves and the whole subtrees to its left.
    """
    last = min((index + 1) * ARITY**height, n) - 1
    place, whole = height, last
    while whole:
        place, whole = place + whole, whole // ARITY
    return place


def parent(children: list[bytes]) -> bytes:
    return hashlib.sha256(b"".join(child.hex().encode() for child in children)).digest()


def append_log(leaves: list[bytes], height: int) -> list[bytes]:
    """Nodes of a block in the order in which they are complete, up to its root."""
    log: list[bytes] = []
    waiting: list[list[bytes]] = [[] for _ in range(height + 1)]

    def add(level: int, digest: bytes) -> None:
        log.append(digest)
        run = waiting[level]
        run.append(digest)
        if level < height and len(run) == ARITY:
            waiting[level] = []
            add(level + 1, parent(run))

    for digest in leaves:
        add(0, digest)
    for level in range(height):  # what is left open closes from below
        if waiting[level]:
            run, waiting[level] = waiting[level], []
            add(level + 1, parent(run))
    return log


def _builder(height: int):
    """Rows sorted by tree, block and index to one log a block."""

    def segment(key: tuple[str, int], n: int, leaves: list[bytes]) -> pa.RecordBatch:
        log = append_log(leaves, min(height, levels(n)))
        values = ([key[0]], [key[1]], [n], [len(leaves)], [b"".join(log)])
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(values, kinds)], names=["tree", "block", "n", "m", "nodes"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, leaves, n = None, [], 0
        for batch in batches:
            for tree, block, size, digest in zip(*(batch.column(c).to_pylist() for c in ("tree", "block", "n", "digest"))):
                if key != (tree, block):
                    if leaves:
                        yield segment(key, n, leaves)
                    key, leaves, n = (tree, block), [], size
                leaves.append(digest)
        if leaves:
            yield segment(key, n, leaves)

    return build


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with `idx`, the place in their tree from 0, and `n`, the tree's number of rows.

    Rows are cut into ranges of (tree, order); a range is numbered by itself, and the sizes of the ranges before it in the
    tree are added. Equal rows are told apart by a row number, so no range holds more than its share.
    """
    cut = rows.withColumn("row_no", F.monotonically_increasing_id()).repartitionByRange("tree", *order, "row_no").withColumn("part", F.spark_partition_id())
    cut = saved(cut, "merkle-ranges")
    sizes = cut.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("size"))
    of_tree = Window.partitionBy("tree")
    before = of_tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("tree", "part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"), F.sum("size").over(of_tree).alias("n"))
    place = F.row_number().over(Window.partitionBy("tree", "part").orderBy(*order, "row_no")) - 1
    return cut.withColumn("place", place).join(sizes, ["tree", "part"]).withColumn("idx", F.col("start") + F.col("place")).drop("part", "place", "start", "row_no")


def _tiers(nodes: DataFrame, height: int, name: str) -> tuple[list[DataFrame], DataFrame]:
    """Logs of each tier over (tree, idx, n, digest), and the roots (tree, digest)."""
    span, found = ARITY**height, []
    while True:
        blocks = nodes.select("tree", F.expr(f"idx div {span}").alias("block"), "idx", "n", "digest")
        blocks = blocks.repartition("tree", "block").sortWithinPartitions("tree", "block", "idx")
        found.append(saved(blocks.mapInArrow(_builder(height), _SEGMENT), name))
        root = F.expr("substring(nodes, -32)")
        if not found[-1].where(F.col("n") > span).limit(1).count():
            break
        nodes = found[-1].where(F.col("n") > span).select("tree", F.col("block").alias("idx"), F.expr(f"(n + {span - 1}) div {span}").alias("n"), root.alias("digest"))
    tops = [tier.where(F.col("n") <= span).select("tree", root.alias("digest")) for tier in found]
    return found, reduce(DataFrame.union, tops)


@dataclass
class Manifest:
    """Leaves (tree, idx, n, digest and what else they carry), the logs of the sources' trees and of the tree over them."""

    leaves: DataFrame
    tiers: list[DataFrame]
    top_leaves: DataFrame
    top_tiers: list[DataFrame]
    root: str | None
    height: int


def manifest(leaves: DataFrame, height: int = HEIGHT) -> Manifest:
    """Build all logs over rows of (tree, doc_id, digest); other columns are carried along."""
    small_batches(leaves.sparkSession)
    placed = saved(numbered(saved(leaves, "merkle-leaves"), ["doc_id", "digest"]), "merkle-placed")
    tiers, subroots = _tiers(placed, height, "merkle-log")
    tops = numbered(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("of"), "digest"), ["of"])
    top_leaves = saved(tops, "merkle-subroots")
    top_tiers, roots = _tiers(top_leaves, height, "merkle-top")
    found = roots.collect()  # at most one row: there is one top tree
    return Manifest(placed, tiers, top_leaves, top_tiers, bytes(found[0]["digest"]).hex() if found else None, height)


def _walker(carried: list[str], most: int):
    """Rows sorted by tree and block, the block's log first, to the carried columns of its leaves with their paths."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log, m, height, up, runs = b"", 0, 0, (None, None, None), {}

        def run(level: int, number: int) -> list[str]:
            found = runs.get((level, number))
            if found is None:
                width = -(-m // ARITY**level)
                places = [position(level, i, m) for i in range(number * ARITY, min((number + 1) * ARITY, width))]
                found = runs[level, number] = [log[32 * p : 32 * p + 32].hex() for p in places]
            return found

        for batch in batches:
            columns = {c: batch.column(c).to_pylist() for c in ("is_leaf", "idx", "block", "n", "m", "nodes", "before", "after", "subroot")}
            keep, before, after, subroot = [], [], [], []
            for at, is_leaf in enumerate(columns["is_leaf"]):
                if not is_leaf:
                    log, m, runs = columns["nodes"][at], columns["m"][at], {}
                    height, up = min(most, levels(columns["n"][at])), tuple(columns[c][at] for c in ("before", "after", "subroot"))
                    continue
                left, right = [], []
                local = columns["idx"][at] - columns["block"][at] * ARITY**most
                for level in range(height):
                    number, own = divmod(local // ARITY**level, ARITY)
                    siblings = run(level, number)
                    left.append("".join(siblings[:own]))
                    right.append("".join(siblings[own + 1 :]))
                keep.append(at)
                before.append(left + up[0])
                after.append(right + up[1])
                subroot.append(up[2])
            if keep:
                kept = batch.select(carried).take(pa.array(keep, pa.int32()))
                paths = [pa.array(before, pa.list_(pa.string())), pa.array(after, pa.list_(pa.string())), pa.array(subroot, pa.binary())]
                yield pa.RecordBatch.from_arrays([*kept.columns, *paths], names=[*carried, "before", "after", "subroot"])

    return walk


def _paths(leaves: DataFrame, segments: DataFrame, height: int, carried: list[str]) -> DataFrame:
    """Carried columns of the leaves with before, after (hex of the siblings on either side, level by level) and subroot.

    A block's log and its leaves are brought together by sorting, the log first: a task holds one log at a time.
    """
    span = ARITY**height
    kinds = {f.name: f.dataType for f in [*segments.schema, *leaves.schema]}
    sides = []
    for is_leaf, frame in ((False, segments), (True, leaves.withColumn("block", F.expr(f"idx div {span}")))):
        own = set(frame.columns) if not is_leaf else {"tree", "idx", "block", *carried}
        names = dict.fromkeys(["tree", "block", "n", "m", "nodes", "before", "after", "subroot", "idx", *carried])
        sides.append(frame.select(F.lit(is_leaf).alias("is_leaf"), *(F.col(c) if c in own else F.lit(None).cast(kinds[c]).alias(c) for c in names)))
    both = sides[0].union(sides[1]).repartition("tree", "block").sortWithinPartitions("tree", "block", "is_leaf", "idx")
    schema = ", ".join(f"`{c}` {kinds[c].simpleString()}" for c in carried)
    return both.mapInArrow(_walker(carried, height), f"{schema}, {_UP}")


def _climb(tiers: list[DataFrame], height: int, tops: DataFrame) -> DataFrame:
    """Segments of the lowest tier with the path above their root; `tops` gives that of each tree's own root."""
    span, below = ARITY**height, None
    for tier in reversed(tiers):
        above = tops.select("tree", F.lit(0).cast("bigint").alias("block"), "before", "after", "subroot")
        ends = tier.where(F.col("n") <= span).join(above, ["tree", "block"])
        if below is not None:
            inner = tier.where(F.col("n") > span)
            picks = inner.select("tree", F.col("block").alias("idx"), F.col("block").alias("own"))
            paths = _paths(picks.withColumn("of", F.col("tree")), below, height, ["of", "own"])
            joined = inner.join(paths.select(F.col("of").alias("tree"), F.col("own").alias("block"), "before", "after", "subroot"), ["tree", "block"])
            ends = ends.unionByName(joined)
        below = saved(ends, "merkle-paths")
    return below


def prove(built: Manifest, carried: list[str]) -> DataFrame:
    """Every leaf's carried columns with its path to the root: before and after, level by level, and its source's root."""
    none = F.array().cast("array<string>")
    spark = built.leaves.sparkSession
    start = spark.createDataFrame([("",)], "tree string").select("tree", none.alias("before"), none.alias("after"), F.lit(None).cast("binary").alias("subroot"))
    of_trees = _paths(built.top_leaves, _climb(built.top_tiers, built.height, start), built.height, ["of", "digest"])
    tops = saved(of_trees.select(F.col("of").alias("tree"), "before", "after", F.col("digest").alias("subroot")), "merkle-tops")
    return _paths(built.leaves, _climb(built.tiers, built.height, tops), built.height, carried)


def folded(leaf: Column, before: Column, after: Column) -> Column:
    """Root in hex that a leaf in hex gives with the siblings on its path."""
    sides = F.arrays_zip(before.alias("before"), after.alias("after"))
    return F.aggregate(sides, leaf, lambda digest, side: F.sha2(F.concat(side["before"], digest, side["after"]), 256))


def proof_digest(before: Column, after: Column) -> Column:
    """Digest of all siblings, level by level to the root, left to right."""
    return F.sha2(F.array_join(F.zip_with(before, after, lambda left, right: F.concat(left, right)), ""), 256)


def verify(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """Manifest of docs, its proofs, and their check on documents whose line ends were deleted where 2 divides the id's crc32."""
    columns = {c: F.col(c) for c in COLUMNS}
    cut = (crc_of_id() % 2 == 0) & F.col("text").contains("\n")
    changed = F.when(cut, leaf_of([*(columns[c] for c in COLUMNS[:-1]), F.replace(columns["text"], F.lit("\n"), F.lit(""))]))
    leaves = docs.select(tree_of(columns["source"]).alias("tree"), "doc_id", leaf_of(list(columns.values())).alias("digest"), changed.alias("changed"))
    built = manifest(leaves, height)
    before, after = F.col("before"), F.col("after")
    text = lambda digest: F.lower(F.hex(digest))
    proved = prove(built, ["doc_id", "digest", "changed"]).withColumn("folded_root", folded(text(F.coalesce("changed", "digest")), before, after))
    return proved.select(
        "doc_id",
        text("digest").alias("leaf"),
        text("subroot").alias("subroot"),
        F.lit(built.root).cast("string").alias("root"),
        proof_digest(before, after).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.lit(built.root)).alias("verified"),
    )
