"""Ranked lexical search by NRA: no random access, sequential reads of impact-sorted lists.

The queries are a stated set of items, searched against all documents. One pass cuts the documents into terms and keeps, per
document, its length and the frequencies of the items' terms (the forward index); sums over it give N, L and each term's df.

A second pass takes the forward index in blocks of at most BLOCK_DOCS documents or BLOCK_POSTINGS postings. Inside a block
every term has a list of (document, impact), sorted by falling impact. For one item all lists are read from the top in steps
that double. A document's lower bound is the sum of the impacts read for it; its upper bound adds, for each list in which it
has not been met, the impact that comes next there. The tenth best lower bound, over this block and those that the task has
read before, is the bar: an item's search in the block ends when no unmet document can reach the bar, and every document
whose upper bound does has a lower bound equal to it, so membership, ties and scores are settled. Ties are kept up to the
bar and decided by doc_id. A task hands on ten rows an item; these are ranked in two steps.

Items are taken in groups of at most GROUP_BYTES of text, each group a pass, so that the terms a task holds have a bound (an item
of more is a group by itself). A repeated item is ranked for each of its rows. Null or empty items and documents have no
terms and are in no result; without documents or terms there are no rows. Repeated doc_ids are ranked as documents of their
own, null doc_ids before all others. Columns of other names are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm.common import saved, small_batches, text_bytes

TOP = 10
RESULT = ["item_id", "rank", "doc_id", "score"]
GROUP_BYTES = 2_000_000
BLOCK_DOCS = 16_384
BLOCK_POSTINGS = 4_000_000
#: Postings read from each list in the first step.
FIRST_STEP = 64
#: ASCII letters become lower case, digits and bytes of other characters stay, all else separates terms.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def _indexer(vocabulary: dict[bytes, int]):
    """Documents with a term to (doc_id, n, terms, freqs): term numbers ascending, of the items' terms only."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, sizes, terms, freqs = [], [], [], []
            for at, text in enumerate(text_bytes(batch.column("text"))):
                words = terms_of(text)
                if words:
                    own = Counter(map(vocabulary.get, words))
                    own.pop(None, None)
                    numbers = sorted(own)
                    keep.append(at)
                    sizes.append(len(words))
                    terms.append(numbers)
                    freqs.append([own[x] for x in numbers])
            ids = batch.column("doc_id").take(pa.array(keep, pa.int32()))
            columns = [ids, pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(freqs, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "terms", "freqs"])

    return index


def forward_index(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def index(batches):
        return _indexer(shared.value)(batches)

    return docs.select("doc_id", "text").mapInArrow(index, f"doc_id {kind}, n bigint, terms array<int>, freqs array<bigint>")


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def length_part(sizes: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """A document's m; products beyond 64 bits are worked out one by one."""
    if len(sizes) and int(sizes.max()) * 75 * n_docs >= 1 << 63:
        return 25 + np.array([75 * int(n) * n_docs // n_terms for n in sizes], np.int64)
    return 25 + 75 * sizes * n_docs // n_terms


class Block:
    """Impact-sorted lists of a block of documents."""

    def __init__(self, ids: list, sizes: np.ndarray, counts: np.ndarray, terms: np.ndarray, freqs: np.ndarray, weights: np.ndarray, n_docs: int, n_terms: int):
        self.ids = ids
        docs = np.repeat(np.arange(len(ids), dtype=np.int32), counts)
        parts = length_part(sizes, n_docs, n_terms)
        impacts = weights[terms] * (1_000_000_000 * freqs // (1000 * freqs + 8 * parts[docs]))
        order = np.lexsort((-impacts, terms))
        self.docs, self.impacts = docs[order], impacts[order]
        ordered = terms[order]
        starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(ordered) else np.zeros(0, np.int64)
        self.lists = dict(zip(ordered[starts].tolist(), zip(starts.tolist(), [*starts[1:].tolist(), len(ordered)])))

    def search(self, item: list[tuple[int, int]], best: list[int]) -> list[tuple[int, int]]:
        """(score, document) of all that may be among the TOP, where `best` are scores found before."""
        lists = []
        for term, times in item:
            if term in self.lists:
                start, end = self.lists[term]
                end = start + int(np.searchsorted(-self.impacts[start:end], 0))  # what adds nothing is not read
                if end > start:
                    lists.append((start, end, times))
        lower, unseen = np.zeros(len(self.ids), np.int64), np.zeros(len(self.ids), np.int64)
        read = [start for start, _, _ in lists]
        step = FIRST_STEP
        while True:
            heads = []
            for at, (_, end, times) in enumerate(lists):
                stop = min(read[at] + step, end)
                lower[self.docs[read[at] : stop]] += times * self.impacts[read[at] : stop]
                read[at] = stop
                heads.append(times * int(self.impacts[stop]) if stop < end else 0)
            step *= 2
            met = np.flatnonzero(lower)
            bar = self._bar(lower[met], best)
            ahead = sum(heads)
            if ahead and ahead >= bar:  # a document not met so far could still be among them
                continue
            unseen[:] = ahead
            for at, (start, _, _) in enumerate(lists):
                if heads[at]:
                    unseen[self.docs[start : read[at]]] -= heads[at]
            left = met[lower[met] + unseen[met] >= bar]
            if not unseen[left].any():
                return [(int(lower[d]), int(d)) for d in left]

    @staticmethod
    def _bar(scores: np.ndarray, best: list[int]) -> int:
        found = np.concatenate([scores, np.array(best, np.int64)])
        return int(np.partition(found, len(found) - TOP)[len(found) - TOP]) if len(found) >= TOP else 0


def _rank_key(pair: tuple[int, object]):
    score, doc = pair
    return (-score, doc is not None, 0 if doc is None else doc)


def _searcher(items: list[list[tuple[int, int]]], weights: np.ndarray, n_docs: int, n_terms: int):
    """The forward index to the best documents of each item that this task has seen."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Block, pa.DataType]]:
        held, rows, postings = [], 0, 0
        for batch in batches:
            held.append(batch)
            rows, postings = rows + len(batch), postings + len(batch.column("terms").flatten())
            if rows >= BLOCK_DOCS or postings >= BLOCK_POSTINGS:
                yield block(held), batch.schema.field("doc_id").type
                held, rows, postings = [], 0, 0
        if rows:
            yield block(held), batch.schema.field("doc_id").type

    def block(held: list[pa.RecordBatch]) -> Block:
        table = pa.Table.from_batches(held).combine_chunks()
        flat = {c: table.column(c).combine_chunks() for c in table.column_names}
        counts = np.diff(flat["terms"].offsets.to_numpy())
        values = [flat[c].flatten().to_numpy(zero_copy_only=False) for c in ("terms", "freqs")]
        return Block(table.column("doc_id").to_pylist(), flat["n"].to_numpy(), counts, values[0], values[1], weights, n_docs, n_terms)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[int, object]]] = [[] for _ in items]
        kind = pa.null()
        for found, kind in blocks(batches):
            for number, item in enumerate(items):
                scored = [(score, found.ids[d]) for score, d in found.search(item, [s for s, _ in best[number]])]
                if scored:
                    best[number] = sorted(best[number] + scored, key=_rank_key)[:TOP]
        rows = [(number, score, doc) for number, own in enumerate(best) for score, doc in own]
        if not rows:
            return
        numbers, scores, docs = zip(*rows)
        yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(scores, pa.int64()), pa.array(docs, kind)], names=["item_no", "score", "doc_id"])

    return search


def _groups(items: DataFrame) -> Iterator[list]:
    """The items in groups of at most GROUP_BYTES of text; one group is on the driver at a time."""
    held, size = [], 0
    for row in items.select("item_id", "text").where(F.octet_length("text") > 0).toLocalIterator():
        own = len(row["text"].encode())
        if held and size + own > GROUP_BYTES:
            yield held
            held, size = [], 0
        held, size = [*held, row], size + own
    if held:
        yield held


def _ranked(found: DataFrame) -> DataFrame:
    """The TOP of each item, first within parts of the rows, then among these."""
    by = [F.col("score").desc(), F.col("doc_id").asc_nulls_first()]
    part = F.pmod(F.xxhash64("doc_id"), F.lit(64))
    for keys in (["item_no", part], ["item_no"]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*by)).cast("int")).where(F.col("rank") <= TOP)
    return found


def _search_group(docs: DataFrame, group: list, id_field: T.StructField) -> DataFrame:
    spark = docs.sparkSession
    cut = [Counter(terms_of(row["text"].encode())) for row in group]
    vocabulary = {term: number for number, term in enumerate(sorted(set().union(*cut)))}
    items = [[(vocabulary[t], times) for t, times in own.items()] for own in cut]
    index = saved(forward_index(docs, vocabulary), "search-index")
    n_docs, n_terms = index.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    counted = index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weights = np.zeros(max(1, len(vocabulary)), np.int64)
    for row in counted.collect():  # no more rows than the group has terms
        weights[row["term"]] = weight(n_docs, row["df"])
    shared = spark.sparkContext.broadcast((items, weights))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def search(batches):
        own, of = shared.value
        return _searcher(own, of, n_docs, n_terms)(batches)

    found = _ranked(index.mapInArrow(search, f"item_no int, score bigint, doc_id {kind}"))
    names = spark.createDataFrame([(i, row["item_id"]) for i, row in enumerate(group)], T.StructType([T.StructField("item_no", T.IntegerType()), id_field]))
    return found.join(names, "item_no").select(*RESULT)


def search(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, rank, doc_id, score) of the TOP documents of every item."""
    spark = docs.sparkSession
    small_batches(spark)
    id_field = T.StructField("item_id", items.schema["item_id"].dataType)
    found = [saved(_search_group(docs, group, id_field), "search-result") for group in _groups(items)]
    if found:
        return reduce(DataFrame.union, found)
    kinds = (id_field.dataType, T.IntegerType(), docs.schema["doc_id"].dataType, T.LongType())
    return spark.createDataFrame([], T.StructType([T.StructField(n, k) for n, k in zip(RESULT, kinds)]))
