"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of 10 words of benchmark items (a shorter item is one pattern). For each pattern length there is a
shift table of blocks of two words: the distance by which no pattern can end sooner. At shift zero the block's bucket,
divided by the patterns' first block, gives the test strings, and these are compared word by word.

The patterns are a stated query set: their text is summed first and cut into blocks of at most BLOCK_BYTES, each of which is
searched against all rows, so what is broadcast has a fixed bound. With several blocks the rows are saved between passes.

Null texts have no words, an item or document without words matches nothing; an item whose item_id is null takes part in
hits but is not among the items; repeated items count once, repeated rows of documents are all returned.
"""

from __future__ import annotations

import math
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import free_name, saved, text_bytes

WINDOW = 10
BLOCK_BYTES = 2_000_000
#: ASCII letters become lower case, digits and bytes of other characters stay, all else separates words.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
RESULT = "struct<n_words: bigint, n_hit: bigint, spans: array<int>, items: array<string>>"
_ARROW = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("spans", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))])


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class Search:
    """Shift tables and buckets of patterns of one length."""

    def __init__(self, patterns: dict[tuple[bytes, ...], set[str]], length: int):
        self.length, self.block = length, min(2, length)
        self.default = length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], dict] = defaultdict(lambda: defaultdict(list))
        for pattern, items in patterns.items():
            for end in range(self.block, length + 1):
                block = pattern[end - self.block : end]
                self.shift[block] = min(self.shift.get(block, self.default), length - end)
            self.buckets[block][pattern[: self.block]].append((pattern, items))
        self.buckets = {k: dict(v) for k, v in self.buckets.items()}

    def scan(self, words: list[bytes]):
        """Start and items of every occurrence, from left to right."""
        length, block, default, get = self.length, self.block, self.default, self.shift.get
        end, n = length, len(words)
        while end <= n:
            suffix = tuple(words[end - block : end])
            step = get(suffix, default)
            if step:
                end += step
                continue
            start = end - length
            for pattern, items in self.buckets[suffix].get(tuple(words[start : start + block]), ()):
                if tuple(words[start:end]) == pattern:
                    yield start, items
            end += 1


def compile_patterns(items: list[tuple[str | None, bytes]], window: int = WINDOW) -> list[Search]:
    by_length: dict[int, dict[tuple[bytes, ...], set[str]]] = defaultdict(lambda: defaultdict(set))
    for item, text in items:
        words = words_of(text)
        size = min(window, len(words))
        for start in range(len(words) - size + 1 if size else 0):
            by_length[size][tuple(words[start : start + size])] |= set() if item is None else {item}
    return [Search(patterns, size) for size, patterns in sorted(by_length.items())]


def find(searches: list[Search], text: bytes, spans: list[int], items: list[str]) -> dict:
    """The result of one text, beside spans (starts and ends in turn) and items that are known already."""
    words, found, hits = words_of(text), set(items), list(zip(spans[::2], spans[1::2]))
    for search in searches:
        for start, of in search.scan(words):
            found |= of
            hits.append((start, start + search.length))
    merged: list[int] = []
    for start, end in sorted(hits):
        if merged and start <= merged[-1]:
            merged[-1] = max(merged[-1], end)
        else:
            merged += [start, end]
    return {"n_words": len(words), "n_hit": sum(merged[1::2]) - sum(merged[::2]), "spans": merged, "items": sorted(found)}


def _searcher(searches_of):
    @F.arrow_udf(RESULT)
    def search(texts: pa.Array, known: pa.Array) -> pa.Array:
        searches = searches_of.value
        rows = zip(text_bytes(texts), known.to_pylist())
        return pa.array([find(searches, t, *((k["spans"], k["items"]) if k else ([], []))) for t, k in rows], _ARROW)

    return search


def contamination(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with a last struct column: n_words, n_hit, spans (hit words, starts and ends in turn), items (sorted as text)."""
    spark, name = docs.sparkSession, free_name(docs, "found")
    total = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    part = F.pmod(F.xxhash64("text"), F.lit(blocks))
    out = docs.withColumn(name, F.lit(None).cast(RESULT))
    for block in range(blocks):
        rows = benchmark.where(F.col("text").isNotNull() & (part == block)).select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("binary").alias("text")).distinct().collect()
        searches = spark.sparkContext.broadcast(compile_patterns([(r["item"], bytes(r["text"])) for r in rows]))
        out = (out if block == 0 else saved(out, "decontaminate")).withColumn(name, _searcher(searches)("text", name))
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no window of an item."""
    checked = contamination(docs, benchmark)
    return checked.where(F.col(checked.columns[-1])["n_hit"] == 0).select(*docs.columns)
