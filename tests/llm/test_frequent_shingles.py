"""Frequent shingles are counted over every text, and all of them are put last."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from ledgerline.llm import simhash


def test_counts_are_those_of_all_texts(spark):
    def text(i):
        return " ".join([f"only{i}a only{i}b only{i}c", *(f"in{k} of all" for k in (2, 500, 900, 1000) if i % k == 0), *(["rare here now"] if i < 11 else []), *(["seldom seen so"] if i < 12 else [])])

    texts = [text(i) for i in range(12_000)] + [None, ""]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "text_key bigint, text string").repartition(9, F.col("text_key"))
    counts = Counter(s for t in texts for s in np.unique(simhash.shingle_hashes((t or "").encode(), 3)).tolist())
    want = {s: n for s, n in counts.items() if n >= 13}  # a thousandth of 12002 texts
    last, ranks = simhash.frequent_shingles(docs)
    assert last.tolist() == sorted(want) and sorted(ranks.tolist()) == list(range(len(want)))
    by_rank = [want[s] for _, s in sorted(zip(ranks.tolist(), last.tolist()))]
    assert by_rank == sorted(by_rank)


def test_no_frequent_shingle_is_left_behind(spark):
    """More of them than were kept before: 23976 shingles, each in 5 of 60 texts."""
    long = [" ".join(f"w{j}x{i}" for i in range(2000)) for j in range(12)]
    docs = spark.createDataFrame([(i, long[i % 12]) for i in range(60)], "text_key bigint, text string").repartition(3)
    last, ranks = simhash.frequent_shingles(docs)
    assert len(last) == len(ranks) == 12 * 1998 > 20_000


def test_no_texts(spark):
    last, ranks = simhash.frequent_shingles(spark.createDataFrame([], "text_key bigint, text string"))
    assert len(last) == len(ranks) == 0
