"""Near copies beyond two bits: wide fingerprints against brute force."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import simhash


def _roots(n, pairs):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in pairs:
        a, b = sorted((find(i), find(j)))
        root[b] = a
    return [find(i) for i in range(n)]


def _text(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(n))


def _edited(rng, text, edits):
    words = text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = "edited" + str(rng.randrange(10**6))
    return " ".join(words)


def _shingles(text):
    words = text.split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    texts = [_text(rng, rng.randint(150, 400)) for _ in range(150)]
    for i in range(60):
        texts.append(_edited(rng, texts[i], max(1, len(texts[i].split()) // 60)))
    crowd = _text(rng, 300)
    texts += [_edited(rng, crowd, 2) for _ in range(200)]  # a crowd without its original
    return [(i, t) for i, t in enumerate(texts)]


def test_near_copies_go_and_others_stay(spark, corpus):
    frame = spark.createDataFrame(corpus, "doc_id bigint, text string").repartition(4)
    kept = {r["doc_id"] for r in simhash.keep_one_of_copies(frame).collect()}
    shingles = [_shingles(t) for _, t in corpus]
    pairs = [(i, j) for i, j in itertools.combinations(range(len(corpus)), 2) if len(shingles[i] & shingles[j]) >= 0.8 * len(shingles[i] | shingles[j])]
    roots = _roots(len(corpus), pairs)
    copies = [i for i in range(len(corpus)) if roots[i] != i]
    assert len(copies) > 200 and {i for i in range(len(corpus)) if roots[i] == i} <= kept  # the smallest of each group, and all without copies
    assert len(kept & set(copies)) <= 0.05 * len(copies)


def test_links_are_those_of_brute_force(spark, corpus):
    prints = np.stack([simhash.wide_simhash(t.encode()) for _, t in corpus])
    near = []
    for i, j in itertools.combinations(range(len(corpus)), 2):
        xor = prints[i] ^ prints[j]
        same = xor.view(np.uint8) == 0
        if np.bitwise_count(xor).sum() <= simhash.WIDE_BITS and any(same[choice].all() for choice in simhash.CHOICES):
            near.append((i, j))
    rows = [(i, *map(int, p.view(np.int64))) for i, p in enumerate(prints)]
    frame = spark.createDataFrame(rows, "node bigint, w0 bigint, w1 bigint, w2 bigint, w3 bigint").repartition(3)
    got = [(r["a"], r["b"]) for r in simhash.wide_links(frame).collect()]
    assert _roots(len(corpus), got) == _roots(len(corpus), near)


def test_a_list_may_span_batches():
    rng = np.random.default_rng(2)
    prints = rng.integers(0, 1 << 63, (40, simhash.WORDS), dtype=np.uint64)
    prints[10:31] = prints[10] ^ (np.uint64(1) << np.arange(21, dtype=np.uint64))[:, None]
    keys = np.sort(np.r_[np.arange(10), np.full(21, 20), np.arange(30, 39)])
    table = {"key": keys, "node": np.arange(40), **{f"w{i}": prints[:, i].view(np.int64) for i in range(simhash.WORDS)}}
    for size in (1, 3, 7, 40):
        batches = [pa.RecordBatch.from_pydict({k: v[i : i + size] for k, v in table.items()}) for i in range(0, 40, size)]
        edges = [(a, b) for x in simhash._meet(iter(batches)) for a, b in zip(x.column(0).to_pylist(), x.column(1).to_pylist())]
        assert len(edges) == 20 and len(set(_roots(40, edges)[10:31])) == 1


def test_edges_of_near_copies(spark):
    text = "a text of some words that is here more than once and long enough for a few shingles"
    rows = [(2, text, "x"), (2, text, "x"), (5, text, "y"), (None, text, "z"), (None, "alone in its group", "q"), (None, "alone in its group", "q")]
    rows += [(7, None, None), (8, "", "e"), (9, " \n", "e"), (10, "w " * 100_000, "long"), (11, "one", "e")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, row_key string").withColumn("node", F.lit(1)).withColumn("w0", F.lit(None).cast("int"))
    out = simhash.keep_one_of_copies(docs)
    assert out.columns == docs.columns
    want = [(2, text), (7, None), (10, "w " * 100_000), (11, "one"), (None, "alone in its group")]
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == sorted(want, key=str)
    assert simhash.keep_one_of_copies(docs.limit(0)).count() == 0


def test_pairs_that_meet_under_no_choice_of_bytes_are_caught(spark):
    rng = random.Random(5)
    common = _text(rng, 40)  # in all texts, a third of most
    rows, missed = [], []
    while len(missed) < 25:
        text = _text(rng, rng.choice((20, 90, 150))) + " " + common
        edited = _edited(rng, text, max(1, len(text.split()) // 35))
        if rng.random() < 0.2:
            text, edited = text + " so it goes" * 60, edited + " so it goes" * 90
        xor = simhash.wide_simhash(text.encode()) ^ simhash.wide_simhash(edited.encode())
        same = xor.view(np.uint8) == 0
        rows += [text, edited]
        if np.bitwise_count(xor).sum() <= simhash.WIDE_BITS and not any(same[choice].all() for choice in simhash.CHOICES):
            missed.append(len(rows) - 1)
    prints = np.stack([simhash.wide_simhash(t.encode()) for t in rows])
    near = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if np.bitwise_count(prints[i] ^ prints[j]).sum() <= simhash.WIDE_BITS]
    roots = _roots(len(rows), near)
    frame = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string").repartition(4)
    kept = {r["doc_id"] for r in simhash.keep_one_of_copies(frame).collect()}
    assert not kept & set(missed)
    assert kept == {i for i, root in enumerate(roots) if root == i}


def test_texts_of_a_cosine_have_the_first_shingle_they_share_in_both_prefixes():
    rng = random.Random(6)
    words = ["a", "b", "c", "d", "e"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice((60, 200, 600)))) for _ in range(60)]
    texts += [_edited(rng, t, 8) for t in texts]
    often = np.unique(np.concatenate([simhash.shingle_hashes(t.encode(), 3) for t in texts[:9]]))
    ranks = np.array(rng.sample(range(len(often)), len(often)))
    counts = [dict(zip(*np.unique(simhash.shingle_hashes(t.encode(), 3), return_counts=True))) for t in texts]
    for last, order in ((often, ranks), (often[:0], ranks[:0])):
        lists = [{v >> simhash.TEXT_BITS for v in simhash.listed(t.encode(), i, last, order).tolist()} for i, t in enumerate(texts)]
        n = 0
        for i, j in itertools.combinations(range(len(texts)), 2):
            dot = sum(float(c) * float(counts[j].get(x, 0)) for x, c in counts[i].items())
            norm = (sum(float(c) ** 2 for c in counts[i].values()) * sum(float(c) ** 2 for c in counts[j].values())) ** 0.5
            if dot >= simhash.COSINE * norm:
                n += 1
                assert lists[i] & lists[j]
        assert n > 60


def test_lists_of_shared_shingles():
    values = sorted([(7 << 28) + 1, (7 << 28) + 1, (8 << 28) + 1, (8 << 28) + 2, (9 << 28) + 2, (9 << 28) + 1, (-5 << 28) + 3, (-5 << 28) + 2, (-5 << 28) + 3, (11 << 28) + 4])
    for size in (1, 3, 10):
        batches = [pa.RecordBatch.from_pydict({"value": values[i : i + size]}) for i in range(0, len(values), size)]
        lists = {}
        for batch in simhash._shared_lists(iter(batches)):
            for key, short in zip(*(batch.column(i).to_pylist() for i in (0, 1))):
                lists.setdefault(key, []).append(short)
        assert sorted(lists.values()) == [[1, 2], [2, 3]]


def test_equal_lists_of_several_tasks_are_compared_once(monkeypatch):
    rng = np.random.default_rng(3)
    prints = np.tile(rng.integers(0, 1 << 63, (50, simhash.WORDS), dtype=np.uint64), (6, 1))
    table = {"key": np.full(300, 7), "node": np.tile(np.arange(50), 6), **{f"w{i}": prints[:, i].view(np.int64) for i in range(simhash.WORDS)}}
    compared, tree_edges = [], simhash._tree_edges
    monkeypatch.setattr(simhash, "_tree_edges", lambda p, i: compared.append(len(i)) or tree_edges(p, i))
    assert [b.num_rows for b in simhash._meet(iter([pa.RecordBatch.from_pydict(table)]))] == [0] and compared == [50]
