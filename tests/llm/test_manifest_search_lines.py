"""Merkle manifest, ranked search and reversible line dedup against brute force on small tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from ledgerline.llm import lexical, linededup, merkle

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string, tree string, digest string, n string"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    words = [f"w{i}" for i in range(60)]
    shared = [" ".join(rng.choices(words, k=8)) for _ in range(6)]
    out = []
    for i in range(150):
        lines = [" ".join(rng.choices(words, k=rng.randint(1, 9))) for _ in range(rng.randint(0, 6))]
        lines += [rng.choice(["", "  ", "\t"]) + rng.choice([str.upper, str])(rng.choice(shared)) + rng.choice(["", " \r"]) for _ in range(rng.randint(0, 4))]
        rng.shuffle(lines)
        out.append((i, "hot" if i % 3 else f"s{i % 7}", "en", len(lines), "\n".join(lines), "x", "y", "z"))
    out += [(200, None, None, None, None, None, None, None), (201, None, "de", 0, "", "", "", ""), (202, "Größe", "de", 3, "ß\nß\x00\n", "", "", "")]
    out += [out[3], out[3], (out[4][0], "hot", "de", 5, shared[0] + "\nanother", "", "", "")]
    out += [(None, "hot", "en", 1, shared[1], "", "", ""), (203, "one", "en", 9, "\n".join(shared * 300), "", "", "")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# --- Merkle manifest -------------------------------------------------------------------------------------------------


def levels_of(leaves):
    found = [leaves]
    while len(found[-1]) > 1:
        level = found[-1]
        found.append([digest("".join(level[i : i + 3])) for i in range(0, len(level), 3)])
    return found


def path_of(levels, index):
    path = []
    for level in levels[:-1]:
        start = index // 3 * 3
        path.append((level[start:index], level[index + 1 : start + 3]))
        index //= 3
    return path


def leaf(row, text):
    values = [row[0], row[1], row[2], row[3], text]
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_manifest(rows):
    trees = defaultdict(list)
    for row in rows:
        trees[row[1]].append(((row[0] is not None, row[0] or 0), leaf(row, row[4]), row))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    built = {name: levels_of([x[1] for x in sorted(trees[name], key=lambda x: x[:2])]) for name in names}
    top = levels_of([built[name][-1][0] for name in names])
    out = Counter()
    for at, name in enumerate(names):
        for index, (_, own, row) in enumerate(sorted(trees[name], key=lambda x: x[:2])):
            path = path_of(built[name], index) + path_of(top, at)
            tampered = row[4] is not None and zlib.crc32(str("" if row[0] is None else row[0]).encode()) % 2 == 0
            value = leaf(row, row[4].replace("\n", "")) if tampered else own
            for left, right in path:
                value = digest("".join([*left, value, *right]))
            proof = digest("".join(d for left, right in path for d in left + right))
            out[row[0], own, built[name][-1][0], top[-1][0], proof, value, value == top[-1][0]] += 1
    return out


@pytest.mark.parametrize("height", [1, 2, 7])
def test_manifest(docs, rows, height):
    found = merkle.verify(docs, height)
    expected = plain_manifest(rows)
    assert Counter(map(tuple, found.collect())) == expected
    assert {x[-1] for x in expected} == {True, False}


def test_manifest_of_nothing_and_of_one_row(spark, empty, rows):
    assert merkle.verify(empty).collect() == []
    one = spark.createDataFrame(rows[:1], SCHEMA)
    assert Counter(map(tuple, merkle.verify(one).collect())) == plain_manifest(rows[:1])


def test_manifest_of_one_document_many_times(spark, rows):
    many = [rows[0]] * 40
    assert Counter(map(tuple, merkle.verify(spark.createDataFrame(many, SCHEMA), 2).collect())) == plain_manifest(many)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 8, 9, 10, 26, 27, 28, 40, 100])
def test_log_positions(n):
    leaves = [bytes([i]) * 32 for i in range(n)]
    log = merkle.append_log(leaves, merkle.levels(n))
    levels = levels_of([x.hex() for x in leaves])
    assert len(log) == sum(map(len, levels))
    for height, level in enumerate(levels):
        for index, value in enumerate(level):
            assert log[merkle.position(height, index, n)].hex() == value


# --- line dedup ------------------------------------------------------------------------------------------------------

UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def line_key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(UPPER)


def plain_lines(rows):
    """(doc_id, n_lines, n_dropped, kept) of rows of doc_id and text."""
    holders = defaultdict(set)
    for row in rows:
        for line in (row[4] or "").split("\n"):
            if len(line_key(line)) >= 20:
                holders[line_key(line)].add(row[0])
    rank = lambda i: (i is not None, i or 0)
    top = {k: max(v, key=rank) for k, v in holders.items() if len(v) >= 3}
    out = Counter()
    for row in rows:
        lines = (row[4] or "").split("\n")
        kept = [x for x in lines if top.get(line_key(x), row[0]) == row[0]]
        out[row[0], len(lines), len(lines) - len(kept), "\n".join(kept)] += 1
    return out


def deduped(found):
    at = found.columns[-1]
    return Counter(tuple(r) for r in found.select("doc_id", f"{at}.n_lines", f"{at}.n_dropped", f"{at}.text").collect())


def test_line_dedup(docs, rows, empty):
    found = linededup.dedup(docs.withColumnRenamed("tree", "lines").withColumnRenamed("digest", "h1"))
    assert found.columns[:-1] == ["doc_id", "source", "lang", "n_chars", "text", "lines", "h1", "n"]
    expected = plain_lines(rows)
    assert deduped(found) == expected
    assert sum(x[2] for x in expected) > 100
    assert linededup.dedup(empty).collect() == []


def state(index):
    return Counter(tuple(r) for r in index.counts.select("k1", "k2", "n_docs", "top_doc").collect())


def holds_exactly(index):
    """Every filter holds its shard's repeated keys, and as many fingerprints as these."""
    filters = {r["shard"]: linededup.Cuckoo.load(bytes(r["filter"])) for r in index.filters.collect()}
    keys = defaultdict(list)
    for r in index.counts.where(f"n_docs >= {linededup.MIN_DOCS}").collect():
        keys[r["k2"] % index.shards].append(r["k1"])
    for shard, own in keys.items():
        assert filters[shard].contains(np.array(own, np.int64)).all()
    assert sum(int((f.table > 0).sum()) for f in filters.values()) == sum(map(len, keys.values()))


def test_insertions_and_deletions_are_reversible(spark, docs, rows):
    whole = linededup.LineIndex(spark, shard_keys=2)
    whole.insert(docs)
    first, second = docs.where("doc_id % 2 = 0 OR doc_id IS NULL"), docs.where("doc_id % 2 = 1")
    index = linededup.LineIndex(spark, shard_keys=2)
    index.insert(first)
    early = state(index)
    assert deduped(linededup.dedup(first, index)) == plain_lines([r for r in rows if r[0] is None or r[0] % 2 == 0])
    index.insert(second)
    assert state(index) == state(whole)
    holds_exactly(index)
    assert deduped(linededup.dedup(docs, index)) == plain_lines(rows)
    index.insert(second.limit(5))  # what is there already changes nothing
    assert state(index) == state(whole)
    index.delete(second.select("doc_id"))
    assert state(index) == early
    holds_exactly(index)
    assert deduped(linededup.dedup(first, index)) == plain_lines([r for r in rows if r[0] is None or r[0] % 2 == 0])
    index.delete(spark.createDataFrame([(None,), (999,)], "doc_id bigint"))
    index.insert(second)
    assert deduped(linededup.dedup(docs.where("doc_id IS NOT NULL"), index)) == plain_lines([r for r in rows if r[0] is not None])


def test_cuckoo_filter():
    rng = np.random.default_rng(5)
    keys = rng.integers(-(2**63), 2**63 - 1, 3000, np.int64)
    held = linededup.Cuckoo.empty(3000)
    assert held.insert(keys)
    others = rng.integers(-(2**63), 2**63 - 1, 20000, np.int64)
    assert held.contains(keys).all() and held.contains(others).mean() < 0.001
    held.delete(keys[:2000])
    assert held.contains(keys[2000:]).all() and held.contains(keys[:2000]).mean() < 0.01
    assert int((held.table > 0).sum()) == 1000
    assert linededup.Cuckoo.load(held.dump()).contains(keys[2000:]).all()
    assert not linededup.Cuckoo.empty(4).insert(keys)


# --- ranked search ---------------------------------------------------------------------------------------------------


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def plain_search(rows, items):
    cut = [(row[0], Counter(terms(row[4]))) for row in rows if terms(row[4])]
    total = sum(sum(c.values()) for _, c in cut)
    df = Counter(t for _, c in cut for t in c)
    out = []
    for item, text in items:
        scored = []
        for doc, own in cut:
            m = 25 + 75 * sum(own.values()) * len(cut) // total
            score = 0
            for t in terms(text):
                if t in own:
                    score += math.floor(1000 * math.log((2 * len(cut) + 2) / (2 * df[t] + 1))) * (10**9 * own[t] // (1000 * own[t] + 8 * m))
            if score:
                scored.append((-score, doc is not None, doc or 0, doc))
        out += [(item, rank + 1, x[3], -x[0]) for rank, x in enumerate(sorted(scored)[:10])]
    return Counter(out)


@pytest.fixture(scope="module")
def items(rows):
    rng = random.Random(2)
    found = [(i, " ".join(rng.choices([f"w{i}" for i in range(70)], k=rng.randint(1, 25)))) for i in range(12)]
    return found + [(20, rows[0][4].upper()), (21, None), (22, ""), (23, "?!"), (24, "unheard"), (25, "ß Größe"), (1, "w1 w2 w1"), (1, "w1 w2 w1"), (None, "w3")]


def test_ranked_search(spark, docs, rows, items, empty):
    table = spark.createDataFrame([(*x, "c") for x in items], "item_id bigint, text string, doc_id string")
    found = lexical.search(docs, table)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    expected = plain_search(rows, items)
    assert Counter(map(tuple, found.collect())) == expected
    assert lexical.search(empty, table).collect() == []
    none = lexical.search(docs, table.limit(0))
    assert none.collect() == [] and none.schema == found.schema


def test_copies_share_a_score_and_are_ranked_by_id(spark):
    rows = [(i, None, None, 0, "alpha beta", None, None, None) for i in reversed(range(300))] + [(1000 + i, None, None, 0, f"other {i}", None, None, None) for i in range(700)]
    table = spark.createDataFrame([("x", "beta")], "item_id string, text string")
    found = lexical.search(spark.createDataFrame(rows, SCHEMA).repartition(5), table)
    assert [(r["rank"], r["doc_id"]) for r in found.orderBy("rank").collect()] == [(i + 1, i) for i in range(10)]
    assert Counter(map(tuple, found.collect())) == plain_search(rows, [("x", "beta")])


def test_text_ids(spark):
    rows = spark.createDataFrame([("b", "alpha beta"), ("a", "alpha beta"), (None, "gamma"), ("c", "delta")], "doc_id string, text string")
    found = lexical.search(rows, spark.createDataFrame([("q", "beta")], "item_id string, text string"))
    assert [(r["rank"], r["doc_id"]) for r in found.orderBy("rank").collect()] == [(1, "a"), (2, "b")]


@pytest.mark.parametrize("seed", range(20))
def test_bounds_settle_before_the_lists_end(monkeypatch, seed):
    """The documents that a block names hold the true best with their true scores; all others are below the bar."""
    monkeypatch.setattr(lexical, "FIRST_STEP", 2)
    rng = np.random.default_rng(seed)
    n, n_terms = 400, 12
    counts = rng.integers(1, n_terms, n)
    picked = [np.sort(rng.choice(n_terms, c, replace=False)) for c in counts]
    freqs = rng.integers(1, 6, counts.sum())
    weights = rng.integers(0, 9000, n_terms)
    sizes = rng.integers(5, 50, n)
    block = lexical.Block(list(range(n)), sizes, counts, np.concatenate(picked), freqs, weights, n, int(sizes.sum()))
    item = [(t, int(rng.integers(1, 3))) for t in range(0, n_terms, 2)]
    scores, at = Counter(), 0
    for doc in range(n):
        m = 25 + 75 * int(sizes[doc]) * n // int(sizes.sum())
        for t in picked[doc]:
            scores[doc] += dict(item).get(int(t), 0) * int(weights[t]) * (10**9 * int(freqs[at]) // (1000 * int(freqs[at]) + 8 * m))
            at += 1
    best = sorted(scores.values(), reverse=True)[:10]
    found = block.search(item, [])
    assert all(scores[d] == s for s, d in found)
    assert {d for _, d in found} == {d for d, s in scores.items() if s >= best[-1] and s > 0}
    assert block.search(item, [best[0] + 1] * 10) == []


def test_large_products_stay_exact():
    sizes = np.array([10, 10**9], np.int64)
    assert lexical.length_part(sizes, 10**10, 10**13).tolist() == [25 + 75 * int(n) * 10**10 // 10**13 for n in sizes]
