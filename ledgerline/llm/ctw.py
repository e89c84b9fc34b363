"""Language-model scoring by context-tree weighting over bytes.

A byte is eight binary decisions. Every context (the bytes before, 0 to DEPTH of them) holds, for each decision, a
Krichevsky-Trofimov estimate; a node's weighted probability is half its own estimate and half the product of its children's,
so the mixture runs over all depths. Counts of (context, byte) come from all training rows, and every context that occurs is
in the tree, so it grows with the corpus. The tree is a table: subtrees are weighted by Spark's tasks, bottom up, and their
sums give the weights of the short contexts, which go down again. Weights and estimates are fixed after training, so each
(context, byte) of any text has one log10 probability, and a text's is the sum over its bytes and its end. The most used ones,
at most HOT_GRAMS, are broadcast; occurrences of all others are joined with the table. For each decision the path ends at the
deepest context that has seen it, which takes the weight that is left. Code length per byte is -score * log2(10) / bytes.

The word-unigram base looks up tokens: those that make up one in HOT of all tokens at least (at most HOT of them) are
broadcast, occurrences of all others are joined with the token counts.

A null text is empty: its only token and its only symbol is the end. A NUL byte in a text is read as byte 1. Without
training rows every symbol has probability 1/256. Repeated rows are scored alike and all count in training.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import saved, text_bytes

DEPTH = 5
#: Contexts of up to so many bytes are weighted on the driver, from sums.
TOP = 2
#: Broadcast at most: codes of (context, byte), and tokens.
HOT_GRAMS = 1 << 20
HOT = 500_000
#: Codes in a task's arrays at once where they are counted and where they are scored, and codes of whole groups.
CHUNK = 4 << 20
SCORED = 1 << 18
GROUP_ROWS = 1 << 17
END = b"\n"  # no word holds white space, so this names the end token
_FLUSH = 250_000


def plain(text: bytes) -> bytes:
    return text.replace(b"\0", b"\1")


# ---- counting


def _mask(depth: int) -> int:
    """Bits of a context of depth bytes and the byte after it."""
    return (1 << 8 * (depth + 1)) - 1


def gram_codes(texts: list[bytes], chunk: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Codes (DEPTH bytes of context, byte) of the texts' bytes and ends, and the text of each; about chunk codes at a time.

    Zero bytes stand before a text, and one is its end. A text longer than a chunk is cut, with its context before each piece.
    """
    pad, held, owners, sizes, n_held = b"\0" * DEPTH, [], [], [], 0

    def flush() -> tuple[np.ndarray, np.ndarray]:
        a = np.frombuffer(b"".join(held), dtype=np.uint8)
        codes = np.zeros(len(a) - DEPTH, dtype=np.int64)
        for i in range(DEPTH + 1):
            codes <<= 8
            codes |= a[i : len(a) - DEPTH + i]
        begins = np.cumsum(np.asarray(sizes[:-1], dtype=np.int64) + DEPTH)  # of the pieces after the first
        inside = np.ones(len(codes), dtype=bool)
        inside[(begins[:, None] - np.arange(1, DEPTH + 1)).ravel()] = False
        return codes[inside], np.repeat(np.asarray(owners), sizes)

    for owner, text in enumerate(texts):
        whole = pad + plain(text) + b"\0"
        for start in range(DEPTH, len(whole), chunk):
            piece = whole[start - DEPTH : start + chunk]
            held.append(piece)
            owners.append(owner)
            sizes.append(len(piece) - DEPTH)
            n_held += sizes[-1]
            if n_held >= chunk:
                yield flush()
                held, owners, sizes, n_held = [], [], [], 0
    if held:
        yield flush()


def _count_ngrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, flags, size = [], [], 0

    def rows() -> Iterator[pa.RecordBatch]:
        trained = np.asarray(flags, dtype=np.int64)
        for codes, owner in gram_codes(held, CHUNK):
            codes <<= 1
            codes |= trained[owner]
            codes, uses = np.unique(codes, return_counts=True)
            n = np.where(codes & 1, uses, 0)
            yield pa.RecordBatch.from_arrays([pa.array(codes >> 1), pa.array(n), pa.array(uses)], names=["code", "n", "uses"])

    for batch in batches:
        for text, flag in zip(text_bytes(batch.column(0)), batch.column(1).to_pylist()):
            held.append(text)
            flags.append(flag)
            size += len(text) + 1
            if size >= CHUNK:
                yield from rows()
                held, flags, size = [], [], 0
    if held:
        yield from rows()


def _token_rows(found: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([_hash(w) for w in found], pa.int64()), pa.array(list(found.values()), pa.int64())], names=["token", "n"])


def _hash(word: bytes) -> int:
    x = xxhash.xxh64_intdigest(word)
    return x - (1 << 64) if x >> 63 else x


def _count_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: Counter = Counter()
    for batch in batches:
        for text in text_bytes(batch.column(0)):
            found.update(text.lower().split())
            found[END] += 1
            if len(found) > _FLUSH:
                yield _token_rows(found)
                found = Counter()
    if found:
        yield _token_rows(found)


def token_counts(texts: DataFrame) -> DataFrame:
    """(token, n) of the lower-cased words and ends of all texts; a token goes by its 64-bit hash."""
    return texts.select("text").mapInArrow(_count_tokens, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n"))


# ---- the tree


def lgamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function, by Stirling's series from 8 on."""
    shift = np.zeros_like(x)
    for i in range(8):
        shift += np.log(x + i)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def kt_log(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of sequences with a zeros and b ones."""
    return np.where(a + b > 0, lgamma(a + 0.5) + lgamma(b + 0.5) - lgamma(a + b + 1.0) - math.log(math.pi), 0.0)


def _ladder(codes: np.ndarray, n: np.ndarray, low: int, high: int) -> dict[int, tuple]:
    """By depth: sorted (context, byte) keys, their training counts, and the place of each in the depth above (None at low)."""
    rows = {}
    for d in range(high, low - 1, -1):
        if d == low:
            rows[d] = (codes, n, None)
            break
        upper, up = np.unique(codes & _mask(d - 1), return_inverse=True)
        rows[d] = (codes, n, up)
        codes, n = upper, np.bincount(up, n, minlength=len(upper))
    return rows


def _node_keys(keys: np.ndarray, level: int) -> np.ndarray:
    """Number of the decision at a level on the way to a key's byte, below the key's context."""
    return (keys >> 8 << 8) | (1 << level) | ((keys & 255) >> (8 - level))


@dataclass
class _Nodes:
    """Decisions of one depth and level: first row of each, the decision of each row, and per decision its estimates."""

    starts: np.ndarray
    of: np.ndarray
    seen: np.ndarray
    one: np.ndarray
    share: np.ndarray
    weighted: np.ndarray


def _weigh(rows: dict[int, tuple], level: int, below: tuple[np.ndarray, np.ndarray] | None) -> dict[int, _Nodes]:
    """Estimates and weights bottom up. below: sorted decisions and sums of their children's weighted logs, under the last depth."""
    out: dict[int, _Nodes] = {}
    for d in sorted(rows, reverse=True):
        keys, n, _ = rows[d]
        names = _node_keys(keys, level)
        first = np.concatenate((np.ones(min(1, len(names)), dtype=bool), names[1:] != names[:-1]))
        starts, of = np.flatnonzero(first), np.cumsum(first) - 1
        total = np.bincount(of, n, minlength=len(starts))
        ones = np.bincount(of, n * ((keys >> (7 - level)) & 1), minlength=len(starts))
        own = kt_log(total - ones, ones)
        kids = None
        if d + 1 in out:
            lower = out[d + 1]
            kids = np.bincount(of[rows[d + 1][2][lower.starts]], lower.weighted, minlength=len(starts))
        elif below is not None:
            kids = np.zeros(len(starts))
            if len(below[0]):
                at = np.minimum(np.searchsorted(below[0], names[starts]), len(below[0]) - 1)
                kids = np.where(below[0][at] == names[starts], below[1][at], 0.0)
        share = np.ones(len(starts)) if kids is None else 1 / (1 + np.exp(np.clip(kids - own, -700, 700)))
        weighted = own if kids is None else np.logaddexp(own, kids) - math.log(2)
        out[d] = _Nodes(starts, of, total > 0, (ones + 0.5) / (total + 1.0), share, weighted)
    return out


def _descend(rows: dict[int, tuple], nodes: dict[int, _Nodes], state: np.ndarray) -> np.ndarray:
    """From the state of the decisions of the first depth, as they come from above, to that of the last depth.

    A state is (what shallower contexts give a one, weight that is left, estimate of the deepest context that has seen the decision).
    """
    for d in sorted(rows):
        here = nodes[d]
        if d - 1 in rows:
            state = state[:, nodes[d - 1].of[rows[d][2][here.starts]]]
        carried, room, last = state
        used = np.where(here.seen, here.share, 0.0) * room
        state = np.stack((carried + used * here.one, room - used, np.where(here.seen, here.one, last)))
    return state


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Codes in ascending order, training counts and uses of some whole groups at a time; rows come sorted by group."""
    held, size, limit = [], 0, GROUP_ROWS

    def cut(parts: list, end: int) -> tuple:
        order = np.argsort(parts[1][:end])
        return tuple(x[:end][order] for x in parts[1:])

    for batch in batches:
        held.append([batch.column(c).to_numpy() for c in ("top", "code", "n", "uses")])
        size += batch.num_rows
        if size < limit:
            continue
        joined = [np.concatenate(x) for x in zip(*held)]
        end = int(np.searchsorted(joined[0], joined[0][-1]))
        if end:
            yield cut(joined, end)
        held, size = [[x[end:].copy() for x in joined]], len(joined[0]) - end
        limit = max(GROUP_ROWS, 2 * size)
    if size:
        yield cut([np.concatenate(x) for x in zip(*held)], size)


def gram_logs(docs: DataFrame, training: Column) -> DataFrame:
    """(code, uses, logp): log10 probability of each byte after DEPTH others that the texts hold, by the tree of the training rows.

    Every context of every depth is in the tree. A subtree (all contexts with the same last bytes, one more than TOP) is
    weighted in one task, at most 2^24 codes whatever the input; depths 0 to TOP are weighted from their sums, at most 2^24 codes too.
    """
    spark, depth, top = docs.sparkSession, DEPTH, min(TOP, DEPTH - 1)
    flagged = docs.select("text", F.coalesce(training, F.lit(False)).alias("training"))
    counted = flagged.mapInArrow(_count_ngrams, "code bigint, n bigint, uses bigint")
    grams = saved(counted.groupBy("code").agg(F.sum("n").alias("n"), F.sum("uses").alias("uses")), "ctw-counts")
    by_top = grams.withColumn("top", F.shiftright("code", 8).bitwiseAND(F.lit((1 << 8 * (top + 1)) - 1)))
    by_top = by_top.repartition("top").sortWithinPartitions("top")

    def weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for codes, n, _ in _whole_groups(batches):
            rows = _ladder(codes, n, top + 1, depth)
            for level in range(8):
                here = _weigh(rows, level, None)[top + 1]
                names, of = np.unique(_node_keys(rows[top + 1][0][here.starts] & _mask(top), level), return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(np.bincount(of, here.weighted, minlength=len(names)))], names=["node", "weighted"])

    below = by_top.mapInArrow(weights, "node bigint, weighted double").groupBy("node").agg(F.sum("weighted").alias("weighted")).toArrow().sort_by("node")
    below = (below.column("node").to_numpy(), below.column("weighted").to_numpy())
    short = grams.groupBy(F.col("code").bitwiseAND(F.lit(_mask(top))).alias("code")).agg(F.sum("n").alias("n")).toArrow().sort_by("code")
    rows = _ladder(short.column("code").to_numpy(), short.column("n").to_numpy(), 0, top)
    names, states = [], []
    for level in range(8):
        nodes = _weigh(rows, level, below)
        start = np.tile(np.array([[0.0], [1.0], [0.5]]), len(nodes[0].starts))
        states.append(_descend(rows, nodes, start))
        names.append(_node_keys(rows[top][0][nodes[top].starts], level))
    order = np.argsort(np.concatenate(names))
    above = spark.sparkContext.broadcast((np.concatenate(names)[order], np.concatenate(states, axis=1)[:, order]))

    def logs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upper, state = above.value
        for codes, n, uses in _whole_groups(batches):
            rows = _ladder(codes, n, top + 1, depth)
            out = np.zeros(len(codes))
            for level in range(8):
                nodes = _weigh(rows, level, None)
                parents = _node_keys(rows[top + 1][0][nodes[top + 1].starts] & _mask(top), level)
                carried, room, last = _descend(rows, nodes, state[:, np.searchsorted(upper, parents)])
                one = (carried + room * last)[nodes[depth].of]
                out += np.log10(np.where((codes >> (7 - level)) & 1, one, 1 - one))
            yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(uses), pa.array(out)], names=["code", "uses", "logp"])

    return saved(by_top.mapInArrow(logs, "code bigint, uses bigint, logp double"), "ctw-logs")


def hot_bar(logs: DataFrame) -> int:
    """Bucket of uses from which on codes are hot, so that at most HOT_GRAMS of them are."""
    buckets = logs.groupBy(_bucket().alias("bucket")).agg(F.count(F.lit(1)).alias("n")).collect()  # 16 buckets an octave
    bar, taken = 1 << 20, 0
    for row in sorted(buckets, key=lambda r: -r["bucket"]):
        taken += row["n"]
        if taken > HOT_GRAMS:
            break
        bar = row["bucket"]
    return bar


def _bucket() -> Column:
    return F.floor(F.log2("uses") * 16)


# ---- scoring


RESULT = "struct<n_tokens: bigint, n_hot: bigint, hot_score: double, rare: array<bigint>, hot_logp: double, grams: array<bigint>>"
_ARROW = pa.struct([("n_tokens", pa.int64()), ("n_hot", pa.int64()), ("hot_score", pa.float64()), ("rare", pa.list_(pa.int64())), ("hot_logp", pa.float64()), ("grams", pa.list_(pa.int64()))])


class _Hot:
    """Logs of hot codes or tokens by an open-addressed table of their places; a place of 0 is a free slot."""

    def __init__(self, codes: np.ndarray, logs: np.ndarray):
        bits = max(10, int(4 * len(codes)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.codes, self.logs = np.concatenate(([-1], codes)), np.concatenate(([0.0], logs))
        self.slots = np.zeros(1 << bits, dtype=np.int32)
        left, at = np.arange(1, len(codes) + 1, dtype=np.int32), self._first(codes)
        while len(left):
            free = self.slots[at] == 0
            self.slots[at[free]] = left[free]  # of several for one slot the last stays
            out = self.slots[at] != left
            left, at = left[out], (at[out] + 1) & self.mask

    def _first(self, codes: np.ndarray) -> np.ndarray:
        return ((codes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def places(self, codes: np.ndarray) -> np.ndarray:
        """Place of each code, 0 of those that are not hot."""
        at = self._first(codes)
        place = self.slots[at]
        left = np.flatnonzero((self.codes[place] != codes) & (place > 0))
        while len(left):
            at[left] = (at[left] + 1) & self.mask
            place[left] = self.slots[at[left]]
            found = place[left]
            left = left[(found > 0) & (self.codes[found] != codes[left])]
        return place


def token_hashes(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of the words and ends of all texts, and the text of each."""
    words = [[*text.lower().split(), END] for text in texts]
    sizes = [len(x) for x in words]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, chain.from_iterable(words)), np.uint64, sum(sizes))
    yield hashes.view(np.int64), np.repeat(np.arange(len(texts)), sizes)


def _sums(found: Iterator[tuple[np.ndarray, np.ndarray]], hot: _Hot, n: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Of each of n texts: the sum of its hot codes' logs, how many those are, and its other codes."""
    sums, known, others = np.zeros(n), np.zeros(n, dtype=np.int64), [[] for _ in range(n)]
    for codes, owner in found:
        place = hot.places(codes)
        sums += np.bincount(owner, hot.logs[place], minlength=n)
        known += np.bincount(owner[place > 0], minlength=n)
        cold = np.flatnonzero(place == 0)
        for i, values in zip(*_runs(owner[cold], codes[cold])):
            others[i].append(values)
    return sums, known, [np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in others]


def _runs(owner: np.ndarray, values: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    """Values of each owner; owners ascend."""
    owners, starts = np.unique(owner, return_index=True)
    return owners.tolist(), np.split(values, starts[1:])


def score(docs: DataFrame, training: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; training tells the rows that are learned from."""
    spark = docs.sparkSession
    train = docs.where(training)
    tokens = saved(token_counts(train), "lm-tokens")
    total, distinct = tokens.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    floor = math.log10(total + 0.1 * (distinct + 1))
    hot = tokens.where(F.col("n") * HOT >= total).toArrow()
    hot = spark.sparkContext.broadcast(_Hot(hot.column("token").to_numpy(), np.log10(hot.column("n").to_numpy() + 0.1) - floor))
    by_code = gram_logs(docs, training)
    bar = hot_bar(by_code)
    grams = by_code.where(_bucket() >= bar).select("code", "logp").toArrow()
    grams = spark.sparkContext.broadcast(_Hot(grams.column("code").to_numpy(), grams.column("logp").to_numpy()))

    @F.arrow_udf(RESULT)
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            parts = []
            for start in range(0, len(batch), 512):
                texts = text_bytes(batch.slice(start, 512))
                words = _sums(token_hashes(texts), hot.value, len(texts))
                logp, _, others = _sums(gram_codes(texts, SCORED), grams.value, len(texts))
                n_tokens = [n + len(rare) for n, rare in zip(words[1].tolist(), words[2])]
                columns = (n_tokens, words[1], words[0], words[2], logp, others)
                parts.append(pa.StructArray.from_arrays([pa.array(x, f.type) for x, f in zip(columns, _ARROW)], fields=list(_ARROW)))
            yield pa.concat_arrays(parts)

    key = F.xxhash64("doc_id", "text").alias("key")
    rows = docs.select("doc_id", (~training).alias("held_out"), key, scored("text").alias("at"))
    rows = saved(rows.select("doc_id", "held_out", "key", "at.*"), "lm-rows")
    same = rows.groupBy("key").agg(F.count(F.lit(1)).alias("rows_of_key"))  # repeated rows share a key, and their sums
    rare = rows.select("key", F.explode("rare").alias("token"))
    cold = tokens.where(F.col("n") * HOT < total)
    joined = rare.join(cold, "token", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    sums = joined.groupBy("key").agg(F.sum(F.log10(F.col("n") + 0.1) - F.lit(floor)).alias("cold_score"), F.sum((F.col("n") > 0).cast("bigint")).alias("n_cold"))
    others = rows.select("key", F.explode("grams").alias("code")).join(by_code.where(_bucket() < bar).select("code", "logp"), "code")
    others = others.groupBy("key").agg(F.sum("logp").alias("cold_logp"))
    out = rows.drop("rare", "grams").join(same, "key").join(sums, "key", "left").join(others, "key", "left")
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_hot") + F.coalesce(F.expr("n_cold div rows_of_key"), F.lit(0))).alias("n_known"),
        F.lit(total).cast("bigint").alias("train_tokens"),
        (F.col("hot_score") + F.coalesce(F.col("cold_score") / F.col("rows_of_key"), F.lit(0.0))).alias("base_score"),
        (F.col("hot_logp") + F.coalesce(F.col("cold_logp") / F.col("rows_of_key"), F.lit(0.0))).alias("score"),
    )
