"""Quality scoring by a factorisation machine.

Features of a text: its lower-cased words hashed to WORD_BITS bits (counts, of length one together), structure statistics
(standardised) and metadata of its size (number of words and lines by powers of two, one each). The machine adds a bias, linear weights
and low-rank pairwise interactions, worked out in time linear in the features: half of the squared sums less the sums of
squares, per factor. It is fitted with logistic loss by adaptive steps on a sample of about SAMPLE labelled rows (the bound
of the fit; every text is scored whole).

Null and empty texts have no words and the statistics zero; they are scored like any other. Labels that are null are left
out, several labels of one doc_id count by their mean; without labels every score is 0.5. Repeated rows score alike, and
train as one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import free_name, text_bytes

SAMPLE = 6000
WORD_BITS = 16
FACTORS = 8
EPOCHS, BATCH_ROWS, RATE, DECAY = 8, 64, 0.05, 1e-5
#: Powers of two that are told apart for words and for lines.
SIZES = 20
STATISTICS = 14
WORDS = 1 << WORD_BITS
DIMENSIONS = WORDS + STATISTICS + 2 * SIZES
_CLASS = np.zeros(256, dtype=np.int64)  # 0 lower case and other, then: upper, digit, space, sentence marks, symbols, bytes of other alphabets
_CLASS[65:91], _CLASS[48:58], _CLASS[[9, 10, 11, 12, 13, 32]] = 1, 2, 3
_CLASS[[ord(c) for c in ".,;:!?'\"()-"]] = 4
_CLASS[[ord(c) for c in "#*$%&|<>@^~_=+/\\[]{}`"]] = 5
_CLASS[128:] = 6


class _Slots(dict):
    """Hashed word numbers; a cache of bounded size."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = x = xxhash.xxh32_intdigest(word) >> (32 - WORD_BITS)
        return x


def features(text: bytes, slots: _Slots) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and values of a text's features; statistics are raw."""
    words = text.lower().split()
    n = len(words)
    found, counts = np.unique(np.fromiter(map(slots.__getitem__, words), np.int64, n), return_counts=True)
    counts = counts / max(1e-9, math.sqrt(float(np.dot(counts, counts))))
    lines = [x for x in text.split(b"\n") if x.strip()]
    shares = np.bincount(_CLASS[np.frombuffer(text, dtype=np.uint8)], minlength=7) / max(1, len(text))
    lengths = np.fromiter(map(len, words), np.int64, n)
    statistics = [
        *shares[1:],
        math.log1p(n),
        lengths.mean() if n else 0.0,
        lengths.std() if n else 0.0,
        len(found) / n if n else 0.0,
        1 - len(set(lines)) / len(lines) if lines else 0.0,
        math.log1p(n / len(lines)) if lines else 0.0,
        sum(w.endswith((b".", b",", b"!", b"?")) for w in words) / n if n else 0.0,
        float(counts.max()) if n else 0.0,
    ]
    size = [min(SIZES - 1, n.bit_length()), SIZES + min(SIZES - 1, len(lines).bit_length())]
    numbers = np.concatenate((found, np.arange(WORDS, WORDS + STATISTICS), WORDS + STATISTICS + np.array(size)))
    return numbers, np.concatenate((counts, statistics, [1.0, 1.0]))


@dataclass
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def standardise(self, values: np.ndarray) -> np.ndarray:
        out = values.copy()
        at = slice(len(values) - STATISTICS - 2, len(values) - 2)
        out[at] = np.clip((values[at] - self.mean) * self.scale, -4, 4)
        return out

    def score(self, numbers: np.ndarray, values: np.ndarray) -> float:
        x = self.standardise(values)
        weighted = self.factors[numbers] * x[:, None]
        z = self.bias + float(self.linear[numbers] @ x) + 0.5 * float((weighted.sum(axis=0) ** 2 - (weighted**2).sum(axis=0)).sum())
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> Machine:
    rng = np.random.default_rng(7)
    machine = Machine(0.0, np.zeros(DIMENSIONS), rng.normal(0, 0.01, (DIMENSIONS, FACTORS)), np.zeros(STATISTICS), np.ones(STATISTICS))
    if not len(rows):
        machine.factors[:] = 0
        return machine
    raw = np.stack([v[-STATISTICS - 2 : -2] for _, v in rows])
    machine.mean, machine.scale = raw.mean(axis=0), 1 / np.maximum(raw.std(axis=0), 1e-6)
    data = [(n, machine.standardise(v)) for n, v in rows]
    share = min(0.999, max(0.001, float(labels.mean())))
    machine.bias = math.log(share / (1 - share))
    seen_linear, seen_factors, seen_bias = np.full(DIMENSIONS, 1e-8), np.full((DIMENSIONS, FACTORS), 1e-8), 1e-8
    for _ in range(EPOCHS):
        order = rng.permutation(len(data))
        for start in range(0, len(order), BATCH_ROWS):
            part = order[start : start + BATCH_ROWS]
            sizes = np.array([len(data[i][0]) for i in part])
            numbers, x = np.concatenate([data[i][0] for i in part]), np.concatenate([data[i][1] for i in part])
            begins = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            factors = machine.factors[numbers]
            weighted = factors * x[:, None]
            sums = np.add.reduceat(weighted, begins, axis=0)
            squares = np.add.reduceat(weighted**2, begins, axis=0)
            z = machine.bias + np.add.reduceat(machine.linear[numbers] * x, begins) + 0.5 * (sums**2 - squares).sum(axis=1)
            error = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - labels[part]) / len(part)
            spread = np.repeat(error, sizes) * x
            slope = spread[:, None] * (np.repeat(sums, sizes, axis=0) - weighted)
            by = np.argsort(numbers, kind="stable")
            first = np.flatnonzero(np.diff(numbers[by], prepend=-1))
            at = numbers[by][first]
            linear = np.add.reduceat(spread[by], first) + DECAY * machine.linear[at]
            pairs = np.add.reduceat(slope[by], first, axis=0) + DECAY * machine.factors[at]
            seen_linear[at] += linear**2
            seen_factors[at] += pairs**2
            seen_bias += error.sum() ** 2
            machine.linear[at] -= RATE * linear / np.sqrt(seen_linear[at])
            machine.factors[at] -= RATE * pairs / np.sqrt(seen_factors[at])
            machine.bias -= RATE * error.sum() / math.sqrt(seen_bias)
    return machine


def fit(docs: DataFrame, labels: DataFrame) -> Machine:
    """docs: doc_id, text; labels: doc_id, quality."""
    named = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.avg("quality").alias("quality"))
    n = named.count()
    chance = F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1 << 30)) / float(1 << 30)
    few = named.where(chance * n < SAMPLE)

    @F.arrow_udf("struct<numbers: array<int>, values: array<double>>")
    def described(texts: pa.Array) -> pa.Array:
        slots = _Slots()
        rows = [features(t, slots) for t in text_bytes(texts)]
        return pa.array([{"numbers": a.astype(np.int32), "values": v} for a, v in rows], pa.struct([("numbers", pa.list_(pa.int32())), ("values", pa.list_(pa.float64()))]))

    table = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").distinct().select("doc_id", "quality", described("text").alias("f")).select("doc_id", "quality", "f.*").toArrow().sort_by("doc_id")
    rows = [(np.asarray(a.values, dtype=np.int64), np.asarray(v.values)) for a, v in zip(table.column("numbers"), table.column("values"))]
    return train(rows, (table.column("quality").to_numpy() >= 0.5).astype(np.float64))


def score(docs: DataFrame, training: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with a last column: the score, 0 to 1."""
    machine = docs.sparkSession.sparkContext.broadcast(fit(training, labels))

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        slots = _Slots()
        for texts in batches:
            yield pa.array([machine.value.score(*features(t, slots)) for t in text_bytes(texts)], pa.float64())

    return docs.withColumn(free_name(docs, "quality_score"), scored("text"))
