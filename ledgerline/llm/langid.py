"""Language identification by nearest centroids.

A text's vector counts hashed n-grams of 1 to 3 bytes of its lower-cased letters (all else is one space), damped and weighted
by inverse document frequency and normalised. Each language has several centroids, found by spherical k-means on a sample of
SAMPLE_PER_LANGUAGE different training texts at most in expectation (the only sampled step; document frequencies and counts
come from all training rows). Texts are drawn by their hash at a rate set by the language's different texts, so copies
neither crowd the sample nor thin it, and a language of few texts gives all of them. The prediction is the language of the centroid with the largest cosine, and the score is that cosine.
A text is rejected if it is further from every centroid than REJECT_SHARE of what the language's sample shows, or has no
letter (`und`, score 0; null texts too). A rejected text keeps its nearest language, for callers that want one.

Without any training row everything is `und` and rejected. Rows are scored one by one, so repeated rows score alike.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import free_name

BITS = 13
SIZE = 1 << BITS
#: Bounds of the fitted model: rows per language, centroids per language, languages.
SAMPLE_PER_LANGUAGE, CENTROIDS, MAX_LANGUAGES = 256, 4, 400
KMEANS_ROUNDS = 10
REJECT_SHARE = 0.2
UNKNOWN = "und"
_LETTERS = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_LETTER = re.compile(r"[^\W\d_]")
RESULT = "struct<lang: string, score: double, rejected: boolean>"
_ARROW = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])


def counts(text: bytes) -> np.ndarray:
    """Counts of hashed n-grams of a lower-cased text."""
    clean = b" ".join(text.translate(_LETTERS).split())
    a = np.frombuffer(b" " + clean + b" ", dtype=np.uint8).astype(np.uint32)
    codes = [a + np.uint32(1 << 24)]
    if len(a) > 1:
        codes.append((a[:-1] << np.uint32(8)) + a[1:] + np.uint32(2 << 24))
    if len(a) > 2:
        codes.append((codes[1][:-1] << np.uint32(8)) + a[2:])
    hashed = (np.concatenate(codes) * np.uint32(2654435769)) >> np.uint32(32 - BITS)
    return np.bincount(hashed, minlength=SIZE)


def vectors(texts: list[bytes], idf: np.ndarray) -> np.ndarray:
    x = np.log1p(np.stack([counts(t) for t in texts]).astype(np.float32)) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def lowered(texts: pa.Array) -> list[bytes]:
    return [x or b"" for x in pc.utf8_lower(texts).cast(pa.binary()).to_pylist()]


def centroids_of(x: np.ndarray, k: int = CENTROIDS) -> np.ndarray:
    """Spherical k-means; the first centres are the rows that are furthest from those before."""
    centres = [x.mean(axis=0)]
    for _ in range(min(k, len(x)) - 1):
        centres.append(x[np.argmin(np.max(x @ np.stack(centres).T, axis=1))])
    c = np.stack(centres)
    for _ in range(KMEANS_ROUNDS):
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        nearest = np.argmax(x @ c.T, axis=1)
        c = np.stack([x[nearest == j].mean(axis=0) if (nearest == j).any() else c[j] for j in range(len(c))])
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)


@dataclass
class Model:
    idf: np.ndarray
    centroids: np.ndarray
    languages: list[str]
    limits: np.ndarray  # the cosine below which a text is rejected, of each centroid

    def predict(self, texts: pa.Array) -> Iterator[dict]:
        low = lowered(texts)
        for start in range(0, len(low), 128):
            part = low[start : start + 128]
            scores = vectors(part, self.idf) @ self.centroids.T if len(self.centroids) else np.zeros((len(part), 0))
            for text, row in zip(part, scores):
                if not len(row) or not _LETTER.search(text.decode("utf-8", "replace")):
                    yield {"lang": UNKNOWN, "score": 0.0, "rejected": True}
                    continue
                best = int(np.argmax(row))
                yield {"lang": self.languages[best], "score": float(min(1.0, max(0.0, row[best]))), "rejected": bool(row[best] < self.limits[best])}


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found, n = np.zeros(SIZE, dtype=np.int64), 0
    for batch in batches:
        for text in lowered(batch.column(0)):
            found += counts(text) > 0
            n += 1
    dims = np.flatnonzero(found)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(dims, -1), pa.int32()), pa.array(np.append(found[dims], n), pa.int64())], names=["dim", "df"])


def fit(rows: DataFrame) -> Model:
    """A model from rows (text, lang); rows without text or lang are left out."""
    spark = rows.sparkSession
    rows = rows.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", "lang")
    different = rows.select("lang", F.xxhash64("text").alias("hash")).distinct()
    per = different.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()
    if len(per) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    df = np.zeros(SIZE + 1, dtype=np.int64)
    for r in rows.select("text").mapInArrow(_document_frequencies, "dim int, df bigint").groupBy("dim").agg(F.sum("df").alias("df")).collect():
        df[r["dim"]] = r["df"]  # the last is the number of rows
    idf = np.log((1 + df[-1]) / (1 + df[:-1])).astype(np.float32) + 1
    shared = spark.sparkContext.broadcast(idf)
    if not per:
        return Model(idf, np.zeros((0, SIZE), dtype=np.float32), [], np.zeros(0))
    chance = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / float(1 << 30)
    wanted = [(F.col("lang") == r["lang"]) & (chance * r["count"] < SAMPLE_PER_LANGUAGE) for r in per]
    condition = wanted[0]
    for w in wanted[1:]:
        condition = condition | w

    def cluster(rows: pd.DataFrame) -> pd.DataFrame:
        texts = [t.lower().encode("utf-8", "replace") for t in rows["text"] if _LETTER.search(t)]
        if not texts:
            return pd.DataFrame({"lang": [], "centroid": [], "cut": []})
        x = vectors(sorted(texts), shared.value)
        c = centroids_of(x)
        cut = float(np.quantile(np.max(x @ c.T, axis=1), 0.5)) * REJECT_SHARE
        return pd.DataFrame({"lang": rows["lang"].iloc[0], "centroid": list(c), "cut": cut})

    found = sorted(rows.where(condition).distinct().groupBy("lang").applyInPandas(cluster, "lang string, centroid array<float>, cut double").collect(), key=lambda r: (r["lang"], r["centroid"]))
    table = np.array([r["centroid"] for r in found], dtype=np.float32).reshape(-1, SIZE)
    return Model(idf, table, [r["lang"] for r in found], np.array([r["cut"] for r in found]))


def identify(docs: DataFrame, training: DataFrame) -> DataFrame:
    """docs with a last struct column: lang (predicted), score, rejected; training has text and lang."""
    model = docs.sparkSession.sparkContext.broadcast(fit(training))

    @F.arrow_udf(RESULT)
    def predict(texts: pa.Array) -> pa.Array:
        return pa.array(list(model.value.predict(texts)), _ARROW)

    return docs.withColumn(free_name(docs, "language"), predict("text"))


def keep_identified(docs: DataFrame, training: DataFrame) -> DataFrame:
    """The rows of docs whose language is recognised, with docs' own columns."""
    named = identify(docs, training)
    return named.where(~F.col(named.columns[-1])["rejected"]).select(*docs.columns)
