"""Quality rules with robust multivariate outliers: minimum covariance determinant per language and source.

Statistics of every whole text give a vector of logarithms of shares. For each language and source the estimate starts from
medians and median deviations of each coordinate and takes concentration steps: distances of all rows, their quantile HALF
(the half that breaks down last: nearly half of a group may be odd), mean and covariance of the rows within; the determinant falls with each step. One reweighting step follows, and texts whose
squared Mahalanobis distance exceeds the chi-square quantile of CUT are rejected. All rows count in all steps; Spark sums
moments and quantile sketches per group, and only the small matrices are inverted row by row of the table of groups.

Rows that fail the base rules are rejected outright and do not count in estimates. A group of under LEAST rows is judged
with its language, and where that has fewer too, with all rows. FLOOR bounds the variance from below, in every
direction of the space scaled by it: what is larger stays as it is, and a statistic that never varies rejects nothing by trifles. Null texts have no words and fail the base rules; null languages or sources
form a group of their own; repeated rows are all counted and all returned.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import lookup, saved, text_bytes

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
HALF, STEPS = 0.5, 4
CUT = 0.999
REWEIGHT = 0.975
LEAST = 60
_SPACE = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"
#: Of each coordinate: what is added to the share before its logarithm, and the least standard deviation: what a line, a word or
#: a few characters more or less make in a text of usual length.
OFFSETS = {"word_length": 0.0, "symbols": 0.01, "dup_lines": 0.1, "repeats": 0.1, "upper": 0.02, "distinct": 0.05}
FLOOR = {"word_length": 0.05, "symbols": 0.2, "dup_lines": 0.2, "repeats": 0.2, "upper": 0.1, "distinct": 0.05}
NAMES = list(OFFSETS)
D = len(NAMES)
RESULT = "struct<n_words: bigint, word_chars: bigint, n_symbols: bigint, n_dup_lines: bigint, n_repeat_words: bigint, n_lines: bigint, n_upper: bigint, n_distinct: bigint>"
_FIELDS = [x.split(":")[0] for x in RESULT[7:-1].split(", ")]
_ARROW = pa.struct([(x, pa.int64()) for x in _FIELDS])


def repeated_words(numbers: np.ndarray, size: int = 3) -> int:
    """Words in windows that are found twice or more; numbers tell the words of a text apart."""
    n = len(numbers) - size + 1
    if n < 2:
        return 0
    top = int(numbers.max()) + 1
    codes = numbers[:n]
    for i in range(1, size):
        _, codes = np.unique(codes, return_inverse=True) if i > 1 else (None, codes)
        codes = codes.astype(np.int64) * top + numbers[i : n + i]
    _, which, counts = np.unique(codes, return_inverse=True, return_counts=True)
    covered = np.zeros(len(numbers) + 1, dtype=np.int64)
    starts = np.flatnonzero(counts[which] > 1)
    covered[starts] += 1
    covered[starts + size] -= 1
    return int((np.cumsum(covered[:-1]) > 0).sum())


def statistics(text: bytes) -> dict:
    words = text.split()
    known: dict[bytes, int] = {}
    numbers = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    lines = [x for x in text.split(b"\n") if x.split()]
    body = text.translate(None, _SPACE)
    return {
        "n_words": len(words),
        "word_chars": len(body.decode("utf-8", "replace")),
        "n_symbols": len(text) - len(text.translate(None, _SYMBOLS)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": repeated_words(numbers),
        "n_lines": len(lines),
        "n_upper": sum(1 for c in body.decode("utf-8", "replace") if c.isupper()) if not body.isascii() else len(body) - len(body.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")),
        "n_distinct": len(known),
    }


def _statistics_rows(texts: pa.Array) -> pa.Array:
    return pa.array([statistics(t) for t in text_bytes(texts)], _ARROW)


def chi_square_below(x: float, degrees: int) -> float:
    """Distribution function for an even number of degrees of freedom."""
    term, total = 1.0, 1.0
    for i in range(1, degrees // 2):
        term *= x / 2 / i
        total += term
    return 1 - math.exp(-x / 2) * total


def chi_square_quantile(p: float, degrees: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square_below(middle, degrees) < p else (low, middle)
    return high


def consistency(share: float) -> float:
    """By what the covariance of the innermost share of a normal sample falls short."""
    return share / chi_square_below(chi_square_quantile(share, D), D + 2)


def _vector() -> list[Column]:
    words = F.greatest("n_words", F.lit(1))
    shares = {
        "word_length": F.greatest("word_chars", F.lit(1)) / words,
        "symbols": F.col("n_symbols") / F.greatest("word_chars", F.lit(1)),
        "dup_lines": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
        "repeats": F.col("n_repeat_words") / words,
        "upper": F.col("n_upper") / F.greatest("word_chars", F.lit(1)),
        "distinct": F.pow(F.col("n_distinct") / words, F.lit(0.5)),
    }
    return [F.log(shares[x] + OFFSETS[x]).alias(f"x{i}") for i, x in enumerate(NAMES)]


def _moments(share: float):
    """From sums of a group: mean, and inverse of the covariance made consistent for the share of rows it comes from."""
    factor = consistency(share) if share < 1 else 1.0
    floor = np.array([FLOOR[x] for x in NAMES])

    @F.arrow_udf("struct<mean: array<double>, inverse: array<double>>")
    def estimate(counts: pa.Array, firsts: pa.Array, seconds: pa.Array) -> pa.Array:
        rows = []
        for n, a, b in zip(counts.to_pylist(), firsts.to_pylist(), seconds.to_pylist()):
            mean = np.array(a) / n
            square = np.zeros((D, D))
            square[np.triu_indices(D)] = b
            covariance = (square + np.triu(square, 1).T) / n - np.outer(mean, mean)
            covariance *= factor
            spread, axes = np.linalg.eigh(covariance / np.outer(floor, floor))
            inverse = (axes / np.maximum(spread, 1.0)) @ axes.T / np.outer(floor, floor)
            rows.append({"mean": mean, "inverse": inverse.reshape(-1)})
        return pa.array(rows, pa.struct([("mean", pa.list_(pa.float64())), ("inverse", pa.list_(pa.float64()))]))

    return estimate


def _distance() -> Column:
    apart = [F.col(f"x{i}") - F.col("mean")[i] for i in range(D)]
    terms = [apart[i] * apart[j] * F.col("inverse")[i * D + j] for i in range(D) for j in range(D)]
    return sum(terms[1:], terms[0])


def estimates(rows: DataFrame, n_groups: int) -> DataFrame:
    """(grp, mean, inverse) of each group, from rows (grp, x0, x1, ...)."""
    xs = [F.col(f"x{i}") for i in range(D)]
    middle = rows.groupBy("grp").agg(F.array(*(F.percentile_approx(x, 0.5, 1000) for x in xs)).alias("mean"))
    around = lookup(rows, saved(middle, "mcd-medians"), "grp", n_groups)
    spread = around.groupBy("grp", "mean").agg(F.array(*(F.percentile_approx(F.abs(x - F.col("mean")[i]), 0.5, 1000) for i, x in enumerate(xs))).alias("mad"))
    diagonal = F.array(*(1 / F.greatest(F.pow(F.col("mad")[i] * 1.4826, 2), F.lit(FLOOR[NAMES[i]] ** 2)) if i == j else F.lit(0.0) for i in range(D) for j in range(D)))
    table = saved(spread.select("grp", "mean", diagonal.alias("inverse")), "mcd-start")
    inner = chi_square_quantile(REWEIGHT, D)
    for step in range(STEPS + 1):
        last = step == STEPS
        near = lookup(rows, table, "grp", n_groups).withColumn("d2", _distance()).drop("mean", "inverse")
        if last:
            within = near.where(F.col("d2") <= inner)
        else:
            limits = saved(near.groupBy("grp").agg(F.percentile_approx("d2", HALF, 10_000).alias("limit")), "mcd-limits")
            within = lookup(near, limits, "grp", n_groups).where(F.col("d2") <= F.col("limit"))
        sums = within.groupBy("grp").agg(
            F.count(F.lit(1)).cast("double").alias("n"),
            F.array(*(F.sum(x) for x in xs)).alias("first"),
            F.array(*(F.sum(xs[i] * xs[j]) for i in range(D) for j in range(i, D))).alias("second"),
        )
        table = saved(sums.select("grp", _moments(REWEIGHT if last else HALF)("n", "first", "second").alias("e")).select("grp", "e.mean", "e.inverse"), "mcd-step")
    return table


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the statistics, base_failed, distance (squared; null where the base rules fail) and kept."""
    described = F.arrow_udf(RESULT)(_statistics_rows)
    rows = docs.select("doc_id", "lang", "source", described("text").alias("s")).select("doc_id", "lang", "source", "s.*")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    name = [F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-")) for c in ("lang", "source")]
    rows = saved(rows.select("*", failed.alias("base_failed"), F.concat(name[0], F.lit("\n"), name[1]).alias("fine"), name[0].alias("coarse"), *_vector()), "mcd-rows")
    good = rows.where(~F.col("base_failed"))
    sizes = saved(good.groupBy("coarse", "fine").agg(F.count(F.lit(1)).alias("n")), "mcd-sizes")
    of_language = sizes.groupBy("coarse").agg(F.sum("n").alias("n_coarse"))
    group = F.when(F.col("n") >= LEAST, F.col("fine")).when(F.col("n_coarse") >= LEAST, F.col("coarse")).otherwise("")
    groups = saved(sizes.join(of_language, "coarse").select("fine", group.alias("grp")), "mcd-groups")
    n_groups = groups.count() + 1
    # a fine group that is too small is judged by the rows of all of its language, whatever their own group
    wider = groups.where(F.col("grp") != F.col("fine")).select("grp").distinct()
    xs = [f"x{i}" for i in range(D)]
    counted = good.select(F.col("fine").alias("grp"), *xs)
    counted = counted.unionByName(good.select(F.col("coarse").alias("grp"), *xs).join(wider, "grp", "left_semi"))
    counted = counted.unionByName(good.select(F.lit("").alias("grp"), *xs).join(F.broadcast(wider.where("grp = ''")), "grp", "left_semi"))
    table = estimates(counted, 2 * n_groups)
    judged = lookup(lookup(rows, groups, "fine", n_groups), table, "grp", 2 * n_groups)
    distance = F.when(~F.col("base_failed"), _distance())
    kept = ~F.col("base_failed") & (F.coalesce(distance, F.lit(0.0)) <= chi_square_quantile(CUT, D))
    return judged.select("doc_id", *_FIELDS[:5], "base_failed", distance.alias("distance"), kept.alias("kept"))
