"""Line numbers within a document that survive a document holding a large share of all lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

#: A document is hot from one row in HOT_SHARE and HOT_ROWS rows on; so there are at most HOT_SHARE of them.
HOT_SHARE, HOT_ROWS = 1000, 1000
#: Keys a sketch tracks and returns; it finds every key with more than one row in 2300, four times what is asked for.
TRACKED, RETURNED = 10_000, 5000


def hot_keys(rows: DataFrame, key: str = "doc_id") -> list:
    """The keys that hold so many rows that one task should not take them alone, by one look at the key column.

    Small sketches per task are merged, nothing shuffles. The counts are estimates: they only decide what is spread.
    """
    top, n = rows.agg(F.expr(f"approx_top_k(`{key}`, {RETURNED}, {TRACKED})"), F.count(F.lit(1))).first()
    least = max(HOT_ROWS, n / HOT_SHARE)
    return [r["item"] for r in top or [] if r["item"] is not None and r["count"] >= least]


def is_one_of(key: str, keys: list) -> Column:
    return F.coalesce(F.col(key).isin(keys), F.lit(False)) if keys else F.lit(False)


def number_lines(lines: DataFrame, order: list[Column], bucket: list[Column], key: str = "doc_id") -> DataFrame:
    """Add line_no: the 1-based place of a line in its document under a total order.

    ``bucket`` is a coarse leading part of that order; lines without a key drop out, those without a bucket once they are counted.
    A document's lines are numbered in one task, those of a hot one inside (document, bucket), so that they are spread over
    many tasks; the buckets' sizes, a narrow pre-combined table of hot documents only, give the offsets. Either way a line is
    shuffled once.
    """
    df, placed = lines.where(F.col(key).isNotNull()), reduce(Column.__and__, [c.isNotNull() for c in bucket])
    hot = hot_keys(lines, key)
    if not hot:
        return df.withColumn("line_no", F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("int")).where(placed)
    names = [f"_b{i}" for i in range(len(bucket))]
    is_hot = is_one_of(key, hot)
    df = df.withColumns({n: F.when(is_hot, b) for n, b in zip(names, bucket)})
    within = Window.partitionBy(key, *names).orderBy(*order)
    before = Window.partitionBy(key).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    sizes = df.where(is_hot).groupBy(key, *names).agg(F.count(F.lit(1)).alias("_size"))
    offsets = sizes.select(key, *names, F.sum("_size").over(before).alias("_offset"))
    return (
        df.withColumn("_place", F.row_number().over(within))
        .where(placed)
        .join(offsets, [key, *names], "left")
        .withColumn("line_no", (F.coalesce("_offset", F.lit(0)) + F.col("_place")).cast("int"))
        .drop("_place", "_offset", *names)
    )
