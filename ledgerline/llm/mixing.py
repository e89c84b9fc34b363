"""Mixing sources to target weights.

Words are summed per source, sources in code-point order (null last) get the weights in turn, and the total of share times
all words is dealt by weight; no target exceeds LIMIT times its source's words, and what is above goes to the others by
weight until none is above. A document is emitted floor(rate) times, and once more if its seeded hash falls below the
fraction; rate = target / words of the source. Decisions depend on seed and doc_id alone, so reruns agree, and repeated rows
decide alike. Null texts have no words; a source without words has target zero; columns of docs are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import WORD, digest_bits, free_name, lookup, saved

WEIGHTS = (5, 2, 1)
SHARE = 1.5
LIMIT = 2
SEED = "mix-1"


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    With sources in the order of cap / weight, the first k are full, and the rest share what is left by weight: k is the
    first for which the share of the next stays below its cap.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    by_ratio = Window.orderBy("ratio", "no")
    cap, weight = F.col("cap"), F.col("weight")
    table = (
        sizes.withColumn("no", F.row_number().over(by_name) - 1)
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("no") % len(weights) + 1).cast("int")))
        .withColumn("cap", F.col("source_size") * LIMIT)
        .withColumn("ratio", cap / weight)
        .withColumn("full_before", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("weight_left", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("total", F.sum("source_size").over(Window.partitionBy()))
        .withColumn("level", (F.col("total") * share - F.col("full_before")) / F.col("weight_left"))
        .withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "no", "level"))).over(Window.partitionBy())["level"])
    )
    return table.select("source", "source_size", F.coalesce(F.least(cap.cast("double"), weight * F.col("level")), cap.cast("double")).alias("target"))


def plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, seed: str = SEED) -> DataFrame:
    """docs with a struct column `mix`: size, source_size, target, copies."""
    key, size, named = (free_name(docs, x) for x in ("mix_key", "mix_size", "of_source"))
    keyed = docs.withColumn(key, F.concat(F.when(F.col("source").isNull(), "n").otherwise("s"), F.coalesce(F.col("source"), F.lit("")))).withColumn(size, words_of(F.col("text")))
    sizes = keyed.groupBy("source").agg(F.sum(size).alias("source_size"))
    table = saved(targets(sizes, weights, share), "mix-targets")
    n = table.count()
    table = table.select(F.concat(F.when(F.col("source").isNull(), "n").otherwise("s"), F.coalesce(F.col("source"), F.lit(""))).alias(key), F.struct("source_size", "target").alias(named))
    of = F.col(named)
    rate = F.when(of["source_size"] > 0, of["target"] / of["source_size"]).otherwise(0.0)
    extra = digest_bits(F.lit(seed), "doc_id") < rate - F.floor(rate)
    mix = F.struct(F.col(size).alias("size"), of["source_size"].alias("source_size"), of["target"].alias("target"), (F.floor(rate) + extra.cast("int")).cast("bigint").alias("copies"))
    return lookup(keyed, table, key, n).select(*docs.columns, mix.alias(free_name(docs, "mix")))


def mix(docs: DataFrame, **options) -> DataFrame:
    """docs repeated and left out as planned, with docs' own columns."""
    planned = plan(docs, **options)
    name = planned.columns[-1]
    copies = F.col(name)["copies"].cast("int")
    return planned.where(copies > 0).withColumn(name, F.explode(F.sequence(F.lit(1), copies))).select(*docs.columns)
