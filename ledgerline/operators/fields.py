"""Look-ups in the open tail of a payload: rows of (doc_id, source, pos, key, key_norm, text, is_text, num, rate).

``source`` is 0 for top-level keys and 1 for the additional fields; ``pos`` is the key's place in its object.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerline.functions.numeric import parse_amount, rate_of_amount

# Names of the rounding adjustment, in priority order.
ROUND_OFF_KEYS = ["round_off_amount", "round_off", "rounding_amount", "rounding", "roundoff_amount", "roundoff"]


def normalize_key(key: Column) -> Column:
    return F.translate(F.lower(key), " -", "__")


def with_field_values(fields: DataFrame) -> DataFrame:
    """Add key_norm, and the amount and rate a field's text or number stands for."""
    number = F.col("text").try_cast("double")
    is_percent = F.coalesce(F.col("is_text") & F.col("text").contains("%"), F.lit(False))
    return fields.withColumns(
        {
            "key_norm": normalize_key(F.col("key")),
            "num": F.when(F.col("is_text"), parse_amount(F.col("text"))).otherwise(number),
        }
    ).withColumn("rate", rate_of_amount(F.col("num"), is_percent))


def priority(key: Column, ordered: list[str]) -> Column:
    """Place of a key in a priority list, null when it is not there."""
    place = None
    for index, name in enumerate(ordered):
        place = F.when(key == name, F.lit(index)) if place is None else place.when(key == name, F.lit(index))
    return place


def round_off_rank() -> Column:
    """Order among the rounding adjustments of a document, null for other fields: header before additional, then exact
    names in order, then normalised ones by place; one integer."""
    exact = priority(F.col("key"), ROUND_OFF_KEYS)
    place = F.coalesce(exact, F.col("pos")).cast("bigint")
    rank = (F.col("source").cast("bigint") * F.lit(2) + exact.isNull().cast("bigint")) * F.lit(1 << 32) + place
    return F.when(F.col("key_norm").isin(ROUND_OFF_KEYS) & F.col("num").isNotNull(), rank)


def round_off(fields: DataFrame) -> DataFrame:
    """Reported rounding adjustment per document; combined map-side."""
    ranked = fields.withColumn("_rank", round_off_rank()).where(F.col("_rank").isNotNull())
    return ranked.groupBy("doc_id").agg(F.min_by("num", "_rank").alias("round_off"))


def lookup_extra(fields: DataFrame, metrics: dict[str, list[str]]) -> DataFrame:
    """First parsable additional field per metric: exact names in order, then normalised names in order.

    Where several spellings normalise to one name the last of them counts. Both aggregations combine map-side.
    """
    names = sorted({key for keys in metrics.values() for key in keys})
    per_key = (
        fields.where((F.col("source") == 1) & F.col("key_norm").isin(names))
        .groupBy("doc_id", "key_norm")
        .agg(
            F.max(F.when(F.col("key") == F.col("key_norm"), F.col("num"))).alias("exact"),
            F.max_by("num", "pos").alias("last"),
        )
        .withColumn("value", F.coalesce("exact", "last"))
        .where(F.col("value").isNotNull())
    )

    def rank(keys: list[str]) -> Column:
        place = priority(F.col("key_norm"), keys)
        return F.when(place.isNotNull(), F.struct(F.col("exact").isNull().alias("loose"), place.alias("place")))

    return per_key.groupBy("doc_id").agg(
        *[
            F.min_by("value", rank(keys)).alias(metric)
            for metric, keys in metrics.items()
        ]
    )
