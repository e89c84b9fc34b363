"""Log of model attempts: error classes, what to do next, and which attempt answered each request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerline.operators.lookups import contains_any

# Error codes and phrases of each class, and the retry limits.
NOT_FOUND_CODES, QUOTA_CODES, TRANSIENT_CODES = [404], [429], [500, 502, 503, 504]
NOT_FOUND_PHRASES = [
    "not found", "not_found", "404", "unsupported", "is not supported", "model not found", "unknown model",
    "does not exist", "is not found", "invalid model", "not supported for",
]
QUOTA_PHRASES = [
    "429", "generaterequestsperday", "generate_content_free_tier_requests", "quota exceeded", "quota_exceeded",
    "daily quota", "per_day", "per day", "perday", "resource_exhausted", "check quota", "insufficient_quota",
    "quota limit", "exceeded quota",
]
TRANSIENT_PHRASES = [
    "503", "502", "504", "unavailable", "service unavailable", "temporarily unavailable", "timeout",
    "deadline exceeded", "connection reset", "server error",
]
RETRY_PATTERN = r"(?i)retry in (\d+(?:\.\d+)?)s"
MAX_ATTEMPTS, LONG_WAIT, MAX_WAIT, WAIT_MARGIN, STEP_WAIT = 3, 10.0, 15.0, 2.0, 3.0


def _matches(codes: list[int], phrases: list[str]) -> Column:
    return F.coalesce(F.col("code").isin(codes), F.lit(False)) | contains_any(F.col("_error"), phrases)


def classify_attempts(attempts: DataFrame, ladder: DataFrame | None = None) -> DataFrame:
    """Add error_class, action and wait_s to (request_id, model, attempt, error, code, ok).

    The order of the tests matters. ``ladder`` (model, rank) tells whether models remain after this one; without it
    a ``models_left`` column is read. It holds one row per configured model.
    """
    df = attempts
    if ladder is not None:
        ends = ladder.withColumn("_last", F.max("rank").over(Window.partitionBy()))
        df = df.join(ends, "model", "left").withColumn(
            "models_left", F.coalesce(F.col("rank") < F.col("_last"), F.lit(False))
        ).drop("rank", "_last")
    df = df.withColumns(
        {
            "_error": F.lower(F.coalesce(F.col("error"), F.lit(""))),
            "_asked": F.coalesce(F.regexp_extract(F.col("error"), RETRY_PATTERN, 1).try_cast("double"), F.lit(0.0)),
        }
    )
    kind = (
        F.when(F.col("ok"), "ok")
        .when(_matches(NOT_FOUND_CODES, NOT_FOUND_PHRASES), "not_found")
        .when(_matches(QUOTA_CODES, QUOTA_PHRASES), "quota")
        .when((F.col("_asked") > LONG_WAIT) & F.col("models_left"), "long_wait")
        .when(_matches(TRANSIENT_CODES, TRANSIENT_PHRASES), "transient")
        .otherwise("fatal")
    )
    df = df.withColumn("error_class", kind)
    again = (F.col("error_class") == "transient") & (F.col("attempt") < MAX_ATTEMPTS)
    action = (
        F.when(F.col("error_class") == "ok", "done")
        .when(again, "retry")
        .when(F.col("error_class") == "fatal", "raise")
        .otherwise("next_model")
    )
    wait = F.when(
        again,
        F.when(F.col("_asked") > 0, F.least(F.col("_asked") + WAIT_MARGIN, F.lit(MAX_WAIT))).otherwise(
            STEP_WAIT * F.col("attempt")
        ),
    )
    return df.withColumns({"action": action, "wait_s": wait.cast("double")}).drop("_error", "_asked")


def model_ladder(models: DataFrame, primary: str) -> DataFrame:
    """Candidate order from (model, is_lite, position): regular models before lite ones, the primary at its group's head.

    A primary outside the list joins its group. The table holds one row per configured model.
    """
    spark = models.sparkSession
    lite = "lite" in primary.lower()
    own = spark.createDataFrame([(primary, lite, -1)], "model string, is_lite boolean, position int")
    merged = models.select("model", "is_lite", "position").unionByName(own)
    merged = merged.groupBy("model").agg(F.max("is_lite").alias("is_lite"), F.min("position").alias("position"))
    order = F.struct("is_lite", "position", "model")
    return merged.select("model", F.row_number().over(Window.orderBy(order)).alias("rank"))


def resolve_attempts(attempts: DataFrame, ladder: DataFrame) -> DataFrame:
    """Per request: the first model that answered in ladder order, failures before it, and total failures.

    One aggregation of numbers with map-side combine: a request's attempts are never gathered. Rank and attempt are both
    ints, so the two halves of a bigint hold them side by side whatever their size.
    """
    ranked = attempts.join(ladder, "model")
    place = F.shiftleft(F.col("rank").cast("bigint"), 32) + F.col("attempt").cast("int")
    first = (
        ranked.withColumn("_place", place)
        .groupBy("request_id")
        .agg(
            F.min(F.when(F.col("ok"), F.col("_place"))).alias("_won"),
            F.count_if(~F.col("ok")).alias("n_failed"),
            F.count(F.lit(1)).alias("n_attempts"),
        )
    )
    won = F.shiftright("_won", 32).cast("int")
    names = ladder.select("model", F.col("rank").alias("model_rank"))
    return first.withColumn("model_rank", won).join(names, "model_rank", "left").select(
        "request_id",
        "model",
        F.col("_won").isNotNull().alias("answered"),
        "model_rank",
        F.col("_won").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("winning_attempt"),
        "n_failed",
        "n_attempts",
    )
