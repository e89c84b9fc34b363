"""The operators as registered queries: each runs over its whole table and returns the digest of its contract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import ctw, decontaminate, factorization, html, langid, lexical, linededup, merkle, mixing, outliers, sharding, simhash, substring
from ledgerline.llm.common import crc_of_id, free_name, small_batches
from ledgerline.llm.oracle import ORACLE

__all__ = ["ORACLE", "QUERIES", "shard_columns"]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, folder, "documents").select("doc_id", "text"), _table(spark, folder, "benchmark"))
    at: Column = F.col(found.columns[-1])
    return found.select(
        "doc_id",
        at["n_words"].alias("n_words"),
        at["n_hit"].alias("n_hit"),
        F.size(at["items"]).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(at["items"], ","), 256).alias("items_sha256"),
        (at["n_hit"] > 0).alias("contaminated"),
    )


def op2_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    planned = mixing.plan(_table(spark, folder, "documents").select("doc_id", "source", "text"))
    at = F.col(planned.columns[-1])
    return planned.select("doc_id", at["size"].alias("size"), at["source_size"].alias("source_size"), at["target"].alias("target"), (at["copies"] * at["size"]).alias("taken"))


def op3_extract_html(spark: SparkSession, folder: str) -> DataFrame:
    found = html.extract(_table(spark, folder, "pages").select("page_id", "url", "html"))
    text = F.col(found.columns[-1])
    return found.select("page_id", "url", text.alias("text"), F.length(text).cast("bigint").alias("n_chars"))


def op4_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text", "lang")
    held = crc_of_id() % 4 == 2
    named = langid.identify(docs.select("doc_id", "text"), docs.where(~held).select("text", "lang"))
    at = F.col(named.columns[-1])
    return named.select("doc_id", held.alias("held_out"), at["lang"].alias("lang_pred"), at["score"].alias("score"), at["rejected"].alias("rejected"))


def op5_shard(spark: SparkSession, folder: str) -> DataFrame:
    placed = sharding.assign(_table(spark, folder, "documents").select("doc_id", "text"), carry=["doc_id"])
    return shard_columns(placed, ["doc_id"])


def shard_columns(placed: DataFrame, columns: list[str]) -> DataFrame:
    at = F.col(placed.columns[-1])
    found = {
        "size": at["size"],
        "text_crc32": at["text_crc32"],
        "law": F.lit("bytes"),
        "shard": at["shard"],
        "slot": at["slot"],
        "grown_shard": F.lit(None).cast("int"),
    }
    kept = placed.select(*columns)
    return placed.select(*columns, *(value.alias(free_name(kept, name)) for name, value in found.items()))


def op6_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    held = crc_of_id() % 3 == 1
    scored = factorization.score(docs, docs.where(~held), _table(spark, folder, "labels").where(~held).select("doc_id", "quality"))
    score = F.col(scored.columns[-1])
    return scored.select("doc_id", held.alias("held_out"), score.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op7_context_tree(spark: SparkSession, folder: str) -> DataFrame:
    return ctw.score(_table(spark, folder, "documents").select("doc_id", "text"), crc_of_id() % 10 != 0)


def op8_simhash(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    return simhash.near_duplicates(docs).select("doc_id", "fingerprint", "component_id")


def op9_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return outliers.judge(_table(spark, folder, "documents").select("doc_id", "text", "lang", "source"))


def op10_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring.dedup(_table(spark, folder, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.verify(_table(spark, folder, "documents").select(*merkle.COLUMNS))


def op12_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.search(_table(spark, folder, "documents").select("doc_id", "text"), _table(spark, folder, "benchmark"))


def op13_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = linededup.dedup(_table(spark, folder, "documents").select("doc_id", "text"))
    at = F.col(found.columns[-1])
    return found.select("doc_id", at["n_lines"].alias("n_lines"), at["n_dropped"].alias("n_dropped"), F.sha2(at["text"], 256).alias("kept_sha256"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_decontaminate,
        op2_mix_sources,
        op3_extract_html,
        op4_language_id,
        op5_shard,
        op6_quality,
        op7_context_tree,
        op8_simhash,
        op9_quality_rules,
        op10_substring_dedup,
        op11_merkle_manifest,
        op12_ranked_search,
        op13_line_dedup,
    )
}
