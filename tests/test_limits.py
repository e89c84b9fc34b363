"""Sizes that used to change results."""

from pyspark.sql import functions as F

from ledgerline.functions.numeric import display_key
from ledgerline.operators.attempts import resolve_attempts
from ledgerline.operators.pages import full_text, reconcile_type


def test_phrases_count_anywhere_in_a_text(spark):
    docs = spark.createDataFrame([(1, "x " * 9000 + "balance sheet", "invoice")], "doc_id bigint, text string, requested_type string")
    assert reconcile_type(docs).first().reconciled_type == "balance_sheet"


def test_attempts_beyond_a_thousand(spark):
    ladder = spark.createDataFrame([("a", 1), ("b", 2)], "model string, rank int")
    attempts = spark.createDataFrame([("r", "a", 2500, True), ("r", "b", 1, True), ("q", "b", 7, False)], "request_id string, model string, attempt int, ok boolean")
    got = {r.request_id: r for r in resolve_attempts(attempts, ladder).collect()}
    assert (got["r"].model, got["r"].model_rank, got["r"].winning_attempt) == ("a", 1, 2500)
    assert (got["q"].model, got["q"].answered, got["q"].model_rank, got["q"].winning_attempt) == (None, False, None, None)


def test_long_words_are_shown_whole(spark):
    assert spark.range(1).select(F.length(display_key(F.lit("a" * 12000)))).first()[0] == 12000


def test_full_text_skips_empty_pages(spark):
    pages = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (1, 3, ""), (1, 4, None), (2, 1, None)], "doc_id bigint, page_number int, text string")
    assert {tuple(r) for r in full_text(pages).select("doc_id", "n_pages", "text").collect()} == {(1, 4, "a\n\nb"), (2, 1, "")}
