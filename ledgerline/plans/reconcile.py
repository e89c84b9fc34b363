"""Whole reconciliation jobs: typed tables to checks, and raw responses to checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ledgerline.functions.checks import CHECK_COLUMNS
from ledgerline.functions.numeric import DEFAULT_TOLERANCE
from ledgerline.operators import payload
from ledgerline.operators.invoice import invoice_checks
from ledgerline.operators.statements import balance_sheet_checks, cash_flow_checks, pnl_checks


RESULT_SCHEMA = (
    "doc_id string, document_type string, extraction_status string, reason string, data variant, extra_text string, "
    "whole_text string, checked_type string"
)


def all_checks(*parts: DataFrame) -> DataFrame:
    """Checks of several document types under one another; each part holds its own type only."""
    return reduce(DataFrame.unionByName, [part.select(*CHECK_COLUMNS) for part in parts])


def reconcile_tables(
    invoices: tuple[DataFrame, DataFrame, DataFrame | None] | None = None,
    balance_sheets: tuple[DataFrame, DataFrame | None] | None = None,
    profit_and_loss: tuple[DataFrame, DataFrame | None, DataFrame | None] | None = None,
    cash_flows: tuple[DataFrame, DataFrame | None, DataFrame | None] | None = None,
    tolerance: float = DEFAULT_TOLERANCE,
) -> DataFrame:
    """All checks of (headers, lines, extra) tables per document type."""
    parts = []
    if invoices:
        parts.append(invoice_checks(*invoices, tolerance=tolerance))
    if balance_sheets:
        parts.append(balance_sheet_checks(*balance_sheets, tolerance=tolerance))
    if profit_and_loss:
        parts.append(pnl_checks(*profit_and_loss, tolerance=tolerance))
    if cash_flows:
        parts.append(cash_flow_checks(*cash_flows, tolerance=tolerance))
    return all_checks(*parts)


def extraction_results(responses: DataFrame) -> DataFrame:
    """Parsed responses with their extraction status and the type their checks follow."""
    return payload.checked_type_of_results(payload.extraction_result(payload.parse_responses(responses)))


def loose_results(payloads: DataFrame) -> DataFrame:
    """Payloads taken as they are: every name and every printed amount the rules know counts, no schema is applied."""
    parsed = payload.dispatch_type(payload.parse_responses(payloads))
    status = F.when(F.col("body").isNull() | ~F.col("is_supported"), payload.FAILED).otherwise(payload.PARTIAL)
    return parsed.withColumns({"extraction_status": status, "reason": F.col("error")})


def normalize_responses(responses: DataFrame, path: str, typed: bool = True) -> dict[str, DataFrame]:
    """Write the typed tables of a batch of responses below ``path`` and return them.

    Every rule set reads several of these tables, so the JSON text is parsed once, here, and the rules then scan narrow
    columns of their own document type only. The tables also survive the loss of executors.
    """
    spark = responses.sparkSession
    results = (extraction_results if typed else loose_results)(responses).withColumns(payload.ordered_texts())
    results.select(
        F.col("doc_id").cast("string").alias("doc_id"), "document_type", "extraction_status", "reason", "data", "extra_text",
        F.when(F.col("extraction_status") == payload.PARTIAL, F.col("whole_text")).alias("whole_text"), "checked_type",
    ).write.mode("overwrite").partitionBy("checked_type").parquet(f"{path}/results")
    stored = spark.read.schema(RESULT_SCHEMA).parquet(f"{path}/results")
    usable = stored.where(F.col("extraction_status") != payload.FAILED)

    def keep(name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").partitionBy("checked_type").parquet(f"{path}/{name}")
        return spark.read.schema(df.schema).parquet(f"{path}/{name}")

    def headers(kind: str) -> DataFrame:
        df = payload.rule_headers(stored, kind)
        df.write.mode("overwrite").parquet(f"{path}/headers_{kind}")
        return spark.read.schema(df.schema).parquet(f"{path}/headers_{kind}")

    return {
        "results": stored,
        **{f"headers_{kind}": headers(kind) for kind in payload.TYPES},
        "lines": keep("lines", payload.explode_lines(usable)),
        "extra": keep("extra", payload.explode_extra(usable)),
    }


def checks_of_tables(tables: dict[str, DataFrame], tolerance: float = DEFAULT_TOLERANCE) -> DataFrame:
    """Checks of normalised responses, each document by the rules of its own type."""

    def of(kind: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        mine = lambda name: tables[name].where(F.col("checked_type") == kind)
        return tables[f"headers_{kind}"], mine("lines"), mine("extra")

    invoices = tables["results"].where((F.col("checked_type") == "invoice") & (F.col("extraction_status") != payload.FAILED))
    return all_checks(
        invoice_checks(*of("invoice"), payload.explode_components(invoices), tolerance),
        balance_sheet_checks(*of("balance_sheet")[:2], tolerance),
        pnl_checks(*of("profit_and_loss"), tolerance),
        cash_flow_checks(*of("cash_flow_statement"), tolerance),
    )


def validate_responses(
    responses: DataFrame, path: str, tolerance: float = DEFAULT_TOLERANCE, typed: bool = True
) -> DataFrame:
    """Raw responses (doc_id, document_type, raw) to check rows, through tables written below ``path``.

    With ``typed`` a payload first goes through the fields of its type, as extraction does; without it the rules read
    the payload itself.
    """
    return checks_of_tables(normalize_responses(responses, path, typed), tolerance)
