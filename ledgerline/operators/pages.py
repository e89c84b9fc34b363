"""Page routing, text assembly, type reconciliation, request tables and credential redaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerline.functions.numeric import strip
from ledgerline.operators.lookups import contains_any

# Header phrases that give a document's type away.
PHRASES = {
    "balance_sheet": [
        "BALANCE SHEET",
        "STATEMENT OF FINANCIAL POSITION",
        "STATEMENT OF ASSETS AND LIABILITIES",
        "CAPITAL AND LIABILITIES",
    ],
    "profit_and_loss": [
        "PROFIT AND LOSS",
        "PROFIT & LOSS",
        "INCOME STATEMENT",
        "STATEMENT OF OPERATIONS",
        "STATEMENT OF EARNINGS",
        "STATEMENT OF COMPREHENSIVE INCOME",
    ],
    "cash_flow_statement": ["CASH FLOW STATEMENT", "STATEMENT OF CASH FLOWS", "CASH FLOWS STATEMENT"],
    "invoice": [
        "TAX INVOICE",
        "COMMERCIAL INVOICE",
        "BILL OF SUPPLY",
        "PROFORMA INVOICE",
        "INVOICE NUMBER",
        "INVOICE DATE",
        "BILL TO",
        "SHIP TO",
        "GSTIN",
    ],
}

# Credential patterns and the replacement that keeps their prefix group.
MARK = "[REDACTED_API_KEY]"
DEFAULT_RULES = [
    (r"AIza[0-9A-Za-z\-_]{35}", MARK),
    (r"(key=)[A-Za-z0-9\-_]+", "$1" + MARK),
    (r"(Bearer\s+)[A-Za-z0-9\-_.]+", "$1" + MARK),
]


def route_pages(pages: DataFrame) -> DataFrame:
    """Add route, is_scanned and warning per page: digital text first, then embedded images, then a rendering."""
    has_text = F.coalesce(strip(F.col("text")), F.lit("")) != ""
    route = (
        F.when(has_text, "digital")
        .when(F.coalesce(F.col("n_images"), F.lit(0)) > 0, "scanned")
        .when(F.coalesce(F.col("rendered"), F.lit(False)), "rasterized")
        .otherwise("blank")
    )
    number = F.col("page_number")
    warning = (
        F.when(F.col("route") == "scanned", F.format_string("Page %d: no text, read from its image.", number))
        .when(F.col("route") == "rasterized", F.format_string("Page %d: neither text nor image, rendered for recognition.", number))
        .when(F.col("route") == "blank", F.format_string("Page %d: nothing to read.", number))
    )
    return pages.withColumn("route", route).withColumns(
        {"is_scanned": F.col("route").isin("scanned", "rasterized"), "warning": warning}
    )


def extraction_status(pages: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """Per document: FAILED, PARTIAL_SUCCESS or SUCCESS, with page and error counts (all combined map-side).

    ``pages`` may carry ocr_error, ``errors`` (doc_id, error) adds failures of documents with or without pages.
    """
    has_text = F.coalesce(strip(F.col("text")), F.lit("")) != ""
    own_error = F.col("ocr_error").isNotNull() if "ocr_error" in pages.columns else F.lit(False)
    rows = pages.select("doc_id", F.lit(1).alias("page"), has_text.alias("has_text"), own_error.cast("int").alias("error"))
    if errors is not None:
        rows = rows.unionByName(
            errors.select("doc_id", F.lit(0).alias("page"), F.lit(False).alias("has_text"), F.lit(1).alias("error"))
        )
    per_doc = rows.groupBy("doc_id").agg(
        F.sum("page").alias("n_pages"),
        F.sum("error").alias("n_errors"),
        F.bool_or("has_text").alias("has_text"),
    )
    return per_doc.withColumn(
        "extraction_status",
        F.when(F.col("n_errors") == 0, "SUCCESS")
        .when((F.col("n_pages") > 0) & F.col("has_text"), "PARTIAL_SUCCESS")
        .otherwise("FAILED"),
    )


def page_messages(pages: DataFrame) -> DataFrame:
    """Errors and warnings of the pages as rows (doc_id, severity, position, message), the page being the position; null where
    a page has none."""
    routed = route_pages(pages)
    failed = F.col("ocr_error") if "ocr_error" in pages.columns else F.lit(None).cast("string")
    told = F.array(
        F.struct(F.lit("error").alias("severity"), F.when(failed.isNotNull(), F.format_string("Page %d: %s", F.col("page_number"), failed)).alias("message")),
        F.struct(F.lit("warning").alias("severity"), F.col("warning").alias("message")),
    )
    return routed.select("doc_id", F.col("page_number").cast("bigint").alias("position"), F.inline(told))


def _assemble(pages: DataFrame, piece: Column, between: str, alias: str) -> DataFrame:
    """Join the pieces of a document in page order. A document's pages are bounded by the page limit of triage."""
    return (
        pages.groupBy("doc_id")
        .agg(F.sort_array(F.collect_list(F.struct("page_number", piece.alias("piece")))).alias("_pieces"))
        .select("doc_id", F.array_join(F.col("_pieces.piece"), between).alias(alias))
    )


def full_text(pages: DataFrame) -> DataFrame:
    """Non-empty page texts in page order with a blank line between them; one aggregation counts and gathers."""
    piece = F.when(F.col("text") != "", F.struct("page_number", F.col("text").alias("piece")))
    gathered = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_pages"), F.sort_array(F.collect_list(piece)).alias("_pieces"))
    return gathered.select("doc_id", "n_pages", strip(F.array_join(F.col("_pieces.piece"), "\n\n")).alias("text"))


def page_context(pages: DataFrame) -> DataFrame:
    """Every page under its marker line, in page order."""
    piece = F.concat(
        F.format_string("--- [PAGE %d] ---\n", F.col("page_number")), strip(F.coalesce("text", F.lit(""))), F.lit("\n")
    )
    return _assemble(pages, piece, "\n", "context")


def reconcile_type(docs: DataFrame, requested: str = "requested_type", text: str = "text") -> DataFrame:
    """Add reconciled_type: what the text says, unless it speaks of an invoice and a statement at once."""
    df = docs.withColumn("_upper", F.upper(F.col(text)))
    says = {kind: F.coalesce(contains_any(F.col("_upper"), words), F.lit(False)) for kind, words in PHRASES.items()}
    invoice = says.pop("invoice")
    chosen = None
    any_statement = None
    for kind, said in says.items():
        hit = said & ~invoice
        chosen = F.when(hit, kind) if chosen is None else chosen.when(hit, kind)
        any_statement = said if any_statement is None else any_statement | said
    chosen = chosen.when(invoice & ~any_statement, "invoice").otherwise(F.col(requested))
    return df.withColumn("reconciled_type", chosen).drop("_upper")


def request_table(docs: DataFrame, templates: DataFrame) -> DataFrame:
    """Model requests: the template of the document's type with the text context, or with the scanned page numbers.

    ``docs`` has doc_id, document_type, context and scanned_pages (array of numbers, empty for digital documents);
    ``templates`` has one row per document type.
    """
    title = F.upper(F.replace(F.col("document_type"), F.lit("_"), F.lit(" ")))
    by_image = F.size("scanned_pages") > 0
    attached = F.concat(F.lit("Attached page images: "), F.array_join(F.col("scanned_pages").cast("array<string>"), ", "), F.lit("."))
    return docs.join(templates, "document_type").select(
        "doc_id",
        "document_type",
        F.col("instructions").alias("system_prompt"),
        F.concat(
            F.lit("Document type: "), title, F.lit("\n\n"), F.when(by_image, attached).otherwise(F.col("context"))
        ).alias("user_prompt"),
        by_image.alias("by_image"),
    )


def redact(
    df: DataFrame, columns: list[str], rules: list[tuple[str, str]] = DEFAULT_RULES, literals: list[str] | None = None
) -> DataFrame:
    """Replace credentials in text columns: configured literal keys longer than three characters, then patterns."""

    def clean(column: str) -> Column:
        value = F.coalesce(F.col(column), F.lit(""))
        for key in literals or []:
            if len(key.strip()) > 3:
                value = F.replace(value, F.lit(key.strip()), F.lit(MARK))
        for pattern, replacement in rules:
            value = F.regexp_replace(value, pattern, replacement)
        return value

    return df.withColumns({c: clean(c) for c in columns})
