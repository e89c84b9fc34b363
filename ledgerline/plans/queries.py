"""Registered queries: one callable (spark, sf_dir) -> DataFrame per operator."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerline.functions.numeric import display_bytes, normalize_rates as rates_of, parse_amount
from ledgerline.operators import attempts, discounts, fields, invoice, lookups, pages, payload, report, statements, taxes, triage
from ledgerline.plans.fixtures import fixture, invoice_lines
from ledgerline.plans.reconcile import extraction_results, reconcile_tables, validate_responses
from ledgerline.session import scratch_path as _scratch
from ledgerline.sources import documents
from ledgerline.streaming import arrivals

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


def shown(checks: DataFrame, *more: str) -> DataFrame:
    """Check rows in flat columns."""
    return checks.select(
        "doc_id",
        *more,
        "rule_name",
        "formula",
        "calculated_value",
        "reported_value",
        "variance",
        "status",
        F.array_join("missing_fields", ", ").alias("missing"),
    )


# --- invoices --------------------------------------------------------------------------------------------------------


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line sum against subtotal over orders and lineitem, counted by outcome."""
    return report.status_counts(_invoice_header_checks(spark, sf_dir, [2], with_extra=False))


def _inputs(spark: SparkSession, sf_dir: str, with_extra: bool = True, taxes: bool = False) -> DataFrame:
    headers = fixture(spark, sf_dir, "fx_invoice_headers")
    lines = invoice_lines(spark, sf_dir, numbered=False)
    extra = fields.with_field_values(fixture(spark, sf_dir, "fx_invoice_extra")) if with_extra else None
    return invoice.invoice_inputs(headers, lines, extra, taxes=taxes)


def _invoice_header_checks(spark: SparkSession, sf_dir: str, only: list[int], with_extra: bool = True) -> DataFrame:
    return invoice.invoice_header_checks(_inputs(spark, sf_dir, with_extra, taxes=4 in only), only=only)


@query
def invoice_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _inputs(spark, sf_dir).select(
        "doc_id", "subtotal", "tax_amount", "tax_rate", "discount_amount", "shipping_amount", "total_amount",
        "round_off_amount", "n_lines", "n_totals", "line_sum", "any_discount",
    )


@query
def pricing_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _inputs(spark, sf_dir).select("doc_id", "pricing_model")


@query
def invoice_line_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    without = invoice.invoice_header_checks(_inputs(spark, sf_dir, with_extra=False), only=[1])
    return shown(invoice.invoice_line_checks(invoice_lines(spark, sf_dir)).unionByName(without))


@query
def missing_line_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return invoice.missing_line_totals(invoice_lines(spark, sf_dir))


@query
def invoice_subtotal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(_invoice_header_checks(spark, sf_dir, [2], with_extra=False))


@query
def invoice_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(_invoice_header_checks(spark, sf_dir, [3]))


@query
def invoice_tax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(_invoice_header_checks(spark, sf_dir, [4]))


@query
def tax_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components with their rates; the lines play no part."""
    headers = fixture(spark, sf_dir, "fx_invoice_headers")
    extra = fields.with_field_values(fixture(spark, sf_dir, "fx_invoice_extra"))
    docs = invoice.invoice_inputs(headers, None, extra, taxes=True)
    return taxes.part_rows(docs, "component_order", "name", "rate", "amount")


@query
def tax_component_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taxes.part_rows(_inputs(spark, sf_dir, taxes=True), "name", "rate", "amount", "calculated_amount")


@query
def round_off_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = fields.with_field_values(fixture(spark, sf_dir, "fx_invoice_extra"))
    return fields.round_off(extra)


@query
def resolve_line_discount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The structured fields, and a generic discount as text in several notations."""
    lines = invoice_lines(spark, sf_dir, numbered=False).withColumn(
        "discount",
        F.expr(
            "CASE WHEN doc_id % 8 = 1 THEN concat(cast(doc_id % 40 as string), ' %') WHEN doc_id % 8 = 2 THEN '$5.00' "
            "WHEN doc_id % 8 = 3 THEN '5' WHEN doc_id % 8 = 4 THEN 'none' WHEN doc_id % 8 = 5 THEN 'n/k' WHEN doc_id % 8 = 6 THEN '0' END"
        ),
    )
    lines = lines.withColumns(
        {
            "discount_percent": F.when(F.col("doc_id") % 3 != 0, F.col("discount_percent")),
            "discount_amount": F.when(F.col("doc_id") % 3 != 0, F.col("discount_amount")),
        }
    )
    found = discounts.resolve_line_discount(lines)
    return found.select(
        "doc_id", F.col("line_no").alias("line_number"), "description", "quantity", "total_price", "discount_kind", "discount_value", "has_discount"
    )


@query
def resolve_text_discount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discounts stated in a line's text only (look-ahead patterns, so without SQL)."""
    lines = invoice_lines(spark, sf_dir, numbered=False).drop("discount_percent", "discount_amount")
    lines = lines.withColumn(
        "source_snippet",
        F.expr(
            "CASE doc_id % 5 WHEN 0 THEN concat('disc: ', cast(line_no as string), '%') WHEN 1 THEN concat('less $', cast(line_no as string), '.50') "
            "WHEN 2 THEN concat('7.44 PCS ', cast(line_no as string), ' % 0.45') WHEN 3 THEN '10% rebate' END"
        ),
    )
    found = discounts.resolve_line_discount(lines)
    return found.groupBy("discount_kind").agg(F.count(F.lit(1)).alias("n_lines"), F.sum("discount_value").alias("total_value"))


# --- values ----------------------------------------------------------------------------------------------------------


@query
def normalize_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "fx_dirty").select("doc_id", "printed", parse_amount(F.col("printed")).alias("amount"))


@query
def normalize_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fixture(spark, sf_dir, "fx_dirty").withColumn(
        "printed", F.expr("CASE WHEN doc_id % 3 = 0 THEN concat(cast(doc_id % 150 as string), CASE WHEN doc_id % 2 = 0 THEN '%' ELSE '' END) ELSE printed END")
    )
    return rates_of(df.withColumn("rate", F.col("printed")), ["rate"]).select("doc_id", "printed", "rate")


@query
def display_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = _invoice_header_checks(spark, sf_dir, [2, 3], with_extra=False)
    size = fixture(spark, sf_dir, "fx_stored").select(F.col("id").alias("doc_id"), display_bytes(F.col("id") * F.col("id") * 7).alias("size_text"))
    return report.display_values(checks).join(size, "doc_id")


# --- balance sheet ---------------------------------------------------------------------------------------------------


def _balance(spark: SparkSession, sf_dir: str, only: list[int]) -> DataFrame:
    return shown(
        statements.balance_sheet_checks(
            fixture(spark, sf_dir, "fx_balance_headers"), fixture(spark, sf_dir, "fx_balance_lines"), only=only
        )
    )


@query
def balance_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statements.balance_inputs(fixture(spark, sf_dir, "fx_balance_headers"))


@query
def classify_balance_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statements.classify_balance_lines(fixture(spark, sf_dir, "fx_balance_lines"))


@query
def bs_equation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _balance(spark, sf_dir, [1])


@query
def bs_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _balance(spark, sf_dir, [2])


@query
def bs_le_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _balance(spark, sf_dir, [3])


@query
def bs_le_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _balance(spark, sf_dir, [4])


@query
def bs_liabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _balance(spark, sf_dir, [5])


@query
def bs_equity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _balance(spark, sf_dir, [6])


# --- profit and loss, cash flow --------------------------------------------------------------------------------------


def _pnl_tables(spark: SparkSession, sf_dir: str, keyed: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    headers, lines, extra = (fixture(spark, sf_dir, f"fx_pnl_{name}", keyed=keyed) for name in ("headers", "lines", "extra"))
    return headers, lines, fields.with_field_values(extra)


def _pnl(spark: SparkSession, sf_dir: str, only: list[int]) -> DataFrame:
    return shown(statements.pnl_checks(*_pnl_tables(spark, sf_dir), only=only))


@query
def keyword_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.lookup_lines(fixture(spark, sf_dir, "fx_pnl_lines"), lookups.BANK_METRICS)


@query
def extra_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = fields.with_field_values(fixture(spark, sf_dir, "fx_pnl_extra"))
    return fields.lookup_extra(extra, {name: metric.extra for name, metric in lookups.BANK_METRICS.items()})


@query
def bank_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.lookup_metrics(*_pnl_tables(spark, sf_dir), lookups.BANK_METRICS)


@query
def pnl_gross_profit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pnl(spark, sf_dir, [1])


@query
def pnl_operating_income(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pnl(spark, sf_dir, [2])


@query
def pnl_net_income(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pnl(spark, sf_dir, [3])


@query
def pnl_bank_income(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pnl(spark, sf_dir, [4])


@query
def pnl_bank_expenditure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pnl(spark, sf_dir, [5])


@query
def pnl_bank_net_profit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pnl(spark, sf_dir, [6])


@query
def pnl_bank_consolidated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pnl(spark, sf_dir, [7])


@query
def pnl_bank_appropriations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pnl(spark, sf_dir, [8])


def _cash(spark: SparkSession, sf_dir: str, only: list[int]) -> DataFrame:
    headers, lines = fixture(spark, sf_dir, "fx_cash_headers"), fixture(spark, sf_dir, "fx_cash_lines")
    return shown(statements.cash_flow_checks(headers, lines, only=only))


@query
def cf_net_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cash(spark, sf_dir, [1])


@query
def cf_ending_cash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cash(spark, sf_dir, [2])


# --- all checks, summaries and reports -------------------------------------------------------------------------------


def _rule_tables(spark: SparkSession, sf_dir: str) -> dict[str, tuple]:
    extra = fields.with_field_values(fixture(spark, sf_dir, "fx_invoice_extra"))
    keyed = lambda name: fixture(spark, sf_dir, name, keyed=True)
    return {
        "invoices": (fixture(spark, sf_dir, "fx_invoice_headers"), invoice_lines(spark, sf_dir), extra),
        "balance_sheets": (keyed("fx_balance_headers"), keyed("fx_balance_lines")),
        "profit_and_loss": _pnl_tables(spark, sf_dir, keyed=True),
        "cash_flows": (keyed("fx_cash_headers"), keyed("fx_cash_lines"), None),
    }


def _all_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile_tables(**_rule_tables(spark, sf_dir))


@query
def all_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(_all_checks(spark, sf_dir), "document_type")


@query
def validation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.summarize_with_errors(_all_checks(spark, sf_dir), named=True)


@query
def failed_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of all failed checks of each document, in rows of bounded length."""
    return report.failed_rules(_all_checks(spark, sf_dir))


@query
def check_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed tab of the balance-sheet checks with the counters of every tab."""
    headers, lines = fixture(spark, sf_dir, "fx_balance_headers"), fixture(spark, sf_dir, "fx_balance_lines")
    checks = statements.balance_sheet_checks(headers, lines)
    counts = report.status_counts(checks).withColumnRenamed("n_checks", "n_in_tab")
    return report.filter_checks(checks, "failed").join(F.broadcast(counts), "status").select(
        "doc_id", "rule_name", "status", "variance", "n_in_tab"
    )


@query
def rule_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.rule_report(_all_checks(spark, sf_dir))


@query
def variance_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles from merged sketches; approximate, so without SQL."""
    return report.variance_quantiles(_all_checks(spark, sf_dir))


# --- responses -------------------------------------------------------------------------------------------------------


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payload.parse_responses(fixture(spark, sf_dir, "fx_responses"))


@query
def scan_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = _parsed(spark, sf_dir)
    return parsed.select("doc_id", "document_type", F.col("body").isNotNull().alias("is_object"), "error")


@query
def strip_fences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "fx_responses").select("doc_id", payload.strip_fences(F.col("raw")).alias("clean"))


@query
def unwrap_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = _parsed(spark, sf_dir)
    keys = F.size(F.map_keys(F.try_variant_get("data", "$", "map<string,variant>")))
    evidence = F.coalesce(F.size(F.map_keys(F.try_variant_get("body", "$.evidence", "map<string,variant>"))), F.lit(0))
    return parsed.select("doc_id", "enclosed", keys.alias("n_keys"), evidence.alias("n_evidence"))


def _project(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return payload.project_headers(_parsed(spark, sf_dir), kind)


@query
def project_invoice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _project(spark, sf_dir, "invoice")


@query
def project_balance_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _project(spark, sf_dir, "balance_sheet")


@query
def project_pnl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _project(spark, sf_dir, "profit_and_loss")


@query
def project_cash_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _project(spark, sf_dir, "cash_flow_statement")


@query
def extraction_result_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payload.extraction_result(_parsed(spark, sf_dir)).select("doc_id", "document_type", "extraction_status", "reason")


@query
def evidence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payload.explode_evidence(_parsed(spark, sf_dir))


@query
def line_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payload.explode_lines(payload.extraction_result(_parsed(spark, sf_dir))).select(
        "doc_id", "line_no", "description", "item_name", "category", "quantity", "unit_price", "total_price", "amount",
        "discount_percent", "gross_amount", "page_number",
    )


@query
def extra_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = payload.explode_extra(_parsed(spark, sf_dir))
    text = F.when(F.col("is_text"), F.col("text")).alias("text")
    return rows.select("doc_id", "pos", "key", "key_norm", text, "is_text", "num")


def _dispatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dispatch over relabelled responses: every third document claims to be an invoice, some an unknown type."""
    responses = fixture(spark, sf_dir, "fx_responses").withColumn(
        "document_type", F.expr("CASE WHEN doc_id % 3 = 0 THEN ' Invoice' WHEN doc_id % 31 = 1 THEN 'receipt' ELSE document_type END")
    )
    parsed = payload.parse_responses(responses)
    return payload.dispatch_type(parsed).select("doc_id", "checked_type", "is_supported")


@query
def dispatch_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dispatched(spark, sf_dir)


@query
def document_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A summary of every document under the type it is checked as, with and without checks."""
    return report.summarize_documents(_all_checks(spark, sf_dir), _dispatched(spark, sf_dir))


@query
def field_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payload.partition_fields(_parsed(spark, sf_dir)).select("doc_id", "key", "part", "is_null", "text", "number")


@query
def response_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From raw responses to check rows in one job."""
    return shown(validate_responses(fixture(spark, sf_dir, "fx_responses", spread=True), _scratch(spark, "responses")))


# --- pages and text --------------------------------------------------------------------------------------------------


@query
def page_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.route_pages(fixture(spark, sf_dir, "fx_pages")).select("doc_id", "page_number", "route", "is_scanned", "warning")


@query
def extraction_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extraction_status(fixture(spark, sf_dir, "fx_pages"))


@query
def full_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.full_text(fixture(spark, sf_dir, "fx_pages"))


@query
def page_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.page_context(fixture(spark, sf_dir, "fx_pages"))


@query
def reconcile_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.reconcile_type(fixture(spark, sf_dir, "fx_text")).select("doc_id", "requested_type", "reconciled_type")


TEMPLATES = [(kind, f"Read the {kind.replace('_', ' ')} and answer with one JSON object.") for kind in payload.TYPES]


@query
def request_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    routed = pages.route_pages(fixture(spark, sf_dir, "fx_pages"))
    scanned = (
        routed.where("is_scanned")
        .groupBy("doc_id")
        .agg(F.sort_array(F.collect_list("page_number")).alias("scanned_pages"))
    )
    types = pages.reconcile_type(fixture(spark, sf_dir, "fx_text")).select("doc_id", F.col("reconciled_type").alias("document_type"))
    docs = (
        pages.page_context(routed)
        .join(types, "doc_id")
        .join(scanned, "doc_id", "left")
        .withColumn("scanned_pages", F.coalesce("scanned_pages", F.array().cast("array<int>")))
    )
    templates = spark.createDataFrame(TEMPLATES, "document_type string, instructions string")
    return pages.request_table(docs, templates)


@query
def redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Credentials in the documents' text, with some planted in front of it."""
    df = fixture(spark, sf_dir, "fx_text").select(
        "doc_id",
        F.expr(
            "concat(CASE doc_id % 5 WHEN 0 THEN 'GET /v1?key=abc-DEF_123&x=1 ' WHEN 1 THEN 'Authorization: Bearer  tok.en-1_2 ' "
            "WHEN 2 THEN concat('AIza', repeat('a1', 18), ' ') WHEN 3 THEN 'my secret-key-9 here ' ELSE '' END, text)"
        ).alias("text"),
    )
    rules = pages.DEFAULT_RULES + [(r'(token = ")[^"]+', "$1" + pages.MARK)]
    return pages.redact(df, ["text"], rules, literals=["secret-key-9", "abc"])


# --- files -----------------------------------------------------------------------------------------------------------


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.unhex("hex_content")
    return fixture(spark, sf_dir, "fx_files").select(
        "doc_id", "path", "name", content.alias("content"), F.length(content).cast("bigint").alias("length")
    )


def _triaged(spark: SparkSession, sf_dir: str, kinds: list[str] | None = None) -> DataFrame:
    done = triage.triage(_files(spark, sf_dir))
    if kinds:
        done = done.where(F.col("file_type").isin(kinds))
    return done.select("doc_id", "name", "file_type", "is_valid", "page_count", F.array_join("errors", "; ").alias("error"))


@query
def triage_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triage.detect_type(_files(spark, sf_dir)).select("doc_id", "name", "extension", "file_type")


@query
def triage_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triage.rejections(_files(spark, sf_dir)).select("doc_id", "name", "file_type", "error")


@query
def triage_pdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _triaged(spark, sf_dir, ["pdf"])


@query
def triage_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _triaged(spark, sf_dir, ["png", "jpeg"])


@query
def triage_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triage.prefilter(_files(spark, sf_dir), max_bytes=4000).select("doc_id", "name", "length")


# --- attempts --------------------------------------------------------------------------------------------------------


def _ladder(spark: SparkSession) -> DataFrame:
    models = spark.createDataFrame(
        [("alpha", False, 0), ("beta", False, 1), ("gamma-lite", True, 0)], "model string, is_lite boolean, position int"
    )
    return attempts.model_ladder(models, "beta")


@query
def classify_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = attempts.classify_attempts(fixture(spark, sf_dir, "fx_attempts"), _ladder(spark))
    return done.select("request_id", "model", "attempt", "error_class", "action", "wait_s")


@query
def resolve_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attempts.resolve_attempts(fixture(spark, sf_dir, "fx_attempts"), _ladder(spark))


# --- status, store and stream ----------------------------------------------------------------------------------------


def _ledger(spark: SparkSession, sf_dir: str, with_counts: bool = True) -> DataFrame:
    """The ledger over written results of each stage, so that no plan holds more than one stage or rule set."""

    def written(df: DataFrame, name: str) -> DataFrame:
        path = _scratch(spark, name)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    files, texts = triage.triage(_files(spark, sf_dir)), fixture(spark, sf_dir, "fx_pages")
    raw = fixture(spark, sf_dir, "fx_responses", spread=True)
    results = extraction_results(raw)
    responses = written(results.select("doc_id", "extraction_status", "reason", "checked_type"), "responses")
    if not with_counts:
        return report.stage_ledger(files, texts, responses)
    evidence = written(payload.explode_evidence(payload.parse_responses(raw)).select("doc_id"), "evidence")
    checks = [written(reconcile_tables(**{kind: tables}).select("doc_id", "document_type", "status"), kind) for kind, tables in _rule_tables(spark, sf_dir).items()]
    return report.stage_ledger(files, texts, responses, evidence, reduce(DataFrame.union, checks))


@query
def processing_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Final status of every file from the ledger of all stages; checks count by the document's own type."""
    return report.outcomes(_ledger(spark, sf_dir)).select("doc_id", "processing_status", "last_stage", "is_stored")


@query
def document_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is stored beside a document: its counts where it was checked, else why it was not."""
    stored = report.outcomes(_ledger(spark, sf_dir)).where("is_stored")
    return stored.drop("processing_status", "is_stored")


@query
def stage_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors and warnings of every stage in pieces; stages without messages have no row."""
    pieces = report.stage_messages(_ledger(spark, sf_dir, with_counts=False))
    return pieces.withColumn("messages", F.array_join("messages", "; "))


@query
def extraction_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors and warnings of the pages of each document in page order."""
    pieces = report.message_pieces(pages.page_messages(fixture(spark, sf_dir, "fx_pages")))
    return pieces.withColumn("messages", F.array_join("messages", "; "))


@query
def list_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = fixture(spark, sf_dir, "fx_stored")
    return documents.list_documents(stored, skip=20, limit=50, document_type="invoice", processing_status="COMPLETED")


@query
def document_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.document_by_name(fixture(spark, sf_dir, "fx_stored"), "statement-7.pdf")


@query
def document_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.document_by_id(fixture(spark, sf_dir, "fx_stored"), 42)


@query
def latest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.latest_documents(fixture(spark, sf_dir, "fx_stored"))


@query
def store_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append in two steps, then read the table back."""
    path = _scratch(spark, "documents")
    stored = fixture(spark, sf_dir, "fx_stored")
    for part in (stored.where("id % 2 = 0"), stored.where("id % 2 = 1")):
        documents.append_documents(part, path)
    return documents.read_documents(spark, path).select("id", "document_name", "document_type", "processing_status", "created_at")


@query
def store_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents appended in batches, one of them twice, compacted, then looked up by id and by name."""
    path = _scratch(spark, "documents")
    stored = fixture(spark, sf_dir, "fx_stored")
    for batch in (0, 1, 1):
        documents.append_documents(stored.where(F.col("id") % 2 == batch), path, f"part-{batch}")
    documents.compact(spark, path)
    by_id = documents.stored_by_id(spark, path, 42).withColumn("found_by", F.lit("id"))
    return by_id.unionByName(documents.stored_by_name(spark, path, "statement-7.pdf").withColumn("found_by", F.lit("name")))


@query
def stream_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses written as files, checked as a stream, summarised by rule and status."""
    source, out, marks, work = (_scratch(spark, n) for n in ("arrivals", "checks", "marks", "work"))
    responses = fixture(spark, sf_dir, "fx_responses", spread=True).withColumn("doc_id", F.col("doc_id").cast("string"))
    responses.write.parquet(source)
    stream = arrivals.read_response_stream(spark, source, "parquet")
    arrivals.stream_checks(stream, out, marks, work).awaitTermination()
    checks = spark.read.parquet(out)
    return checks.groupBy("document_type", report.rule_group(F.col("rule_name")).alias("rule"), "status").agg(
        F.count(F.lit(1)).alias("n_checks")
    )
