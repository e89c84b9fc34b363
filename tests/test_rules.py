"""Literal payloads through the whole job: every payload is one document of a single run."""

import json

import pytest
from pyspark.sql import functions as F

from ledgerline.functions.numeric import exact_sum
from ledgerline.operators.report import failed_rules, summarize, summarize_documents, summarize_with_errors
from ledgerline.plans.reconcile import loose_results, validate_responses

P, X, N = "PASS", "FAILED", "NOT_APPLICABLE"


def line(description="thing", **values):
    return {"description": description, **values}


CASES = {
    # name: (document_type, payload, {rule: status or (status, calculated, variance)}, number of checks or None)
    "plain_invoice": ("invoice", {"subtotal": 300, "tax_amount": 30, "tax_rate": 0.1, "total_amount": 335, "shipping_amount": 5,
        "line_items": [line(quantity=2, unit_price=100, total_price=200), line(quantity=1, unit_price=100, total_price=100)]},
        {"invoice_line_item_1_math": (P, 200.0, 0.0), "invoice_line_item_2_math": P, "invoice_line_items_subtotal_reconciliation": (P, 300.0, 0.0),
         "invoice_total_reconciliation": (P, 335.0, 0.0), "invoice_tax_calculation": (P, 30.0, 0.0)}, 5),
    "no_lines": ("invoice", {"subtotal": 10, "total_amount": 10},
        {"invoice_line_item_math": N, "invoice_line_items_subtotal_reconciliation": N, "invoice_total_reconciliation": P}, 3),
    "aliases": ("invoice", {"taxable_value": "1,000.00", "tax": 0, "total": "1000",
        "line_items": [{"qty": "10", "rate": "$100", "amount": "1,000"}]},
        {"invoice_line_item_1_math": (P, 1000.0, 0.0), "invoice_line_items_subtotal_reconciliation": N,
         "invoice_total_reconciliation": P, "invoice_tax_calculation": (P, 0.0, 0.0)}, 4),
    "percent_text": ("invoice", {"subtotal": 1.05, "total_amount": 1.05, "line_items": [
        {"quantity": 6, "rate": 7.44, "discount": "99%", "amount": 0.45}, line(quantity=8, unit_price=7.44, discount="99 %", total_price=0.60)]},
        {"invoice_line_item_1_math": P, "invoice_line_item_2_math": P}, None),
    "money_discount": ("invoice", {"line_items": [line(quantity=2, unit_price=50, discount_amount=10, total_price=90),
        line(quantity=5, unit_price=20, discount="$15.00", total_price=85), line(quantity=5, unit_price=20, discount_amount=2, total_price=90)]},
        {"invoice_line_item_1_math": (P, 90.0, 0.0), "invoice_line_item_2_math": (P, 85.0, 0.0), "invoice_line_item_3_math": (P, 90.0, 0.0)}, None),
    "bare_discount": ("invoice", {"line_items": [line(quantity=1, unit_price=200, discount=10, total_price=180),
        line(quantity=1, unit_price=200, discount="10", total_price=190), line(quantity=1, unit_price=200, discount="10", total_price=150)]},
        {"invoice_line_item_1_math": (P, 180.0, 0.0), "invoice_line_item_2_math": (P, 190.0, 0.0), "invoice_line_item_3_math": (X, 200.0, 50.0)}, None),
    "snippet_discount": ("invoice", {"line_items": [line(quantity=6, unit_price=7.44, total_price=0.45, source_snippet="6 PCS 8.78 7.44 PCS 99 % 0.45"),
        line("Chair, less 20%", quantity=1, unit_price=50, total_price=40), line("Desk rebate: $5", quantity=1, unit_price=50, total_price=45),
        line("Lamp 30% cotton", quantity=1, unit_price=50, total_price=50)]},
        {"invoice_line_item_1_math": P, "invoice_line_item_2_math": (P, 40.0, 0.0), "invoice_line_item_3_math": (P, 45.0, 0.0),
         "invoice_line_item_4_math": (P, 50.0, 0.0)}, None),
    "missing_parts": ("invoice", {"subtotal": 5, "line_items": [line(quantity=1, unit_price=5), line(quantity=0, unit_price=5, total_price=0)]},
        {"invoice_line_item_1_math": N, "invoice_line_item_2_math": (P, 0.0, 0.0), "invoice_line_items_subtotal_reconciliation": N,
         "invoice_total_reconciliation": N}, None),
    "gst": ("invoice", {"subtotal": 700.75, "tax_amount": 126.14, "tax_rate": 0.18, "total_amount": 827.0,
        "additional_fields": {"Round-Off": 0.11, "cgst_amount": 63.07, "SGST Amount": "63.07"},
        "line_items": [line(quantity=10, unit_price=40.0, total_price=400.0), line(quantity=5, unit_price=15.0, total_price=0.75, source_snippet="PCS 99 % 0.75"),
            line(quantity=3, unit_price=100.0, total_price=300.0)]},
        {"invoice_tax_calculation": (P, 126.14, 0.0), "invoice_total_reconciliation": (P, 827.0, 0.0),
         "invoice_line_items_subtotal_reconciliation": P}, 6),
    "components_list": ("invoice", {"subtotal": 200, "tax_amount": 10, "total_amount": 210,
        "tax_components": [{"name": "IGST", "rate": "5%", "amount": 0}]}, {"invoice_tax_calculation": (P, 10.0, 0.0)}, None),
    "components_object": ("invoice", {"subtotal": 200, "tax_amount": 12, "total_amount": 212,
        "taxes": {"VAT": "5%", "cess": 2, "city": 9}}, {"invoice_tax_calculation": (P, 12.0, 0.0)}, None),
    "components_wrong": ("invoice", {"subtotal": 200, "tax_amount": 12, "total_amount": 212, "additional_fields": {"vat_rate": "5%", "vat": "30"}},
        {"invoice_tax_calculation": (X, 10.0, -2.0)}, None),
    "components_missing": ("invoice", {"tax_amount": 12, "additional_fields": {"vat_rate": "5%"}}, {"invoice_tax_calculation": N}, None),
    "inclusive": ("invoice", {"pricing_type": "Gross", "tax_rate": "20%", "tax_amount": 20, "total_amount": 120,
        "line_items": [line(quantity=1, unit_price=120, total_price=120)]},
        {"invoice_line_items_subtotal_reconciliation": (P, 120.0, 0.0), "invoice_total_reconciliation": (P, 120.0, 0.0),
         "invoice_tax_calculation": (P, 20.0, 0.0)}, 4),
    "inclusive_flag": ("invoice", {"subtotal": 100, "tax_amount": 20, "total_amount": 120,
        "line_items": [line(quantity=1, unit_price=120, total_price=120, is_tax_inclusive=True)]},
        {"invoice_line_items_subtotal_reconciliation": (P, 120.0, 0.0), "invoice_total_reconciliation": (P, 120.0, 0.0)}, None),
    "inclusive_phrase": ("invoice", {"subtotal": 100, "total_amount": 100, "additional_fields": {"note": "prices Inclusive of Tax"},
        "line_items": [line(quantity=1, unit_price=90, total_price=90)]}, {"invoice_line_items_subtotal_reconciliation": (X, 90.0, -10.0)}, None),
    "order_discount_in_lines": ("invoice", {"subtotal": 90, "discount_amount": 10, "total_amount": 90,
        "line_items": [line(quantity=1, unit_price=100, discount_percent=10, total_price=90)]}, {"invoice_total_reconciliation": (P, 90.0, 0.0)}, None),
    "order_discount": ("invoice", {"subtotal": 100, "discount_amount": 10, "total_amount": 90,
        "line_items": [line(quantity=1, unit_price=100, total_price=100)]}, {"invoice_total_reconciliation": (P, 90.0, 0.0)}, None),
    "tolerance": ("invoice", {"subtotal": 100, "tax_amount": 8.004, "total_amount": 108}, {"invoice_total_reconciliation": (P, 108.004, 0.004)}, None),
    "corporate_balance": ("balance_sheet", {"current_assets": 400, "non_current_assets": 600, "total_assets": 1000, "current_liabilities": 100,
        "non_current_liabilities": 300, "total_liabilities": 400, "retained_earnings": 250, "capital": 350, "total_equity": 600,
        "total_liabilities_and_equity": 1000},
        {"balance_sheet_accounting_equation": (P, 1000.0, 0.0), "balance_sheet_total_assets_components": P,
         "balance_sheet_liabilities_and_equity_reconciliation": P, "balance_sheet_total_liabilities_components": P,
         "balance_sheet_total_equity_components": P}, 5),
    "bank_balance": ("balance_sheet", {"total_assets": 900.0, "total_capital_and_liabilities": 900.0, "line_items": [
        {"item_name": n, "amount": a, "category": c} for n, a, c in [
            ("Capital", 50.0, "capital"), ("Reserves and surplus", 150.0, "equity"), ("Minority interest", 20.0, ""),
            ("Deposits", 480.0, "liability"), ("Borrowings", 120.0, None), ("Other liabilities and provisions", 80.0, "x"),
            ("Cash and balances with RBI", 100.0, "asset"), ("Balances with banks", 60.0, None), ("Investments", 210.0, "asset"),
            ("Advances", 430.0, ""), ("Fixed assets", 40.0, "asset"), ("Other assets", 60.0, "asset"),
            ("Contingent liabilities", 333.0, "footnote"), ("Bills for collection", 77.0, "footnote"), ("TOTAL", 5.0, "asset")]]},
        {"balance_sheet_accounting_equation": P, "balance_sheet_total_assets_components": (P, 900.0, 0.0),
         "balance_sheet_total_liabilities_and_equity_components": (P, 900.0, 0.0)}, 3),
    "empty_balance": ("balance_sheet", {}, {"balance_sheet_accounting_equation": N, "balance_sheet_total_assets_components": N}, 2),
    "corporate_pnl": ("profit_and_loss", {"total_revenue": "1,000", "cost_of_goods_sold": 400, "gross_profit": 600, "operating_expenses": 200,
        "operating_income": 400, "interest_expense": 50, "tax_expense": 100, "net_income": 251},
        {"pnl_gross_profit_calculation": P, "pnl_operating_income_calculation": P, "pnl_net_income_calculation": (X, 250.0, -1.0),
         "pnl_bank_total_income": N}, 8),
    "bank_pnl_fields": ("profit_and_loss", {"additional_fields": {"interest_earned": 700.0, "Other-Income": 130.0, "total_income": 830.0,
        "interest_expended": 310.0, "operating_expenses": 190.0, "provisions_and_contingencies": 75.0, "total_expenditure": 575.0,
        "net_profit_for_the_year": 255.0, "minority_interest": 15.0, "consolidated_net_profit": 240.0,
        "balance_in_profit_and_loss_account_brought_forward": 410.0, "total_appropriations": 650.0}},
        {r: P for r in ("pnl_bank_total_income", "pnl_bank_total_expenditure", "pnl_bank_net_profit_before_minority",
                        "pnl_bank_consolidated_net_profit", "pnl_bank_appropriations_reconciliation")}, 8),
    "bank_pnl_lines": ("profit_and_loss", {"line_items": [{"item_name": n, "category": c, "amount": a} for n, c, a in [
        ("I. Interest earned", "income", 100000.0), ("II. Other income", "income", 25000.0), ("TOTAL INCOME", "income", 125000.0),
        ("I. Interest expended", "expenditure", 60000.0), ("II. Operating expenses", "expenditure", 30000.0),
        ("III. Provisions and Contingencies", "expenditure", 10000.0), ("TOTAL EXPENDITURE", "expenditure", 100000.0),
        ("Net Profit for the year", "profit", 25000.0), ("Less: Minority Interest", "profit", 500.0),
        ("Consolidated Profit for the year", "profit", 24500.0), ("Balance in Profit and Loss Account brought forward", "appropriations", 50000.0),
        ("TOTAL", "appropriations", 74500.0)]]},
        {r: P for r in ("pnl_bank_total_income", "pnl_bank_total_expenditure", "pnl_bank_net_profit_before_minority",
                        "pnl_bank_consolidated_net_profit", "pnl_bank_appropriations_reconciliation")}, 8),
    "amalgamation": ("profit_and_loss", {"net_income": 36.0, "line_items": [{"item_name": n, "category": c, "amount": a} for n, c, a in [
        ("Consolidated Net Profit before minorities' interest", "profit", 40.0), ("Less: Minority Interest", "profit", 4.0),
        ("Consolidated Net Profit attributable to the group", "profit", 36.0),
        ("Brought forward consolidated profit", "profit", 71.5), ("Addition on amalgamation", "profit", 2.5), ("Total", "appropriations", 110.0)]]},
        {"pnl_bank_appropriations_reconciliation": (P, 110.0, 0.0)}, 8),
    "cash_text": ("cash_flow_statement", {"net_cash_from_operating_activities": "850,000.00", "net_cash_from_investing_activities": "(400,000.00)",
        "net_cash_from_financing_activities": "-150000", "net_change_in_cash": 300000, "beginning_cash_balance": 500000, "ending_cash_balance": 800000},
        {"cash_flow_net_change_calculation": (P, 300000.0, 0.0), "cash_flow_ending_cash_calculation": P}, 2),
    "cash_exchange": ("cash_flow_statement", {"net_cash_from_operating_activities": -90.0, "net_cash_from_investing_activities": -35.0,
        "net_cash_from_financing_activities": 160.0, "net_change_in_cash": 42.0, "beginning_cash_balance": 1,
        "line_items": [{"item_name": "Effect of exchange fluctuation on translation reserve", "amount": 7.0}]},
        {"cash_flow_net_change_calculation": (P, 42.0, 0.0), "cash_flow_ending_cash_calculation": N}, 2),
    "named_type": ("invoice", {"document_type": "Cash_Flow_Statement", "net_change_in_cash": 1}, {"cash_flow_net_change_calculation": N}, 2),
    "given_away": ("invoice", {"total_assets": None, "current_assets": 5}, {"balance_sheet_accounting_equation": N}, 2),
    "unsupported": ("receipt", {"subtotal": 1}, {}, 0),
}


@pytest.fixture(scope="module")
def loose(spark, tmp_path_factory):
    rows = [(name, kind, json.dumps(body)) for name, (kind, body, _, _) in CASES.items()]
    df = spark.createDataFrame(rows, "doc_id string, document_type string, raw string")
    checks = validate_responses(df, str(tmp_path_factory.mktemp("loose")), typed=False)
    return checks.persist()


@pytest.fixture(scope="module")
def by_document(loose):
    found = {}
    for row in loose.collect():
        found.setdefault(row.doc_id, {})[row.rule_name] = row
    return found


@pytest.mark.parametrize("name", CASES)
def test_payload(by_document, name):
    _, _, wanted, count = CASES[name]
    checks = by_document.get(name, {})
    for rule, want in wanted.items():
        row = checks[rule]
        status, *numbers = want if isinstance(want, tuple) else (want,)
        assert row.status == status, row
        if numbers:
            assert row.calculated_value == pytest.approx(numbers[0], abs=1e-9)
            assert row.variance == pytest.approx(numbers[1], abs=1e-9)
        if status == N:
            assert row.calculated_value is None and row.variance is None
    if count is not None:
        assert len(checks) == count, sorted(checks)


def test_missing_fields_and_formulas(by_document):
    assert by_document["missing_parts"]["invoice_line_item_1_math"].missing_fields == ["total_price"]
    assert by_document["missing_parts"]["invoice_total_reconciliation"].missing_fields == ["total_amount"]
    assert by_document["empty_balance"]["balance_sheet_accounting_equation"].missing_fields == [
        "total_assets", "total_liabilities", "total_equity",
    ]
    assert by_document["gst"]["invoice_tax_calculation"].formula == "cgst_amount + sgst_amount == tax_amount"
    assert by_document["money_discount"]["invoice_line_item_3_math"].formula == "quantity * (unit_price - discount_amount) == total_price"
    assert by_document["percent_text"]["invoice_line_item_1_math"].input_values["discount_percent"] == 99.0


def test_summary_counts_add_up(loose):
    for row in summarize(loose).collect():
        assert row.passed_checks + row.failed_checks + row.not_applicable_checks == row.total_checks
        assert row.is_valid == (row.failed_checks == 0)


def test_error_sentence_counts_and_rows_name_failed_checks(spark, loose):
    errors = {row.doc_id: row.error for row in summarize_with_errors(loose).collect()}
    assert errors["corporate_pnl"] == "Financial validation failed 1 check(s)."
    many = spark.range(1, 1002).selectExpr(
        "7L AS doc_id", "'invoice' AS document_type", "concat('line_', id) AS rule_name", "'FAILED' AS status", "1 AS rule_order", "id AS line_no"
    )
    assert summarize_with_errors(many).first().error == "Financial validation failed 1001 check(s)."
    assert sum(len(r.failed_rules.split(", ")) for r in failed_rules(many).collect()) == 1001
    assert errors["plain_invoice"] is None
    pieces = {row.doc_id for row in failed_rules(loose).where("failed_rules <> ''").collect()}
    assert pieces == {doc for doc, text in errors.items() if text}


def test_tight_tolerance_fails(spark, tmp_path):
    kind, body, _, _ = CASES["tolerance"]
    df = spark.createDataFrame([("t", kind, json.dumps(body))], "doc_id string, document_type string, raw string")
    checks = {r.rule_name: r.status for r in validate_responses(df, str(tmp_path), tolerance=0.001, typed=False).collect()}
    assert checks["invoice_total_reconciliation"] == X


RAW_CASES = {
    # name: (document_type, text, rule, status, calculated, formula or None)
    "unread_subtotal": ("invoice", '{"subtotal": "N/A", "taxable_amount": 100, "total_amount": 100}', "invoice_total_reconciliation", N, None, None),
    "null_subtotal": ("invoice", '{"subtotal": null, "taxable_amount": 100, "total_amount": 100, "x": "$1", "due_date": 5}',
        "invoice_total_reconciliation", P, 100.0, None),
    "unread_financing": ("balance_sheet", '{"total_assets": 100, "total_liabilities_and_equity": "N/A", "total_capital_and_liabilities": 100}',
        "balance_sheet_accounting_equation", N, None, None),
    "zero_financing": ("balance_sheet", '{"total_assets": 100, "total_liabilities_and_equity": 0, "total_capital_and_liabilities": 100, "currency": 5}',
        "balance_sheet_accounting_equation", P, 100.0, None),
    "unread_line": ("profit_and_loss", json.dumps({"line_items": [
        {"item_name": "Interest earned", "amount": "N/A", "total_price": 7}, {"item_name": "Interest earned", "amount": 9},
        {"item_name": "Other income", "amount": 0, "total_price": 1}, {"item_name": "Total income", "amount": 10}]}),
        "pnl_bank_total_income", P, 10.0, None),
    "unread_line_total": ("invoice", '{"line_items": [{"quantity": 1, "unit_price": 5, "total_price": "N/A", "amount": 5}]}',
        "invoice_line_item_1_math", N, None, None),
    "repeated_key": ("invoice", '{"subtotal": 1, "subtotal": 100, "total_amount": 100}', "invoice_total_reconciliation", P, 100.0, None),
    "repeated_extra": ("invoice", '{"subtotal": 100, "total_amount": 101, "additional_fields": {"round_off": 5, "round_off": 1}}',
        "invoice_total_reconciliation", P, 101.0, None),
    "written_order": ("invoice", '{"subtotal": 100, "tax_amount": 10, "tax_components": {"sgst": 5, "cgst": 5}}',
        "invoice_tax_calculation", P, 10.0, "sgst_amount + cgst_amount == tax_amount"),
}


@pytest.mark.parametrize("typed", [True, False])
def test_what_is_written_decides(spark, tmp_path, typed):
    rows = [(name, kind, text) for name, (kind, text, *_) in RAW_CASES.items()]
    df = spark.createDataFrame(rows, "doc_id string, document_type string, raw string")
    got = {(r.doc_id, r.rule_name): r for r in validate_responses(df, str(tmp_path), typed=typed).collect()}
    for name, (_, _, rule, status, calculated, formula) in RAW_CASES.items():
        row = got[name, rule]
        assert (row.status, row.calculated_value) == (status, calculated), (typed, row)
        assert formula is None or row.formula == formula


def test_every_document_has_a_summary(spark, loose):
    rows = [(name, kind, json.dumps(body)) for name, (kind, body, _, _) in CASES.items()]
    documents = loose_results(spark.createDataFrame(rows, "doc_id string, document_type string, raw string"))
    got = {r.doc_id: r for r in summarize_documents(loose, documents).collect()}
    assert set(got) == set(CASES)
    assert (got["unsupported"].total_checks, got["unsupported"].is_valid) == (0, False) and "receipt" in got["unsupported"].error
    assert got["plain_invoice"].is_valid and got["plain_invoice"].error is None and got["given_away"].document_type == "balance_sheet"


def test_sums_hold_or_are_null(spark):
    df = spark.sql("SELECT * FROM VALUES (1, 0.1D), (1, 0.2D), (2, 1e21D), (2, 1D), (3, 1e23D), (3, 1D) AS t(k, v)")
    got = {r.k: r.s for r in df.groupBy("k").agg(exact_sum(F.col("v")).alias("s")).collect()}
    assert got == {1: 0.3, 2: 1e21, 3: None}
