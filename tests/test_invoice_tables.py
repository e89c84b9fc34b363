"""The invoice rule set as one aggregation: exchanges, a document of a third of all lines, components against plain code."""

import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import fields, invoice, taxes
from ledgerline.plans.fixtures import fixture, invoice_lines


def exchanges(df):
    return len(re.findall(r"Exchange (?:hash|range|single|Round)", df._jdf.queryExecution().executedPlan().toString()))


@pytest.fixture(scope="module")
def tables(spark, sf_dir, tmp_path_factory):
    folder = tmp_path_factory.mktemp("invoice")
    fixture(spark, sf_dir, "fx_invoice_headers").write.parquet(f"{folder}/headers")
    fields.with_field_values(fixture(spark, sf_dir, "fx_invoice_extra")).write.parquet(f"{folder}/extra")
    invoice_lines(spark, sf_dir, numbered=False).write.parquet(f"{folder}/lines")
    spark.createDataFrame([], "doc_id bigint, pos int, name string, rate double, amount double").write.parquet(f"{folder}/components")
    return [spark.read.parquet(f"{folder}/{name}") for name in ("headers", "lines", "extra", "components")]


def test_exchanges(tables):
    headers, lines, extra, components = tables
    assert exchanges(invoice.invoice_header_checks(invoice.invoice_inputs(headers, lines), only=[2])) == 1
    assert exchanges(invoice.invoice_header_checks(invoice.invoice_inputs(headers, lines, extra), only=[1, 2, 3])) == 1
    # With components: fields, then lines by (document, salt), then what is left of each salt.
    assert exchanges(invoice.invoice_checks(headers, lines, extra)) == 3
    assert exchanges(invoice.invoice_checks(headers, lines, extra, components)) == 3


def test_each_table_is_read_once(tables):
    headers, lines, extra, components = tables
    plan = invoice.invoice_header_checks(invoice.invoice_inputs(headers, lines, extra, components=components, taxes=True))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 4 and "Join" not in plan


def test_a_third_of_all_lines_in_one_document(spark):
    """The hot document's tax only adds up line by line; its lines are spread over the salts."""
    n = 6000
    rows = [(100_007 if i % 3 == 0 else i, i, 0.1 + (i % 10) / 100) for i in range(n)]
    lines = spark.createDataFrame(rows, "doc_id bigint, line_no int, total_price double").repartition(5)
    by_line, plain = defaultdict(float), defaultdict(float)
    for doc, _, price in rows:
        by_line[doc] += round(price * 0.05, 2)
        plain[doc] += price
    headers = spark.createDataFrame([(d, plain[d], by_line[d], plain[d] + by_line[d]) for d in plain], "doc_id bigint, subtotal double, tax_amount double, total_amount double")
    extra = fields.with_field_values(
        spark.createDataFrame([(100_007, 1, 0, "igst_rate", "5%", True), (100_007, 1, 1, "igst_amount", f"{by_line[100_007]:.2f}", True)], "doc_id bigint, source int, pos int, key string, text string, is_text boolean")
    )
    inputs = invoice.invoice_inputs(headers, lines, extra, taxes=True)
    hot = inputs.where("doc_id = 100007").first()
    assert hot.n_lines == n // 3 and hot.line_sum == pytest.approx(plain[100_007])
    assert abs(plain[100_007] * 0.05 - by_line[100_007]) > 0.05  # no reading of the header explains it
    assert (hot.n_components, hot.component_sum) == (1, pytest.approx(by_line[100_007]))
    assert inputs.count() == len(plain)
    groups = lines.where("doc_id = 100007").groupBy(F.pmod(F.xxhash64("line_no", "total_price"), F.lit(taxes.SALTS))).count()
    assert groups.agg(F.max("count")).first()[0] < 2 * n / 3 / taxes.SALTS * 1.5


def test_structured_components_hide_fields(spark):
    headers = spark.createDataFrame([(1, 100.0, 9.0, 109.0), (2, 100.0, 9.0, 109.0)], "doc_id bigint, subtotal double, tax_amount double, total_amount double")
    lines = spark.createDataFrame([(1, 100.0), (3, 5.0)], "doc_id bigint, total_price double")
    entries = [(1, 0, "vat", 0.05, None), (1, 1, "city tax", None, 4.0), (1, 2, "vat", 0.05, 5.0)]
    components = spark.createDataFrame(entries, "doc_id bigint, pos int, name string, rate double, amount double")
    extra = fields.with_field_values(
        spark.createDataFrame([(1, 1, 0, "vat_amount", "7", True), (1, 1, 1, "cess", "1", True), (2, 1, 0, "vat", "9", True)], "doc_id bigint, source int, pos int, key string, text string, is_text boolean")
    )
    inputs = invoice.invoice_inputs(headers, lines, extra, components=components, taxes=True)
    found = {(r.doc_id, r.name): (r.component_order, r.rate, r.amount, r.calculated_amount) for r in taxes.part_rows(inputs, "component_order", "name", "rate", "amount", "calculated_amount").collect()}
    assert found == {(1, "vat"): (0, 0.05, 5.0, 5.0), (1, "city tax"): (1, None, 4.0, 4.0), (1, "cess"): (1004, None, 1.0, 1.0), (2, "vat"): (1005, None, 9.0, 9.0)}
    assert {r.doc_id: r.component_formula for r in inputs.collect()}[1] == "vat_amount + city tax_amount + cess_amount == tax_amount"
