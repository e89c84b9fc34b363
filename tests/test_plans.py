"""Shape of the physical plans and behaviour on a document that holds a third of all lines."""

import re

import pytest
from pyspark.sql import Window, functions as F

from ledgerline.operators.invoice import invoice_line_checks, line_stats
from ledgerline.operators.numbering import number_lines
from ledgerline.operators.statements import balance_sheet_checks, cash_flow_checks
from ledgerline.plans import queries
from ledgerline.plans.fixtures import fixture, invoice_lines


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return len(re.findall(r"Exchange (?:hash|range|single)", plan_of(df)))


@pytest.mark.parametrize("name", ["invoice_subtotal", "invoice_total", "bs_equation", "pnl_bank_income", "cf_net_change", "line_rows", "redact"])
def test_no_python_in_plans(spark, sf_dir, name):
    plan = plan_of(queries.QUERIES[name](spark, sf_dir))
    assert "EvalPython" not in plan and "MapInPandas" not in plan and "CartesianProduct" not in plan


def test_line_checks_need_no_exchange(spark, sf_dir):
    assert exchanges(invoice_line_checks(invoice_lines(spark, sf_dir, numbered=False))) == 0


def test_statement_rule_sets_need_few_exchanges(spark, sf_dir, tmp_path):
    for name in ("fx_balance_headers", "fx_balance_lines", "fx_cash_headers", "fx_cash_lines"):
        fixture(spark, sf_dir, name).write.parquet(str(tmp_path / name))
    table = lambda name: spark.read.parquet(str(tmp_path / name))
    assert exchanges(balance_sheet_checks(table("fx_balance_headers"), table("fx_balance_lines"))) <= 2
    assert exchanges(cash_flow_checks(table("fx_cash_headers"), table("fx_cash_lines"))) <= 2


def test_scan_reads_only_needed_columns(spark, sf_dir):
    plan = plan_of(line_stats(invoice_lines(spark, sf_dir, numbered=False), from_text=False))
    assert "l_shipdate" not in re.search(r"ReadSchema: (\S+)", plan).group(1)


def test_numbering_of_a_hot_document(spark):
    lines = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("doc_id"),
        (F.col("id") % 11).cast("int").alias("position"),
        (F.col("id") * 7919 % 10_000).alias("item"),
        F.col("id").alias("row"),
    )
    order = [F.col("position"), F.col("item"), F.col("row")]
    numbered = number_lines(lines, order, [F.col("position"), F.floor(F.col("item") / 500)])
    plain = lines.withColumn("want", F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)))
    wrong = numbered.join(plain.select("row", "want"), "row").where("line_no <> want").count()
    assert wrong == 0 and numbered.count() == 30_000


def test_partitioning_does_not_change_results(spark, sf_dir):
    headers, lines = fixture(spark, sf_dir, "fx_balance_headers"), fixture(spark, sf_dir, "fx_balance_lines")
    total = lambda df: df.select(F.sum(F.xxhash64("doc_id", "rule_name", "calculated_value", "variance", "status").cast("decimal(38,0)"))).first()[0]
    one = total(balance_sheet_checks(headers.coalesce(1), lines.coalesce(1)))
    many = total(balance_sheet_checks(headers.repartition(7), lines.repartition(5)))
    assert one == many
