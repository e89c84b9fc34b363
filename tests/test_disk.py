"""Rows that are shuffled: lines once by their document, the narrow table instead of the wide view."""

import re

import pytest
from pyspark.sql import Window, functions as F

from ledgerline.operators import fields, invoice, taxes
from ledgerline.operators.numbering import hot_keys, number_lines
from ledgerline.plans import queries
from ledgerline.plans.fixtures import fixture, invoice_lines


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanged(df):
    return re.findall(r"Exchange hashpartitioning\(([^)]*), \d+\)", plan_of(df))


def test_lines_are_numbered_in_one_exchange_without_a_join(spark, sf_dir):
    plan = plan_of(invoice_lines(spark, sf_dir))
    assert plan.count("Exchange") == 1 and "Join" not in plan
    below = re.search(r"Exchange hashpartitioning.*?\n(.*?)\n", plan).group(1)
    assert "ext#" not in below and "description" not in below  # the table's columns, not the view's


def test_sums_of_lines_do_not_number_them(spark, sf_dir):
    inputs = invoice.invoice_inputs(fixture(spark, sf_dir, "fx_invoice_headers"), invoice_lines(spark, sf_dir), fields.with_field_values(fixture(spark, sf_dir, "fx_invoice_extra")), taxes=True)
    assert "row_number" not in plan_of(inputs)


@pytest.mark.parametrize("name, most", [("all_checks", 14), ("rule_report", 16)])
def test_statements_shuffle_their_table_not_their_views(spark, sf_dir, name, most):
    keys = exchanged(queries.QUERIES[name](spark, sf_dir))
    assert len(keys) <= most and sum("o_orderkey" in k for k in keys) >= 5


def lines_with_hot_ones(spark):
    return spark.range(12_000).select(
        F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 101 == 1, None).otherwise(F.col("id") % 2500).alias("doc_id"),
        F.when(F.col("id") % 97 != 0, F.col("id") % 11).cast("int").alias("position"),
        (F.col("id") * 7919 % 10_000).alias("item"),
        F.col("id").alias("row"),
    )


def test_hot_keys_are_found_and_small_ones_are_not(spark):
    rows = lines_with_hot_ones(spark)
    assert hot_keys(rows) == [7] and hot_keys(rows.where("doc_id <> 7")) == [] and hot_keys(rows.limit(0)) == []
    assert hot_keys(rows.select(F.col("doc_id").cast("string"))) == ["7"]


def test_numbers_of_hot_and_other_documents(spark):
    lines = lines_with_hot_ones(spark)
    order = [F.col("position"), F.col("item"), F.col("row")]
    bucket = [F.col("position"), F.floor(F.col("item") / 500)]
    for some, spreads in ((lines, True), (lines.where("doc_id IS NULL OR doc_id <> 7"), False)):
        counted = some.where("doc_id IS NOT NULL").withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)))
        want = counted.where("position IS NOT NULL")  # lines without a position are counted, but not kept
        numbered = number_lines(some, order, bucket)
        assert sorted((r.row, r.line_no) for r in numbered.collect()) == sorted((r.row, r.n) for r in want.collect())
        assert ("_b0" in plan_of(numbered)) == spreads


def test_lines_of_a_document_that_is_not_hot_meet_in_one_salt(spark):
    docs = spark.range(3).selectExpr("id AS doc_id", f"CAST(array() AS {taxes.PARTS}) AS parts", "CAST(array() AS array<struct<no:int,rate:double>>) AS open_rates")
    rows = [(i % 2 if i < 40 else 2, i, float(i), False, False) for i in range(2040)]
    lines = spark.createDataFrame(rows, "doc_id bigint, line_no int, own_total double, is_inclusive boolean, has_discount boolean")
    met = {r.doc_id: (r.n_lines, r.total_sum) for r in taxes.meet_lines(docs, lines).collect()}
    assert met == {0: (20, 380.0), 1: (20, 400.0), 2: (2000, float(sum(range(40, 2040))))}
    salt = re.search(r"CASE WHEN (.*?) THEN .*? END(?: AS int\))? AS salt", taxes.meet_lines(docs, lines)._jdf.queryExecution().optimizedPlan().toString())
    assert salt and "2" in salt.group(1)
