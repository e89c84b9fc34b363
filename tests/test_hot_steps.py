"""Steps that every row goes through: searched once, worked out once, and small enough for the JVM to compile."""

from pyspark.sql import functions as F

from ledgerline.operators import invoice, lookups, taxes
from ledgerline.plans import queries
from ledgerline.plans.fixtures import fan_out, fixture

LINES = "doc_id bigint, line_no int, item_name string, category string, amount double"


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_line_is_searched_once_not_in_every_aggregate(spark):
    rows = [
        (1, 2, "Interest Earned", "Income", 5.0), (1, 1, "interest income", None, 7.0), (1, 3, None, "income", 1.0), (1, 4, "Total", "EXPENDITURE", 9.0),
        (2, 1, "profit before Minority Interest", "Profit", 3.0), (2, 2, "minority interest", "profit", None), (2, None, "Other Income", "", 4.0), (3, 1, "none of them", "", 1.0),
    ]
    found = lookups.lookup_lines(spark.createDataFrame(rows, LINES), lookups.BANK_METRICS)
    aggregate = next(line for line in optimized(found).splitlines() if "Aggregate" in line)
    assert "Contains" not in aggregate and "RLIKE" not in aggregate
    got = {r.doc_id: {k: v for k, v in r.asDict().items() if v is not None and k != "doc_id"} for r in found.collect()}
    assert got[1] == {"interest_earned_0": 5.0, "interest_earned_1": 7.0, "total_expenditure_0": 9.0}
    assert got[2] == {"net_profit_year_0": 3.0} and 3 not in got  # "before" disqualifies the first, no amount the second


def test_components_are_not_worked_out_again_for_a_filter(spark):
    headers = spark.createDataFrame([(1, 100.0, 10.0), (2, 50.0, 1.0)], "doc_id bigint, subtotal double, tax_amount double")
    extra = spark.createDataFrame(
        [(1, 1, 0, "vat", "vat", "10", False, 10.0, None)], "doc_id bigint, source int, pos int, key string, key_norm string, text string, is_text boolean, num double, rate double"
    )
    docs = invoice.invoice_inputs(headers, None, extra, taxes=True)
    parts = taxes.part_rows(docs, "name", "amount")
    assert [tuple(r) for r in parts.collect()] == [(1, "vat", 10.0)]
    assert "size(parts" not in optimized(parts) and optimized(parts).count("array_sort") <= 1


def test_stages_that_cannot_be_compiled_are_given_up(spark, sf_dir):
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "65535")
    queries.QUERIES["all_checks"](spark, sf_dir)
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"


def test_rows_are_made_only_where_their_condition_holds(spark):
    spark.range(6).createOrReplaceTempView("fanned")
    sql = fan_out("spark", "(SELECT id AS doc_id FROM fanned) b", ["n"], [["raise_error('made')", "doc_id < 0"], ["doc_id * 2", "doc_id % 2 = 0"], ["7", "IF(doc_id = 1, NULL, doc_id = 3)"]])
    assert sorted((r.doc_id, r.n) for r in spark.sql(sql).select("doc_id", F.col("n").cast("int")).collect()) == [(0, 0), (2, 4), (3, 7), (4, 8)]


def test_responses_of_a_single_row_group_are_parsed_by_many_tasks(spark, sf_dir):
    plain, spread = (fixture(spark, sf_dir, "fx_responses", spread=s) for s in (False, True))
    assert plain.rdd.getNumPartitions() == 1 and spread.where("length(raw) > 0").rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
    assert spread.exceptAll(plain).isEmpty() and plain.exceptAll(spread).isEmpty()
