import math

import pytest
from pyspark.sql import functions as F

from ledgerline.functions.numeric import (
    display_bytes,
    display_key,
    display_number,
    exact_sum,
    first_truthy,
    normalize_rates,
    parse_amount,
    round_to,
    truncate_cents,
)

AMOUNTS = [
    ("1,234.50", 1234.5), ("  42 ", 42.0), ("$1,000", 1000.0), ("€ 99.95", 99.95), ("£3", 3.0), ("₹ 1,20,000.50", 120000.5),
    ("USD 12.30", 12.3), ("12.30 EUR", 12.3), ("(400,000)", -400000.0), ("( $1,234.50 )", -1234.5), ("8%", 0.08),
    ("(5%)", -0.05), ("1,234.50-", -1234.5), ("500 CR", -500.0), ("500cr", -500.0), ("-7", -7.0), ("- 7.5", -7.5), ("+3.25", 3.25),
    ("5% CR", -0.05), ("1.234,56", 1.23456), ("1e5", 15.0), ("1.5 million", 1.5), ("12,5", 12.5), ("1,234", 1234.0),
    ("12,345,6", 123456.0), ("1_000", 1000.0), (" 7 ", 7.0), ("-$-5", -5.0), ("(-5)", -5.0), (".5", 0.5), ("5.", 5.0),
    ("0.1234567", 0.123457), ("99999999999999999999999999999999999", 1e35),
    ("", None), ("  ", None), ("null", None), ("None", None), ("N/A", None), ("na", None), ("-", None), ("--", None), ("nil", None),
    ("abc", None), ("1-2", None), ("5-CR", None), ("(5)-", None), ("()", None), ("1.2.3", None), ("%", None), ("((5))", None), (None, None),
]


def test_printed_amounts(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(AMOUNTS)], "i int, t string")
    got = {row.i: row.a for row in df.select("i", parse_amount(F.col("t")).alias("a")).collect()}
    for i, (text, want) in enumerate(AMOUNTS):
        assert got[i] == (pytest.approx(want, rel=1e-12) if want is not None else None), text


def test_rates(spark):
    cases = [("9", 0.09), ("0.09", 0.09), ("9%", 0.09), ("150", None), ("-3", None), ("150%", 1.5), ("n/a", None), ("1", 1.0)]
    df = spark.createDataFrame([(t, w) for t, w in cases], "r string, want double")
    for row in normalize_rates(df, ["r"]).collect():
        assert row.r == row.want


def test_rounding_and_cuts(spark):
    df = spark.createDataFrame([(0.125, 2.00005, 8.29, 35306812345678.91)], "a double, b double, c double, big double")
    row = df.select(
        round_to(F.col("a"), 2).alias("half_even"),
        round_to(F.col("b"), 4).alias("four"),
        truncate_cents(F.lit(523.3653)).alias("cut"),
        round_to(F.col("big"), 4).alias("big"),
    ).first()
    assert row.half_even == 0.12 and row.cut == 523.36 and row.big == 35306812345678.91 and math.isclose(row.four, 2.0, abs_tol=1e-4)


def test_sum_does_not_depend_on_partitions(spark):
    df = spark.range(10_000).select((F.col("id") * 0.1 + 0.07).alias("v"))
    sums = {df.repartition(n).agg(exact_sum(F.col("v")).alias("s")).first().s for n in (1, 3, 7)}
    assert len(sums) == 1


def test_zero_counts_as_missing_except_last(spark):
    row = spark.range(1).select(
        first_truthy(F.lit(0.0), F.lit(5.0), F.lit(7.0)).alias("a"),
        first_truthy(F.lit(0.0), F.lit(None).cast("double"), F.lit(0.0)).alias("b"),
        first_truthy(F.lit(0.0), F.lit(None).cast("double")).alias("c"),
    ).first()
    assert (row.a, row.b, row.c) == (5.0, 0.0, None)


def test_display(spark):
    row = spark.range(1).select(
        display_number(F.lit(1234567.5)).alias("n"),
        display_number(F.lit(-0.25)).alias("m"),
        display_key(F.lit("net_cash_total")).alias("k"),
        display_bytes(F.lit(1536)).alias("b"),
        display_bytes(F.lit(0)).alias("z"),
    ).first()
    assert (row.n, row.m, row.k, row.b, row.z) == ("1,234,567.5", "-0.25", "Net Cash Total", "1.5 KB", "0 Bytes")
