"""Metric look-ups for banking and cash-flow statements: header, additional fields, then lines by keyword."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ledgerline.functions.numeric import amount, first_truthy, is_filled
from ledgerline.operators.fields import lookup_extra
from ledgerline.session import compiled_methods


@dataclass(frozen=True)
class Metric:
    """Where a metric may be found, in order: header_first, extra keys, line passes, header_last.

    A line pass is (category word or None, keywords); ``exclude`` words disqualify a name in every pass.
    """

    extra: list[str]
    passes: list[tuple[str | None, list[str]]]
    exclude: list[str] = field(default_factory=list)
    header_first: list[str] = field(default_factory=list)
    header_last: list[str] = field(default_factory=list)


# Look-up keys and keywords of every metric, in priority order.
BANK_METRICS = {
    "interest_earned": Metric(
        ["interest_earned", "interest_income"],
        [("income", ["interest earned", "interest income"]), (None, ["interest earned", "interest income"])],
    ),
    "other_income": Metric(
        ["other_income", "non_interest_income"],
        [
            ("income", ["other income", "non-interest income", "non interest income"]),
            (None, ["other income", "non-interest income", "non interest income"]),
        ],
    ),
    "total_income": Metric(
        ["total_income", "total_revenue"], [(None, ["total income", "total revenue"])], header_first=["total_revenue"]
    ),
    "interest_expended": Metric(
        ["interest_expended", "interest_expense"],
        [("expenditure", ["interest expended", "interest expense"]), (None, ["interest expended", "interest expense"])],
        header_first=["interest_expense"],
    ),
    "operating_expenses": Metric(
        ["operating_expenses", "operating_expense"],
        [("expenditure", ["operating expense"]), (None, ["operating expense"])],
        header_first=["operating_expenses"],
    ),
    "provisions": Metric(
        ["provisions_and_contingencies", "provisions_contingencies", "provisions"],
        [("expenditure", ["provisions"]), (None, ["provisions"])],
    ),
    "total_expenditure": Metric(
        ["total_expenditure", "total_expenses", "total_expenditures"],
        [("expenditure", ["total"]), (None, ["total expenditure", "total expenses"])],
        header_last=["total_expenditure"],
    ),
    "net_profit_year": Metric(
        [
            "net_profit_for_the_year",
            "profit_for_the_year",
            "net_profit_before_minority",
            "net_profit",
            "profit_before_minority_interest",
        ],
        [
            (
                "profit",
                ["profit for the year", "net profit before minority interest", "profit before minority interest"],
            ),
            (None, ["profit for the year"]),
        ],
    ),
    "minority_interest": Metric(
        ["minority_interest", "less_minority_interest", "minority_interests"],
        [("profit", ["minority interest"]), (None, ["minority interest"])],
        exclude=["before"],
    ),
    "consolidated_profit": Metric(
        [
            "consolidated_net_profit_for_the_year_attributable_to_the_group",
            "consolidated_profit_for_the_year_attributable_to_the_group",
            "consolidated_net_profit_attributable_to_group",
            "consolidated_profit_attributable_to_group",
            "consolidated_profit_for_the_year",
            "consolidated_net_profit",
            "consolidated_profit",
        ],
        [
            ("profit", ["consolidated net profit", "consolidated profit"]),
            (None, ["consolidated net profit", "consolidated profit"]),
        ],
        exclude=["brought forward", "before"],
        header_last=["net_income"],
    ),
    "brought_forward": Metric(
        [
            "brought_forward_consolidated_profit_attributable_to_the_group",
            "brought_forward_consolidated_profit",
            "balance_in_profit_and_loss_account_brought_forward",
            "balance_in_the_profit_and_loss_account_brought_forward",
            "balance_brought_forward",
            "profit_brought_forward",
            "brought_forward_profit",
            "brought_forward",
        ],
        [(None, ["brought forward"])],
    ),
    "total_appropriations": Metric(
        ["total_appropriations", "total_profit_and_brought_forward"],
        [("appropriations", ["total"]), (None, ["total appropriations"])],
    ),
    "amalgamation": Metric(
        ["addition_on_amalgamation", "amalgamation_addition", "amalgamation"],
        [("profit", ["amalgamation"]), (None, ["amalgamation"])],
    ),
}
CASH_METRICS = {
    "exchange_effect": Metric(
        [
            "effect_of_exchange_rate_changes",
            "effect_of_exchange_fluctuation",
            "exchange_fluctuation",
            "translation_reserve_exchange_fluctuation",
        ],
        [(None, ["effect of exchange rate changes", "exchange fluctuation"])],
        header_first=["effect_of_exchange_rate_changes", "exchange_rate_effect"],
    ),
}


def contains_any(text: Column, words: list[str]) -> Column:
    """Whether any word occurs in the text; the text is evaluated once, however many words there are."""
    return text.contains(words[0]) if len(words) == 1 else text.rlike("|".join(re.escape(w) for w in words))


def _plainly_contains(text: Column, words: list[str]) -> Column:
    """contains_any for a text that is a plain column: plain searches cost less than one pattern."""
    return reduce(Column.__or__, [text.contains(w) for w in words])


def line_name(lines: DataFrame) -> Column:
    names = [F.nullif(F.col(c), F.lit("")) for c in ("item_name", "description") if c in lines.columns]
    return F.coalesce(*names, F.lit(""))


def _line_amount(lines: DataFrame) -> Column:
    """The line's amount; an empty or zero one gives way to its total price."""
    own, other = amount(lines, "amount"), amount(lines, "total_price")
    if "amount" not in lines.columns:
        return other
    return F.when(is_filled(lines, "amount"), own).otherwise(other)


def lookup_lines(lines: DataFrame, metrics: dict[str, Metric]) -> DataFrame:
    """First matching line amount per document, metric and pass, as one map-side combined aggregation.

    The passes a line hits are the bits of one integer, so its name is searched once and not again in every aggregate.
    """
    df = compiled_methods(lines).select(
        "doc_id",
        "line_no",
        F.lower(line_name(lines)).alias("_name"),
        F.lower(F.coalesce(F.col("category"), F.lit(""))).alias("_category"),
        _line_amount(lines).alias("_amount"),
    ).where("_amount IS NOT NULL")
    bits, picks = [], []
    for name, metric in metrics.items():
        for index, (category, words) in enumerate(metric.passes):
            hit = _plainly_contains(F.col("_name"), words)
            if category:
                hit = F.col("_category").contains(category) & hit
            if metric.exclude:
                hit = hit & ~_plainly_contains(F.col("_name"), metric.exclude)
            bit = F.lit(1 << len(bits)).cast("bigint")
            bits.append(F.when(hit, bit).otherwise(F.lit(0).cast("bigint")))
            picks.append(F.min_by("_amount", F.when(F.col("_hits").bitwiseAND(bit) != 0, F.col("line_no"))).alias(f"{name}_{index}"))
    return df.withColumn("_hits", reduce(Column.bitwiseOR, bits)).where("_hits <> 0").groupBy("doc_id").agg(*picks)


def lookup_metrics(
    headers: DataFrame,
    lines: DataFrame | None,
    extra: DataFrame | None,
    metrics: dict[str, Metric],
    keep: list[str] | None = None,
) -> DataFrame:
    """Resolve every metric of each document as m_<metric>; a zero found before the last source counts as not found.

    ``keep`` carries header amounts along, so that the header is scanned and joined once.
    """
    null = F.lit(None).cast("double")
    keep = keep or []
    wanted = sorted({c for m in metrics.values() for c in m.header_first + m.header_last} | set(keep))
    df = headers.select("doc_id", *[amount(headers, column).alias(column) for column in wanted])
    if extra is not None:
        found = lookup_extra(extra, {name: m.extra for name, m in metrics.items()})
        df = df.join(found.select("doc_id", *[F.col(n).alias(f"x_{n}") for n in metrics]), "doc_id", "left")
    if lines is not None:
        df = df.join(lookup_lines(lines, metrics), "doc_id", "left")

    def resolve(name: str, metric: Metric) -> Column:
        sources = [F.col(c) for c in metric.header_first]
        sources.append(F.col(f"x_{name}") if extra is not None else null)
        sources += [F.col(f"{name}_{i}") if lines is not None else null for i in range(len(metric.passes))]
        sources += [F.col(c) for c in metric.header_last]
        return first_truthy(*sources)

    return df.select("doc_id", *keep, *[resolve(name, metric).alias(f"m_{name}") for name, metric in metrics.items()])
