"""Balance-sheet, profit-and-loss and cash-flow rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerline.functions.checks import Rule, emit_checks, missing
from ledgerline.functions.numeric import DEFAULT_TOLERANCE, amount, exact_sum, is_filled, is_given, round_to, strip
from ledgerline.operators.lookups import BANK_METRICS, CASH_METRICS, contains_any, line_name, lookup_metrics

# Names and words that sort a balance-sheet line.
FOOTNOTES = ["contingent", "bills for collection", "commitments", "guarantees", "off-balance"]
TOTAL_NAMES = ["total", "total assets", "total capital and liabilities", "total liabilities and equity"]
LEFT_OUT = "|".join(FOOTNOTES) + "|^(?:" + "|".join(TOTAL_NAMES) + ")$"
FINANCING_CATEGORIES = ["liabilit", "equity", "capital"]
ASSET_WORDS = [
    "cash", "bank", "investment", "advance", "loan", "fixed asset", "property", "equipment", "receivable", "inventory",
    "goodwill",
]
FINANCING_WORDS = [
    "capital", "reserves", "surplus", "minority", "deposit", "borrowing", "provision", "payable", "liabilit", "equity",
    "debt",
]
TOTAL_FINANCING_FIELDS = [
    "total_liabilities_and_equity",
    "total_capital_and_liabilities",
    "total_equity_and_liabilities",
    "total_capital_liabilities",
]
SHARE_CAPITAL_FIELDS = ["share_capital", "capital"]

ASSET, FINANCING = "asset", "liability_equity"


def truthy_amount(df: DataFrame, names: list[str]) -> Column:
    """Amount of the first column that is neither null, empty nor a zero number; the last one as it is."""
    present = [n for n in names if n in df.columns]
    if not present:
        return F.lit(None).cast("double")
    chosen = amount(df, present[-1])
    for name in reversed(present[:-1]):
        chosen = F.when(is_filled(df, name), amount(df, name)).otherwise(chosen)
    return chosen


def balance_inputs(headers: DataFrame) -> DataFrame:
    plain = [
        "total_assets", "total_liabilities", "total_equity", "current_assets", "non_current_assets",
        "current_liabilities", "non_current_liabilities", "retained_earnings",
    ]
    return headers.select(
        "doc_id",
        *[amount(headers, c).alias(c) for c in plain],
        truthy_amount(headers, TOTAL_FINANCING_FIELDS).alias("total_financing"),
        truthy_amount(headers, SHARE_CAPITAL_FIELDS).alias("share_capital"),
    )


def classify_balance_lines(lines: DataFrame) -> DataFrame:
    """Lines that count as asset or as liability/equity; footnotes, totals and unknown lines are left out."""
    own = amount(lines, "amount")
    if "total_price" in lines.columns:
        own = F.when(is_given(lines, "amount"), own).otherwise(amount(lines, "total_price"))
    df = lines.select(
        "doc_id",
        "line_no",
        strip(line_name(lines)).alias("item_name"),
        F.lower(strip(line_name(lines))).alias("_name"),
        F.lower(F.coalesce(F.col("category"), F.lit(""))).alias("_category"),
        own.alias("amount"),
    ).where(F.col("amount").isNotNull() & ~F.col("_name").rlike(LEFT_OUT))
    financing_word = contains_any(F.col("_name"), FINANCING_WORDS)
    kind = (
        F.when(F.col("_category").contains("asset"), ASSET)
        .when(contains_any(F.col("_category"), FINANCING_CATEGORIES), FINANCING)
        .when(financing_word, FINANCING)
        .when(contains_any(F.col("_name"), ASSET_WORDS), ASSET)
    )
    return df.select("doc_id", "line_no", "item_name", "amount", kind.alias("line_class")).where("line_class IS NOT NULL")


def balance_stats(headers: DataFrame, lines: DataFrame | None) -> DataFrame:
    """Header inputs with count and sum of each line class; one exchange of pre-combined rows."""
    inputs = balance_inputs(headers)
    zero, null = F.lit(0).cast("bigint"), F.lit(None).cast("double")
    if lines is None:
        return inputs.withColumns({"n_assets": zero, "n_financing": zero, "sum_assets": null, "sum_financing": null})
    is_asset, is_financing = F.col("line_class") == ASSET, F.col("line_class") == FINANCING
    sums = (
        classify_balance_lines(lines)
        .groupBy("doc_id")
        .agg(
            F.count_if(is_asset).alias("n_assets"),
            F.count_if(is_financing).alias("n_financing"),
            exact_sum(F.when(is_asset, F.col("amount"))).alias("sum_assets"),
            exact_sum(F.when(is_financing, F.col("amount"))).alias("sum_financing"),
        )
    )
    return inputs.join(sums, "doc_id", "left").withColumns(
        {"n_assets": F.coalesce("n_assets", zero), "n_financing": F.coalesce("n_financing", zero)}
    )


def _needs(**inputs: Column) -> Column:
    return missing(**inputs)


def balance_sheet_rules() -> list[Rule]:
    c = F.col
    assets, liabilities, equity, financing = c("total_assets"), c("total_liabilities"), c("total_equity"), c("total_financing")
    none = F.lit("")
    both = liabilities.isNotNull() & equity.isNotNull()
    many_financing, many_assets = c("n_financing") >= 2, c("n_assets") >= 2
    funded = (
        F.when(both, round_to(liabilities + equity, 4))
        .when(financing.isNotNull(), financing)
        .when(many_financing, round_to(c("sum_financing"), 4))
    )
    no_source = financing.isNull() & (c("n_financing") == 0)
    equation_lacking = F.concat_ws(
        ", ",
        F.when(assets.isNull(), "total_assets"),
        F.when(liabilities.isNull() & no_source, "total_liabilities"),
        F.when(equity.isNull() & no_source, "total_equity"),
    )
    # A single liability/equity line is no basis for the equation, though nothing is named as missing then.
    unfunded = assets.isNull() | funded.isNull()
    equation_lacking = F.when(unfunded, equation_lacking).otherwise(none)

    split_given = c("current_assets").isNotNull() & c("non_current_assets").isNotNull() & assets.isNotNull()
    by_lines = many_assets & assets.isNotNull()
    some_split = c("current_assets").isNotNull() | c("non_current_assets").isNotNull()
    assets_lacking = (
        F.when(split_given | by_lines, none)
        .when(
            some_split,
            _needs(current_assets=c("current_assets"), non_current_assets=c("non_current_assets"), total_assets=assets),
        )
        .otherwise("asset_components")
    )
    target = F.coalesce(financing, assets)

    def pair(first: str, second: str, total: str) -> tuple[Column, Column]:
        any_given = c(first).isNotNull() | c(second).isNotNull()
        both_given = c(first).isNotNull() & c(second).isNotNull()
        return _needs(**{first: c(first), second: c(second), total: c(total)}), both_given | ((c("n_financing") == 0) & any_given)

    liabilities_lacking, liabilities_emit = pair("current_liabilities", "non_current_liabilities", "total_liabilities")
    equity_lacking, equity_emit = pair("retained_earnings", "share_capital", "total_equity")
    named = lambda *names: {n: c(n) for n in names}
    return [
        Rule(
            1,
            "balance_sheet_accounting_equation",
            F.when(unfunded | both, "total_liabilities + total_equity == total_assets")
            .when(financing.isNotNull(), "total_capital_and_liabilities == total_assets")
            .otherwise("sum(liability_and_equity_components) == total_assets"),
            funded,
            assets,
            equation_lacking,
            {**named("total_assets", "total_liabilities", "total_equity"), "total_capital_and_liabilities": financing},
            blocked=unfunded,
        ),
        Rule(
            2,
            "balance_sheet_total_assets_components",
            F.when(split_given | (~by_lines & some_split), "current_assets + non_current_assets == total_assets").otherwise(
                "sum(asset_components) == total_assets"
            ),
            F.when(split_given, round_to(c("current_assets") + c("non_current_assets"), 4)).otherwise(
                round_to(c("sum_assets"), 4)
            ),
            assets,
            assets_lacking,
            named("current_assets", "non_current_assets", "total_assets"),
        ),
        Rule(
            3,
            "balance_sheet_total_liabilities_and_equity_components",
            "sum(liability_and_equity_components) == total_capital_and_liabilities",
            round_to(c("sum_financing"), 4),
            target,
            none,
            {"total_capital_and_liabilities": target},
            emit=many_financing & target.isNotNull(),
        ),
        Rule(
            4,
            "balance_sheet_liabilities_and_equity_reconciliation",
            "total_liabilities + total_equity == total_liabilities_and_equity",
            round_to(liabilities + equity, 4),
            financing,
            none,
            {**named("total_liabilities", "total_equity"), "total_liabilities_and_equity": financing},
            emit=both & financing.isNotNull(),
        ),
        Rule(
            5,
            "balance_sheet_total_liabilities_components",
            "current_liabilities + non_current_liabilities == total_liabilities",
            round_to(c("current_liabilities") + c("non_current_liabilities"), 4),
            liabilities,
            liabilities_lacking,
            named("current_liabilities", "non_current_liabilities", "total_liabilities"),
            emit=liabilities_emit,
        ),
        Rule(
            6,
            "balance_sheet_total_equity_components",
            "retained_earnings + share_capital == total_equity",
            round_to(c("retained_earnings") + c("share_capital"), 4),
            equity,
            equity_lacking,
            named("retained_earnings", "share_capital", "total_equity"),
            emit=equity_emit,
        ),
    ]


def balance_sheet_checks(
    headers: DataFrame, lines: DataFrame | None = None, tolerance: float = DEFAULT_TOLERANCE, only: list[int] | None = None
) -> DataFrame:
    rules = [r for r in balance_sheet_rules() if only is None or r.order in only]
    return emit_checks(balance_stats(headers, lines), "balance_sheet", rules, tolerance)


PNL_FIELDS = [
    "total_revenue", "cost_of_goods_sold", "gross_profit", "operating_expenses", "operating_income", "interest_expense",
    "tax_expense", "net_income",
]


def _sum_rule(order: int, name: str, formula: str, terms: dict[str, tuple[int, Column]], total: str, reported: Column) -> Rule:
    """Signed sum of named terms against a reported figure; every one of them is required."""
    calculated = None
    for sign, column in terms.values():
        part = column if sign > 0 else -column
        calculated = part if calculated is None else (calculated + column if sign > 0 else calculated - column)
    inputs = {**{n: column for n, (_, column) in terms.items()}, total: reported}
    return Rule(order, name, formula, round_to(calculated, 4), reported, missing(**inputs), inputs)


def pnl_rules() -> list[Rule]:
    """Three corporate checks on header fields, five banking checks on looked-up metrics (prefixed m_)."""
    c = F.col
    m = lambda name: F.col(f"m_{name}")
    corporate = [
        _sum_rule(1, "pnl_gross_profit_calculation", "total_revenue - cost_of_goods_sold == gross_profit",
                  {"total_revenue": (1, c("total_revenue")), "cost_of_goods_sold": (-1, c("cost_of_goods_sold"))},
                  "gross_profit", c("gross_profit")),
        _sum_rule(2, "pnl_operating_income_calculation", "gross_profit - operating_expenses == operating_income",
                  {"gross_profit": (1, c("gross_profit")), "operating_expenses": (-1, c("operating_expenses"))},
                  "operating_income", c("operating_income")),
        _sum_rule(3, "pnl_net_income_calculation", "operating_income - interest_expense - tax_expense == net_income",
                  {"operating_income": (1, c("operating_income")), "interest_expense": (-1, c("interest_expense")),
                   "tax_expense": (-1, c("tax_expense"))},
                  "net_income", c("net_income")),
    ]
    bank = [
        _sum_rule(4, "pnl_bank_total_income", "interest_earned + other_income == total_income",
                  {"interest_earned": (1, m("interest_earned")), "other_income": (1, m("other_income"))},
                  "total_income", m("total_income")),
        _sum_rule(5, "pnl_bank_total_expenditure",
                  "interest_expended + operating_expenses + provisions_and_contingencies == total_expenditure",
                  {"interest_expended": (1, m("interest_expended")), "operating_expenses": (1, m("operating_expenses")),
                   "provisions_and_contingencies": (1, m("provisions"))},
                  "total_expenditure", m("total_expenditure")),
        _sum_rule(6, "pnl_bank_net_profit_before_minority", "total_income - total_expenditure == net_profit_for_the_year",
                  {"total_income": (1, m("total_income")), "total_expenditure": (-1, m("total_expenditure"))},
                  "net_profit_for_the_year", m("net_profit_year")),
        _sum_rule(7, "pnl_bank_consolidated_net_profit",
                  "net_profit_for_the_year - minority_interest == consolidated_net_profit",
                  {"net_profit_for_the_year": (1, m("net_profit_year")), "minority_interest": (-1, m("minority_interest"))},
                  "consolidated_net_profit", m("consolidated_profit")),
    ]
    appropriations = _sum_rule(
        8,
        "pnl_bank_appropriations_reconciliation",
        "consolidated_net_profit + brought_forward_profit == total_appropriations",
        {"consolidated_net_profit": (1, m("consolidated_profit")), "brought_forward_profit": (1, m("brought_forward"))},
        "total_appropriations",
        m("total_appropriations"),
    )
    added = m("amalgamation").isNotNull() & (appropriations.lacking == "")
    appropriations.formula = F.when(
        added, "consolidated_net_profit + brought_forward_profit + addition_on_amalgamation == total_appropriations"
    ).otherwise(appropriations.formula)
    appropriations.calculated = round_to(
        F.when(
            m("amalgamation").isNotNull(), m("consolidated_profit") + m("brought_forward") + m("amalgamation")
        ).otherwise(m("consolidated_profit") + m("brought_forward")),
        4,
    )
    appropriations.inputs["addition_on_amalgamation"] = m("amalgamation")
    return corporate + bank + [appropriations]


#: The metrics each banking check reads, by the check's order.
BANK_READS = {
    4: ["interest_earned", "other_income", "total_income"],
    5: ["interest_expended", "operating_expenses", "provisions", "total_expenditure"],
    6: ["total_income", "total_expenditure", "net_profit_year"],
    7: ["net_profit_year", "minority_interest", "consolidated_profit"],
    8: ["consolidated_profit", "brought_forward", "total_appropriations", "amalgamation"],
}


def pnl_checks(
    headers: DataFrame,
    lines: DataFrame | None = None,
    extra: DataFrame | None = None,
    tolerance: float = DEFAULT_TOLERANCE,
    only: list[int] | None = None,
) -> DataFrame:
    """Eight checks per document; only the metrics that the asked checks read are looked up."""
    rules = [r for r in pnl_rules() if only is None or r.order in only]
    read = {name for r in rules for name in BANK_READS.get(r.order, [])}
    if read:
        metrics = {name: metric for name, metric in BANK_METRICS.items() if name in read}
        docs = lookup_metrics(headers, lines, extra, metrics, keep=PNL_FIELDS)
    else:
        docs = headers.select("doc_id", *[amount(headers, c).alias(c) for c in PNL_FIELDS])
    return emit_checks(docs, "profit_and_loss", rules, tolerance)


CASH_FIELDS = [
    "net_cash_from_operating_activities", "net_cash_from_investing_activities", "net_cash_from_financing_activities",
    "net_change_in_cash", "beginning_cash_balance", "ending_cash_balance",
]


def cash_flow_rules() -> list[Rule]:
    c = F.col
    operating, investing, financing, change, beginning, ending = (c(n) for n in CASH_FIELDS)
    effect = F.col("m_exchange_effect")
    lacking = missing(**{n: c(n) for n in CASH_FIELDS[:4]})
    flows = " + ".join(CASH_FIELDS[:3])
    return [
        Rule(
            1,
            "cash_flow_net_change_calculation",
            F.when(
                (lacking == "") & effect.isNotNull(), f"{flows} + effect_of_exchange_rate_changes == net_change_in_cash"
            ).otherwise(f"{flows} == net_change_in_cash"),
            round_to(
                F.when(effect.isNotNull(), operating + investing + financing + effect).otherwise(
                    operating + investing + financing
                ),
                4,
            ),
            change,
            lacking,
            {**{n: c(n) for n in CASH_FIELDS[:4]}, "effect_of_exchange_rate_changes": effect},
        ),
        _sum_rule(
            2,
            "cash_flow_ending_cash_calculation",
            "beginning_cash_balance + net_change_in_cash == ending_cash_balance",
            {"beginning_cash_balance": (1, beginning), "net_change_in_cash": (1, change)},
            "ending_cash_balance",
            ending,
        ),
    ]


def cash_flow_checks(
    headers: DataFrame,
    lines: DataFrame | None = None,
    extra: DataFrame | None = None,
    tolerance: float = DEFAULT_TOLERANCE,
    only: list[int] | None = None,
) -> DataFrame:
    rules = [r for r in cash_flow_rules() if only is None or r.order in only]
    if any(r.order == 1 for r in rules):
        docs = lookup_metrics(headers, lines, extra, CASH_METRICS, keep=CASH_FIELDS)
    else:
        docs = headers.select("doc_id", *[amount(headers, c).alias(c) for c in CASH_FIELDS])
    return emit_checks(docs, "cash_flow_statement", rules, tolerance)
