"""Financial documents derived from the star-schema tables.

The tables hold no invoices or statements, so every query runs on views over them. A view is SQL text that both Spark
and the checking database accept; where a row fans out into several rows the two dialects are written by ``fan_out``.
Errors and gaps are planted by key arithmetic so that every outcome of every rule occurs. All views grow with the tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerline.operators.numbering import number_lines

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
]


def fan_out(engine: str, base: str, columns: list[str], rows: list[list[str]], carry: str = "doc_id") -> str:
    """SELECT that turns each base row into the rows whose last expression (their condition) holds."""
    names = [*columns, "keep"]
    if engine == "spark":
        # A row is made only where its condition holds, and in a projection of its own, which Spark compiles in parts.
        packed = [f"IF({row[-1]}, named_struct({', '.join(f'{n!r}, {e}' for n, e in zip(names, row))}), NULL)" for row in rows]
        inner = f"SELECT {carry}, explode(made) AS u FROM (SELECT {carry}, array({', '.join(packed)}) AS made FROM {base}) m"
    else:
        packed = ["{" + ", ".join(f"'{n}': {e}" for n, e in zip(names, row)) + "}" for row in rows]
        inner = f"SELECT {carry}, unnest([{', '.join(packed)}]) AS u FROM {base}"
    return f"SELECT {carry}, {', '.join(f'u.{c} AS {c}' for c in columns)} FROM ({inner}) t WHERE u.keep"


def cents(expression: str) -> str:
    return f"FLOOR(({expression}) * 100 + 0.5) / 100"


def money(expression: str) -> str:
    """Number as JSON text, null as JSON null."""
    return f"COALESCE(CAST(CAST({expression} AS DECIMAL(20,2)) AS STRING), 'null')"


def json_object(members: list[tuple[str, str]]) -> str:
    """Text of a JSON object from (key, SQL text of the value)."""
    parts = []
    for place, (key, value) in enumerate(members):
        parts += [f"""'{", " if place else ""}"{key}": '""", value]
    return f"CONCAT('{{', {', '.join(parts)}, '}}')"


def quoted(expression: str) -> str:
    return f"""CONCAT('"', {expression}, '"')"""


# ---------------------------------------------------------------------------------------------------------------------
# Invoices as tables: lines from lineitem, headers from orders


def _invoice_lines_raw(table: str = "lineitem", carry: str = "") -> str:
    return f"""
SELECT doc_id, {carry}l_linenumber, l_partkey, l_suppkey, ext, description, quantity, unit_price, discount_percent,
       discount_amount, tax_rate, l_discount, l_shipdate, l_returnflag, l_linestatus,
       CASE WHEN l_partkey % 211 = 0 THEN NULL
            WHEN discount_percent IS NOT NULL THEN FLOOR(ext * (100 - discount_percent) + 0.5) / 100
            WHEN discount_amount IS NOT NULL THEN {cents('ext - discount_amount')} ELSE ext END AS total_price
FROM (SELECT l_orderkey AS doc_id, {carry}l_linenumber, l_partkey, l_suppkey, l_extendedprice AS ext, l_discount, l_shipdate,
             l_returnflag, l_linestatus, CONCAT('part ', CAST(l_partkey AS STRING)) AS description,
             CASE WHEN l_partkey % 97 = 0 THEN NULL ELSE l_quantity END AS quantity,
             {cents('l_extendedprice / l_quantity')} AS unit_price,
             CASE WHEN l_linenumber % 3 = 0 THEN CAST(FLOOR(l_discount * 100 + 0.5) AS DOUBLE) ELSE NULL END AS discount_percent,
             CASE WHEN l_linenumber % 5 = 4 THEN 5.0E0 ELSE NULL END AS discount_amount, l_tax AS tax_rate
      FROM {table}) t
"""


INVOICE_LINES_RAW = _invoice_lines_raw()
LINE_ORDER = [
    "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus",
]

INVOICE_SUMS = f"""
SELECT doc_id, SUM(CAST(total_price AS DECIMAL(20,4))) AS line_sum,
       SUM(CAST({cents('total_price * tax_rate')} AS DECIMAL(20,4))) AS line_tax
FROM fx_invoice_lines_raw GROUP BY doc_id
"""

INVOICE_HEADERS = f"""
SELECT doc_id,
       CAST(CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 19 = 1 THEN line_sum - tax
                 WHEN doc_id % 5 = 0 THEN line_sum + 1 ELSE line_sum END AS DOUBLE) AS subtotal,
       CAST(CASE WHEN doc_id % 31 = 2 THEN NULL ELSE tax END AS DOUBLE) AS tax_amount,
       CASE WHEN doc_id % 3 = 0 THEN 0.05E0 WHEN doc_id % 13 = 0 THEN 0.0E0 ELSE NULL END AS tax_rate,
       CASE WHEN doc_id % 23 = 0 THEN 10.0E0 ELSE NULL END AS discount_amount,
       CASE WHEN doc_id % 4 = 0 THEN 25.0E0 ELSE NULL END AS shipping_amount,
       CASE WHEN doc_id % 29 = 0 THEN 0.4E0 ELSE NULL END AS round_off_amount,
       CAST(CASE WHEN doc_id % 11 = 0 THEN NULL
                 WHEN doc_id % 19 = 1 THEN line_sum + CASE WHEN doc_id % 4 = 0 THEN 25 ELSE 0 END
                 ELSE line_sum + tax + CASE WHEN doc_id % 4 = 0 THEN 25 ELSE 0 END
                      + CASE WHEN doc_id % 29 = 0 THEN CAST(0.4 AS DECIMAL(20,4)) ELSE 0 END END AS DOUBLE) AS total_amount,
       CASE WHEN doc_id % 17 = 0 THEN ' Tax_Inclusive ' WHEN doc_id % 17 = 1 THEN 'net' ELSE NULL END AS pricing_type
FROM (SELECT o_orderkey AS doc_id, line_sum,
             CASE WHEN o_orderkey % 3 = 0
                  THEN CAST({cents('CAST(line_sum AS DOUBLE) * 0.05E0')} AS DECIMAL(20,4)) ELSE line_tax END AS tax
      FROM orders LEFT JOIN fx_invoice_sums ON doc_id = o_orderkey) t
"""


def _invoice_extra(engine: str) -> str:
    number = lambda e: f"CAST({e} AS STRING)"
    half = f"CAST({cents('tax_amount / 2')} AS DECIMAL(20,2))"
    return fan_out(
        engine,
        "fx_invoice_headers",
        ["source", "pos", "key", "text", "is_text"],
        [
            ["1", "0", "'cgst_amount'", number(half), "FALSE", "doc_id % 6 = 1"],
            ["1", "1", "'SGST Amount'", number(half), "TRUE", "doc_id % 6 = 1"],
            ["1", "2", "'igst_rate'", "'5%'", "TRUE", "doc_id % 6 = 3"],
            ["1", "3", "'igst-amount'", number("CAST(tax_amount AS DECIMAL(20,2))"), "TRUE", "doc_id % 12 = 3"],
            ["1", "4", "'cess'", "'1%'", "TRUE", "doc_id % 18 = 5"],
            ["1", "5", "'vat'", number("CAST(tax_amount AS DECIMAL(20,2))"), "FALSE", "doc_id % 9 = 4"],
            ["1", "6", "'Round-Off'", "'(0.40)'", "TRUE", "doc_id % 10 = 3"],
            ["1", "7", "'rounding'", "'0.25'", "TRUE", "doc_id % 15 = 3"],
            ["1", "8", "'terms'", "'All Taxes Included'", "TRUE", "doc_id % 37 = 3"],
            ["0", "9", "'Round Off'", "'n/a'", "TRUE", "doc_id % 20 = 3"],
        ],
    )


# ---------------------------------------------------------------------------------------------------------------------
# Statements as tables: one document per order

BALANCE_HEADERS = f"""
SELECT doc_id,
       CASE WHEN doc_id % 8 = 1 THEN NULL ELSE ca END AS current_assets,
       CASE WHEN doc_id % 8 = 1 OR doc_id % 9 = 1 THEN NULL ELSE nca END AS non_current_assets,
       CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 5 = 0 THEN a + 10 ELSE a END AS total_assets,
       CASE WHEN doc_id % 6 = 5 THEN NULL ELSE cl END AS current_liabilities,
       CASE WHEN doc_id % 4 = 0 THEN NULL ELSE ncl END AS non_current_liabilities,
       CASE WHEN doc_id % 3 = 0 THEN NULL ELSE {cents('cl + ncl')} END AS total_liabilities,
       CASE WHEN doc_id % 3 = 0 THEN NULL ELSE {cents('a - cl - ncl')} END AS total_equity,
       CASE WHEN doc_id % 10 = 7 THEN NULL ELSE {cents('(a - cl - ncl) * 0.25')} END AS retained_earnings,
       CASE WHEN doc_id % 2 = 0 THEN 0.0E0 ELSE {cents('(a - cl - ncl) * 0.75')} END AS share_capital,
       CASE WHEN doc_id % 12 = 8 THEN NULL ELSE {cents('(a - cl - ncl) * 0.75')} END AS capital,
       CASE WHEN doc_id % 7 = 0 THEN 0.0E0 WHEN doc_id % 7 = 3 THEN NULL ELSE a END AS total_liabilities_and_equity,
       CASE WHEN doc_id % 14 = 0 THEN NULL WHEN doc_id % 14 = 3 THEN NULL ELSE a END AS total_capital_and_liabilities
FROM (SELECT o_orderkey AS doc_id, o_totalprice AS a, {cents('o_totalprice * 0.4')} AS ca,
             {cents('o_totalprice - ' + cents('o_totalprice * 0.4'))} AS nca,
             {cents('o_totalprice * 0.2')} AS cl, {cents('o_totalprice * 0.3')} AS ncl FROM orders) t
"""


def _balance_lines(engine: str) -> str:
    a = "o_totalprice"
    rest = cents(f"{a} - {cents(a + ' * 0.3')} - {cents(a + ' * 0.2')}")
    return fan_out(
        engine,
        "(SELECT o_orderkey AS doc_id, o_totalprice FROM orders WHERE o_orderkey % 3 <> 1) b",
        ["line_no", "item_name", "category", "amount"],
        [
            ["1", "'Cash and balances with central bank'", "'Assets'", cents(f"{a} * 0.3"), "TRUE"],
            ["2", "'Loans and advances'", "CAST(NULL AS STRING)", cents(f"{a} * 0.2"), "doc_id % 5 <> 2"],
            ["3", "' Premises '", "'fixed assets'", rest, "doc_id % 5 <> 2"],
            ["4", "'Share Capital'", "'Capital & Liabilities'", cents(f"{a} * 0.3"), "doc_id % 6 <> 2"],
            ["5", "'Deposits and cash margins'", "CAST(NULL AS STRING)", cents(f"{a} * 0.2"), "doc_id % 8 <> 3"],
            ["6", "'Borrowings'", "''", rest, "doc_id % 6 <> 2"],
            ["7", "'TOTAL'", "'assets'", a, "TRUE"],
            ["8", "'Contingent liabilities'", "''", cents(f"{a} * 0.5"), "doc_id % 2 = 0"],
            ["9", "'Miscellaneous'", "''", "7.0E0", "doc_id % 4 = 0"],
            ["10", "'Goodwill'", "''", "CAST(NULL AS DOUBLE)", "doc_id % 4 = 2"],
        ],
    )


PNL_HEADERS = f"""
SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 0.0E0 WHEN doc_id % 4 = 2 THEN NULL ELSE r END AS total_revenue,
       cogs AS cost_of_goods_sold,
       {cents('r - cogs + CASE WHEN doc_id % 6 = 1 THEN 5 ELSE 0 END')} AS gross_profit,
       CASE WHEN doc_id % 7 = 0 THEN NULL ELSE opex END AS operating_expenses,
       {cents('r - cogs - opex')} AS operating_income,
       CASE WHEN doc_id % 5 = 0 THEN 0.0E0 ELSE i END AS interest_expense,
       CASE WHEN doc_id % 9 = 2 THEN NULL ELSE 12.5E0 END AS tax_expense,
       {cents('r - cogs - opex - CASE WHEN doc_id % 5 = 0 THEN 0 ELSE i END - 12.5')} AS net_income,
       CASE WHEN doc_id % 13 = 0 THEN {cents('opex + i + 3')} ELSE NULL END AS total_expenditure
FROM (SELECT o_orderkey AS doc_id, o_totalprice AS r, {cents('o_totalprice * 0.5')} AS cogs,
             {cents('o_totalprice * 0.2')} AS opex, {cents('o_totalprice * 0.05')} AS i FROM orders) t
"""


def _pnl_lines(engine: str) -> str:
    r, i, opex = "o_totalprice", cents("o_totalprice * 0.05"), cents("o_totalprice * 0.2")
    profit = cents(f"{r} - {i} - {opex} - 3")
    none = "CAST(NULL AS STRING)"
    return fan_out(
        engine,
        "(SELECT o_orderkey AS doc_id, o_totalprice FROM orders WHERE o_orderkey % 2 = 0) b",
        ["line_no", "item_name", "category", "amount"],
        [
            ["1", "'Interest Earned'", "'Other'", "1.0E0", "doc_id % 10 = 0"],
            ["2", "'Interest earned on advances'", "'I. INCOME'", cents(f"{r} * 0.75"), "TRUE"],
            ["3", "'Other Income'", "'Income'", cents(f"{r} - {cents(r + ' * 0.75')}"), "doc_id % 8 <> 4"],
            ["4", "'Total Income'", "'Income'", r, "doc_id % 12 <> 2"],
            ["5", "'Interest Expended'", "'Expenditure'", i, "TRUE"],
            ["6", "'Operating Expenses'", none, opex, "TRUE"],
            ["7", "'Provisions & Contingencies'", "'Expenditure'", "3.0E0", "doc_id % 14 <> 6"],
            ["8", "'Total'", "'Expenditure'", cents(f"{i} + {opex} + 3"), "doc_id % 3 <> 1"],
            ["9", "'Net Profit for the year before Minority Interest'", "'Profit'", profit, "TRUE"],
            ["10", "'Less : Minority Interest'", "'Profit'", "2.0E0", "doc_id % 16 <> 8"],
            ["11", "'Brought forward consolidated profit attributable to the group'", "'Profit'", "50.0E0", "TRUE"],
            ["12", "'Consolidated Profit for the year'", "'Profit'", cents(f"{profit} - 2"), "doc_id % 6 <> 4"],
            ["13", "'Addition on Amalgamation'", none, "4.0E0", "doc_id % 18 = 0"],
            ["14", "'Total'", "'Appropriations'", cents(f"{profit} + 48 + CASE WHEN doc_id % 18 = 0 THEN 4 ELSE 0 END"), "TRUE"],
        ],
    )


def _pnl_extra(engine: str) -> str:
    r = "o_totalprice"
    text = lambda e: f"CAST(CAST({e} AS DECIMAL(20,2)) AS STRING)"
    return fan_out(
        engine,
        "(SELECT o_orderkey AS doc_id, o_totalprice FROM orders WHERE o_orderkey % 4 = 1 OR o_orderkey % 10 = 0) b",
        ["source", "pos", "key", "text", "is_text"],
        [
            ["1", "0", "'Interest Earned'", text(cents(f"{r} * 0.6")), "FALSE", "TRUE"],
            ["1", "1", "'interest-earned'", text(cents(f"{r} * 0.75")), "TRUE", "doc_id % 3 = 0"],
            ["1", "2", "'interest_income'", "'nil'", "TRUE", "doc_id % 5 = 0"],
            ["1", "3", "'other_income'", "'0'", "TRUE", "doc_id % 8 = 1"],
            ["1", "4", "'non_interest_income'", text(cents(f"{r} * 0.25")), "FALSE", "doc_id % 3 = 0"],
            ["1", "5", "'provisions'", "'3.00'", "TRUE", "TRUE"],
            ["1", "6", "'total_expenditure'", text(cents(f"{r} * 0.2") + " + " + cents(f"{r} * 0.05") + " + 3"), "FALSE", "doc_id % 2 = 1"],
            ["1", "7", "'Net-Profit'", text(f"{r} - 3"), "FALSE", "doc_id % 6 = 1"],
            ["1", "8", "'minority_interest'", "'(2.00)'", "TRUE", "doc_id % 9 = 1"],
            ["1", "9", "'brought_forward'", "'50 CR'", "TRUE", "doc_id % 7 = 1"],
            ["1", "10", "'total_appropriations'", text(f"{r} + 10"), "FALSE", "TRUE"],
        ],
    )


CASH_HEADERS = """
SELECT doc_id,
       CASE doc_id % 4 WHEN 0 THEN CONCAT('$', s) WHEN 1 THEN CONCAT('(', s, ')') WHEN 2 THEN CONCAT(s, ' CR') ELSE s END
         AS net_cash_from_operating_activities,
       CASE WHEN doc_id % 9 = 0 THEN 'N/A' ELSE '-12.50' END AS net_cash_from_investing_activities,
       '1,000.25' AS net_cash_from_financing_activities,
       CASE WHEN doc_id % 7 = 0 THEN NULL
            ELSE CAST(CASE WHEN doc_id % 4 IN (1, 2) THEN -p ELSE p END + CAST(987.75 AS DECIMAL(20,2))
                      + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS STRING) END AS net_change_in_cash,
       CASE WHEN doc_id % 10 = 3 THEN ' -- ' ELSE '2,500' END AS beginning_cash_balance,
       CAST(CASE WHEN doc_id % 4 IN (1, 2) THEN -p ELSE p END + CAST(3487.75 AS DECIMAL(20,2)) AS STRING) AS ending_cash_balance,
       CASE WHEN doc_id % 15 = 0 THEN '1.00' WHEN doc_id % 15 = 1 THEN '0' ELSE NULL END AS effect_of_exchange_rate_changes
FROM (SELECT o_orderkey AS doc_id, CAST(o_totalprice AS DECIMAL(20,2)) AS p, CAST(CAST(o_totalprice AS DECIMAL(20,2)) AS STRING) AS s
      FROM orders) t
"""


def _cash_lines(engine: str) -> str:
    return fan_out(
        engine,
        "(SELECT o_orderkey AS doc_id FROM orders WHERE o_orderkey % 5 = 0) b",
        ["line_no", "item_name", "category", "amount"],
        [
            ["1", "'Opening balance'", "''", "2.0E0", "TRUE"],
            ["2", "'Effect of Exchange Fluctuation on translation reserve'", "''", "0.0E0", "doc_id % 3 = 1"],
            ["3", "'Exchange fluctuation'", "''", "1.0E0", "doc_id % 2 = 0"],
        ],
    )


# ---------------------------------------------------------------------------------------------------------------------
# Raw model responses: one per order, four document types

_RESPONSE_AMOUNTS = f"""
SELECT o_orderkey AS doc_id, CAST(FLOOR(o_orderkey / 4) AS BIGINT) AS j, o_totalprice AS t,
       {cents('o_totalprice * 0.4')} AS a, {cents('o_totalprice - ' + cents('o_totalprice * 0.4'))} AS b,
       {cents('o_totalprice * 0.05')} AS x,
       CASE o_orderkey % 4 WHEN 0 THEN 'invoice' WHEN 1 THEN 'balance_sheet' WHEN 2 THEN 'profit_and_loss'
                           ELSE 'cash_flow_statement' END AS document_type
FROM orders
"""

# Amounts a response may print, as text; each is worked out once.
_PRINTED = {
    "s_t": "t",
    "s_a": "a",
    "s_b": "b",
    "s_x": "x",
    "s_tx": "t + x + CASE WHEN j % 6 = 2 THEN 0.4 ELSE 0 END",
    "s_ha": cents("a / 2"),
    "s_hb": cents("b / 2"),
    "s_gb": cents("b * 1.05"),
    "s_hx": cents("x / 2"),
    "s_rx": "x - " + cents("x / 2"),
    "s_t1": "CASE WHEN j % 4 = 1 THEN t + 1 ELSE t END",
    "s_b2": "CASE WHEN j % 3 = 0 THEN b + 2 ELSE b END",
    "s_bx": "b - x",
    "s_na": "-a",
    "s_nc": "b + x",
    "s_ec": "CASE WHEN j % 6 = 0 THEN b + x ELSE b + x + 100 END",
}
_RESPONSE_BASE = f"""
SELECT doc_id, document_type, j, {", ".join(f"{money(e)} AS {n}" for n, e in _PRINTED.items())} FROM fx_response_amounts
"""

_INVOICE_JSON = json_object(
    [
        ("invoice_number", quoted("CONCAT('INV-', CAST(doc_id AS STRING))")),
        ("vendor_name", quoted("'Acme Ltd'")),
        ("subtotal", f"CASE WHEN j % 5 = 1 THEN {quoted('CONCAT(CHR(36), s_t)')} ELSE s_t END"),
        ("tax_amount", "s_x"),
        ("tax_rate", "CASE WHEN j % 3 = 0 THEN '0.05' ELSE 'null' END"),
        ("round_off", "CASE WHEN j % 6 = 2 THEN '0.40' ELSE 'null' END"),
        ("total_amount", "s_tx"),
        ("unknown_key", "'17'"),
        (
            "tax_components",
            "CASE WHEN j % 12 = 7 THEN CONCAT('[', "
            + json_object([("name", quoted("'IGST'")), ("rate", quoted("'5%'")), ("amount", "s_x")])
            + ", ']') ELSE '[]' END",
        ),
        (
            "line_items",
            "CONCAT('[', "
            + json_object(
                [
                    ("description", quoted("'first item'")),
                    ("quantity", "'2'"),
                    ("unit_price", "s_ha"),
                    ("total_price", "s_a"),
                ]
            )
            + ", ', ', "
            + json_object(
                [
                    ("description", "'null'"),
                    ("quantity", "CASE WHEN j % 8 = 3 THEN 'null' ELSE '4' END"),
                    ("unit_price", "s_hb"),
                    ("discount_pct", "'50'"),
                    ("total_price", "CASE WHEN j % 16 = 5 THEN 'null' ELSE s_b END"),
                    ("gross_worth", "s_gb"),
                    ("page_number", "'1'"),
                ]
            )
            + ", ']')",
        ),
        (
            "additional_fields",
            json_object(
                [
                    ("Place of Supply", quoted("'Pune'")),
                    ("CGST-Amount", quoted("s_hx")),
                    ("sgst_amount", "s_rx"),
                ]
            ),
        ),
    ]
)
_BALANCE_JSON = json_object(
    [
        ("company_name", quoted("CONCAT('Company ', CAST(doc_id AS STRING))")),
        ("current_assets", "s_a"),
        ("non_current_assets", f"CASE WHEN j % 7 = 3 THEN {quoted('CONCAT(s_b, CHR(32), CHR(67), CHR(82))')} ELSE s_b END"),
        ("total_assets", "s_t"),
        ("total_capital_and_liabilities", "s_t1"),
        ("capital", "s_a"),
        (
            "line_items",
            "CONCAT('[', "
            + json_object([("item_name", quoted("'Share capital'")), ("amount", "s_a"), ("category", "'null'")])
            + ", ', ', "
            + json_object([("item_name", quoted("'Deposits'")), ("amount", "s_b"), ("category", quoted("'liabilities'"))])
            + ", ']')",
        ),
        ("additional_fields", "CASE WHEN j % 9 = 2 THEN 'null' ELSE '{}' END"),
    ]
)
_PNL_JSON = json_object(
    [
        ("company_name", quoted("CONCAT('Company ', CAST(doc_id AS STRING))")),
        ("statement_type", "CASE WHEN j % 10 = 4 THEN '\"Cash_Flow_Statement\"' ELSE 'null' END"),
        ("total_revenue", "s_t"),
        ("cost_of_goods_sold", "s_a"),
        ("gross_profit", "s_b2"),
        ("operating_expenses", f"CASE WHEN j % 7 = 3 THEN 'true' WHEN j % 7 = 4 THEN '[1]' ELSE s_x END"),
        ("operating_income", "s_bx"),
        ("additional_fields", json_object([("Interest Earned", "s_b"), ("other-income", quoted("s_a"))])),
    ]
)
_CASH_JSON = json_object(
    [
        ("reporting_period", quoted("'FY24'")),
        ("net_cash_from_operating_activities", "s_t"),
        ("net_cash_from_investing_activities", "s_na"),
        ("net_cash_from_financing_activities", f"CASE WHEN j % 5 = 2 THEN {quoted('s_x')} ELSE s_x END"),
        ("net_change_in_cash", "s_nc"),
        ("beginning_cash_balance", "'100'"),
        ("ending_cash_balance", "s_ec"),
        (
            "line_items",
            "CASE WHEN j % 8 = 1 THEN '[{\"amount\": 5}]' ELSE '[{\"item_name\": \"Opening\", \"amount\": 100}]' END",
        ),
    ]
)
_EVIDENCE_JSON = json_object(
    [
        ("total", json_object([("source_snippet", quoted("CONCAT('Total ', s_t)")), ("page_number", "'1'")])),
        ("tax", "CASE WHEN j % 2 = 0 THEN '\"page 1\"' ELSE '{\"source_snippet\": null, \"page_number\": 2}' END"),
    ]
)

RESPONSES = f"""
SELECT doc_id, document_type,
       CASE WHEN j % 11 = 3 THEN SUBSTRING(body, 1, 60) WHEN j % 13 = 4 THEN CONCAT('[', body, ']') WHEN j % 17 = 5 THEN '  '
            WHEN j % 7 = 2 THEN CONCAT('```json', CHR(10), body, CHR(10), '```') ELSE body END AS raw
FROM (SELECT doc_id, document_type, j,
             CASE WHEN j % 6 = 5 THEN data ELSE CONCAT('{{"extracted_data": ', data, ', "evidence": ', evidence, '}}') END AS body
      FROM (SELECT doc_id, document_type, j, {_EVIDENCE_JSON} AS evidence,
                   CASE document_type WHEN 'invoice' THEN {_INVOICE_JSON} WHEN 'balance_sheet' THEN {_BALANCE_JSON}
                                      WHEN 'profit_and_loss' THEN {_PNL_JSON} ELSE {_CASH_JSON} END AS data
            FROM fx_response_base) d) e
"""

# ---------------------------------------------------------------------------------------------------------------------
# Text, pages, files, attempts and stored documents

TEXT = """
SELECT doc_id,
       CONCAT(CASE doc_id % 8 WHEN 0 THEN 'Consolidated Balance Sheet' WHEN 1 THEN 'Statement of Profit and Loss'
                              WHEN 2 THEN 'Cash Flow Statement' WHEN 3 THEN 'Tax Invoice  GSTIN'
                              WHEN 4 THEN 'Tax Invoice  Balance Sheet' WHEN 5 THEN '' ELSE 'Memo' END, CHR(10), text) AS text,
       CASE WHEN doc_id % 2 = 0 THEN 'invoice' ELSE 'balance_sheet' END AS requested_type
FROM documents
"""


def _pages(engine: str) -> str:
    half = "CAST(FLOOR(LENGTH(text) / 2) AS INT)"
    return fan_out(
        engine,
        "(SELECT doc_id, text FROM fx_text) b",
        ["page_number", "text", "n_images", "rendered", "ocr_error"],
        [
            ["2", f"SUBSTRING(text, {half} + 1)", "0", "FALSE", "CAST(NULL AS STRING)", "doc_id % 9 <> 0"],
            ["1", f"CASE WHEN doc_id % 9 = 0 THEN CHR(9) ELSE SUBSTRING(text, 1, {half}) END", "1", "FALSE",
             "CASE WHEN doc_id % 27 = 0 THEN 'unreadable' ELSE NULL END", "TRUE"],
            ["3", "CASE WHEN doc_id % 5 = 0 THEN CONCAT(CHR(10), ' ') ELSE NULL END", "0", "doc_id % 2 = 0",
             "CASE WHEN doc_id % 15 = 0 THEN 'unreadable' ELSE NULL END", "doc_id % 3 = 0"],
        ],
    )


FILES = """
SELECT doc_id, CONCAT('in/', CAST(doc_id % 10 AS STRING), '/', name) AS path, name,
       CASE kind WHEN 0 THEN '' WHEN 1 THEN HEX(CONCAT('%PDF-1.4', CHR(10), body, CHR(10), '%%EOF'))
                 WHEN 2 THEN CONCAT('89504E470D0A1A0A0000000D49484452', HEX(text), CASE WHEN doc_id % 3 = 0 THEN '' ELSE '49454E44' END)
                 WHEN 3 THEN CONCAT('FFD8', HEX(text), CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'FFD9' END)
                 ELSE HEX(text) END AS hex_content
FROM (SELECT doc_id, text, CASE WHEN doc_id % 41 = 0 THEN 0 WHEN doc_id % 4 = 0 THEN 1 WHEN doc_id % 4 = 1 THEN 2
                                WHEN doc_id % 4 = 2 THEN 3 ELSE 4 END AS kind,
             CONCAT('document ', CAST(doc_id AS STRING),
                    CASE doc_id % 7 WHEN 0 THEN '' WHEN 1 THEN '.PDF' WHEN 2 THEN '.png' WHEN 3 THEN '.JPEG' WHEN 4 THEN '.jpg'
                                    WHEN 5 THEN '.txt' ELSE '.pdf' END) AS name,
             CONCAT(text, CASE WHEN doc_id % 12 = 4 THEN '' WHEN doc_id % 8 = 0
                    THEN CONCAT('<< /Type /Pages /Kids [] /Count ', CAST(doc_id % 6 AS STRING), ' >>')
                    ELSE '<< /Type /Page >> << /Type/Page /Parent 1 >>' END) AS body
      FROM documents) t
"""


def _attempts(engine: str) -> str:
    errors = (
        "CASE CAST(FLOOR(request_id / 16) AS BIGINT) % 9 WHEN 0 THEN 'Model X is NOT FOUND' WHEN 1 THEN 'Quota exceeded for today' "
        "WHEN 2 THEN 'Please Retry in 12.5s' WHEN 3 THEN '503 Service Unavailable, retry in 4s' WHEN 4 THEN 'deadline exceeded' "
        "WHEN 5 THEN 'permission denied' WHEN 6 THEN 'retry in 30s: Server Error' WHEN 7 THEN '429 too many' ELSE 'boom' END"
    )
    code = "CASE WHEN request_id % 13 = 0 THEN 503 WHEN request_id % 17 = 0 THEN 404 ELSE NULL END"
    none, no_code = "CAST(NULL AS STRING)", "CAST(NULL AS INT)"
    rows = []
    for place, model in enumerate(["alpha", "beta", "gamma-lite"]):
        for attempt in (1, 2):
            fails = f"request_id % 4 > {place}" if attempt == 1 else f"request_id % 3 <> {place}"
            rows.append([f"'{model}'", str(attempt), f"CASE WHEN {fails} THEN {errors} ELSE {none} END",
                         f"CASE WHEN {fails} THEN {code} ELSE {no_code} END", f"NOT ({fails})",
                         "TRUE" if attempt == 1 else "request_id % 5 = 0"])
    return fan_out(
        engine,
        "(SELECT event_id AS request_id FROM events) b",
        ["model", "attempt", "error", "code", "ok"],
        rows,
        carry="request_id",
    )


STORED = """
SELECT o_orderkey AS id, CONCAT('statement-', CAST(o_custkey AS STRING), '.pdf') AS document_name,
       CASE o_orderkey % 4 WHEN 0 THEN 'invoice' WHEN 1 THEN 'balance_sheet' WHEN 2 THEN 'profit_and_loss'
                           ELSE 'cash_flow_statement' END AS document_type,
       CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'VALIDATION_FAILED' ELSE 'EXTRACTION_FAILED' END AS processing_status,
       o_orderdate AS created_at
FROM orders
"""

DIRTY = """
SELECT o_orderkey AS doc_id,
       CASE o_orderkey % 20
            WHEN 0 THEN CONCAT('$', s) WHEN 1 THEN CONCAT('(', s, ')') WHEN 2 THEN CONCAT(s, ' CR') WHEN 3 THEN CONCAT(s, '-')
            WHEN 4 THEN CONCAT(' ( $', s, ' ) ') WHEN 5 THEN CONCAT('USD ', s) WHEN 6 THEN '8%' WHEN 7 THEN CONCAT(s, '%')
            WHEN 8 THEN 'N/A' WHEN 9 THEN '1,234,567.50' WHEN 10 THEN '12,5' WHEN 11 THEN '1.234,56' WHEN 12 THEN '1e5'
            WHEN 13 THEN CONCAT('+', s) WHEN 14 THEN CONCAT(CHR(9), s, CHR(10)) WHEN 15 THEN '1.5 million' WHEN 16 THEN '--'
            WHEN 17 THEN CONCAT('1,2,', s) WHEN 18 THEN '(5%)' ELSE s END AS printed
FROM (SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(20,2)) AS STRING) AS s FROM orders) t
"""


def definitions(engine: str) -> dict[str, str]:
    """Every view in dependency order."""
    return {
        "fx_invoice_lines_raw": INVOICE_LINES_RAW,
        "fx_invoice_sums": INVOICE_SUMS,
        "fx_invoice_headers": INVOICE_HEADERS,
        "fx_invoice_extra": _invoice_extra(engine),
        "fx_balance_headers": BALANCE_HEADERS,
        "fx_balance_lines": _balance_lines(engine),
        "fx_pnl_headers": PNL_HEADERS,
        "fx_pnl_lines": _pnl_lines(engine),
        "fx_pnl_extra": _pnl_extra(engine),
        "fx_cash_headers": CASH_HEADERS,
        "fx_cash_lines": _cash_lines(engine),
        "fx_response_amounts": _RESPONSE_AMOUNTS,
        "fx_response_base": _RESPONSE_BASE,
        "fx_responses": RESPONSES,
        "fx_text": TEXT,
        "fx_pages": _pages(engine),
        "fx_files": FILES,
        "fx_attempts": _attempts(engine),
        "fx_stored": STORED,
        "fx_dirty": DIRTY,
    }


def with_clause(engine: str, *wanted: str) -> str:
    """The definitions a query needs, as comma-separated common table expressions."""
    known = definitions(engine)
    needed: set[str] = set()

    def visit(name: str) -> None:
        if name not in needed:
            needed.add(name)
            for other in re.findall(r"\bfx_\w+", known[name]):
                visit(other)

    for name in wanted:
        visit(name)
    return ",\n".join(f"{name} AS ({sql})" for name, sql in known.items() if name in needed)


def load_tables(spark: SparkSession, sf_dir: str, *names: str, spread: bool = False, keyed: bool = False) -> None:
    """Register tables for the views; a plan keeps the files it was made with. ``spread`` and ``keyed`` deal a table's rows out by its key."""
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions")) if keyed else 4 * spark.sparkContext.defaultParallelism
    for name in names or TABLES:
        df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        (df.repartition(tasks, df.columns[0]) if spread or keyed else df).createOrReplaceTempView(name)


def fixture(spark: SparkSession, sf_dir: str, name: str, spread: bool = False, keyed: bool = False) -> DataFrame:
    """A view over the tables. ``spread`` is for costly work on narrow rows: a file of one row group is else one task.

    ``keyed`` is for views of several rows or many columns that are joined by the key of a table: the narrow rows of the table
    are dealt out by it, as many partitions as the session shuffles to, instead of the wide ones of the view.
    """
    clause = with_clause("spark", name)
    load_tables(spark, sf_dir, *[t for t in TABLES if re.search(rf"\b(?:FROM|JOIN) {t}\b", clause)], spread=spread, keyed=keyed)
    return spark.sql(f"WITH {clause} SELECT * FROM {name}")


def invoice_lines(spark: SparkSession, sf_dir: str, numbered: bool = True) -> DataFrame:
    """Invoice lines; numbering costs an exchange, of the table's own columns, and is left out where no rule name needs it."""
    columns = ["doc_id", "line_no", "description", "quantity", "unit_price", "discount_percent", "discount_amount", "total_price", "tax_rate"]
    if not numbered:
        return fixture(spark, sf_dir, "fx_invoice_lines_raw").withColumn("line_no", F.col("l_linenumber")).select(*columns)
    bucket = [F.col("l_linenumber"), F.floor(F.col("l_partkey") / 65536)]
    lines = number_lines(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), [F.col(c) for c in LINE_ORDER], bucket, "l_orderkey")
    lines.createOrReplaceTempView("numbered_lineitem")
    return spark.sql(_invoice_lines_raw("numbered_lineitem", "line_no, ")).select(*columns)
