"""SQL for each registered query, for the checking database. Written from the rules' definitions, not from the jobs."""

from __future__ import annotations

from ledgerline.plans.fixtures import with_clause

ORACLE: dict = {}


def sql(name: str, *views: str):
    """Register a SQL text under a query's name; the views it reads are put in front."""

    def register(text: str, ctes: str = "") -> None:
        clause = ",\n".join(part for part in [with_clause("duckdb", *views) if views else "", ctes] if part)
        ORACLE[name] = (f"WITH {clause}\n" if clause else "") + text

    return register


def r(expression: str, digits: int = 4) -> str:
    return f"(round_even(({expression}) * 1e{digits}, 0)::DOUBLE / 1e{digits})"


def miss(**inputs: str) -> str:
    return "concat_ws(', ', " + ", ".join(f"CASE WHEN ({e}) IS NULL THEN '{n}' END" for n, e in inputs.items()) + ")"


def judged(body: str) -> str:
    """Final check columns from (doc_id, rule_name, formula, calc, reported, var, missing, na)."""
    return f"""
SELECT doc_id, rule_name, formula, CASE WHEN ok THEN calc END AS calculated_value, reported AS reported_value,
       CASE WHEN ok THEN v END AS variance,
       CASE WHEN NOT ok THEN 'NOT_APPLICABLE' WHEN abs(v) <= 0.01 THEN 'PASS' ELSE 'FAILED' END AS status, missing
FROM (SELECT *, (missing = '' AND NOT na) AS ok, COALESCE(var, {r('calc - reported')}) + 0.0 AS v FROM ({body}) q0) q1"""


STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"


def strip(expression: str) -> str:
    return STRIP.format(expression)


def with_amount(source: str, text: str = "text", out: str = "num", plain: str = "FALSE") -> str:
    """All columns of a source and the amount its text stands for; where ``plain`` holds the text is a JSON number."""
    return f"""
SELECT * EXCLUDE (s0, s1, s2, s3, s4, c0, c1, neg, pct, m0, m1, v0), CASE WHEN {plain} THEN TRY_CAST({text} AS DOUBLE)
       WHEN s0 IS NULL OR lower(s0) IN ('', 'null', 'none', 'n/a', 'na', '-', '--', 'nil') OR c0 = '' THEN NULL
       ELSE {r('CASE WHEN neg THEN -abs(v0) ELSE v0 END', 6)} END AS {out}
FROM (SELECT *, {strip(text)} AS s0, (starts_with(s0, '(') AND ends_with(s0, ')')) AS m0,
             CASE WHEN m0 THEN {strip('s0[2:-2]')} ELSE s0 END AS s1,
             (ends_with(s1, '-') OR ends_with(upper(s1), 'CR')) AS m1,
             CASE WHEN ends_with(s1, '-') THEN {strip('s1[:-2]')} WHEN m1 THEN {strip('s1[:-3]')} ELSE s1 END AS s2,
             (m0 OR m1 OR starts_with(s2, '-')) AS neg,
             CASE WHEN s2[1] IN ('-', '+') THEN {strip('s2[2:]')} ELSE s2 END AS s3,
             ends_with(s3, '%') AS pct, CASE WHEN pct THEN {strip('s3[:-2]')} ELSE s3 END AS s4,
             regexp_replace(s4, '[A-Za-z$€£¥₹\\s]', '', 'g') AS c0,
             CASE WHEN contains(c0, ',') AND NOT contains(c0, '.') AND regexp_full_match(c0, '\\d+,\\d{{1,2}}') THEN replace(c0, ',', '.')
                  ELSE replace(c0, ',', '') END AS c1,
             TRY_CAST(c1 AS DOUBLE) / CASE WHEN pct THEN 100 ELSE 1 END AS v0
      FROM {source}) amounts"""


def with_rate(source: str, text: str = "text", out: str = "rate", plain: str = "FALSE") -> str:
    return f"""
SELECT * EXCLUDE (rate_num), CASE WHEN NOT ({plain}) AND contains({text}, '%') THEN rate_num
       WHEN rate_num BETWEEN 0 AND 1 THEN {r('rate_num', 6)}
       WHEN rate_num > 1 AND rate_num <= 100 THEN {r('rate_num / 100', 6)} END AS {out}
FROM ({with_amount(source, text, 'rate_num', plain)}) rates"""


# --- invoices --------------------------------------------------------------------------------------------------------

LINES = """
lines AS (SELECT * EXCLUDE (l_linenumber, l_partkey, l_suppkey, ext, l_discount, l_shipdate, l_returnflag, l_linestatus),
                 CAST(ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY l_linenumber, l_partkey, l_suppkey, ext, l_discount, tax_rate,
                      l_shipdate, l_returnflag, l_linestatus) AS INTEGER) AS line_no
          FROM fx_invoice_lines_raw)"""

# The kind of discount a line states in its own fields.
STATED = """CASE WHEN discount_percent IS NOT NULL THEN CASE WHEN discount_percent BETWEEN 0 AND 100 THEN 'PERCENT' END
                 WHEN discount_amount IS NOT NULL THEN CASE WHEN discount_amount >= 0 THEN 'AMOUNT' END END"""

SUMS = f"""
sums AS (SELECT doc_id, count(*) AS n_lines, count(total_price) AS n_totals, bool_or({STATED} IS NOT NULL) AS any_discount,
                CASE WHEN count(*) = count(total_price)
                     THEN {r('CAST(sum(CAST(total_price AS DECIMAL(28,6))) AS DOUBLE)')} END AS line_sum
         FROM fx_invoice_lines_raw GROUP BY doc_id)"""

ROUND_OFF = f"""
kv AS ({with_rate('(' + with_amount('(SELECT *, lower(replace(replace(key, chr(32), chr(95)), chr(45), chr(95))) AS norm FROM fx_invoice_extra) k', plain='NOT is_text') + ') kk', plain='NOT is_text')}),
rank_off AS (SELECT doc_id, num, ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY source,
                    COALESCE(list_position(['round_off_amount', 'round_off', 'rounding_amount', 'rounding', 'roundoff_amount', 'roundoff'], key), 100), pos) AS rn
             FROM kv WHERE num IS NOT NULL
               AND norm IN ('round_off_amount', 'round_off', 'rounding_amount', 'rounding', 'roundoff_amount', 'roundoff')),
off AS (SELECT doc_id, num AS round_off FROM rank_off WHERE rn = 1)"""


def inputs_cte(with_extra: bool) -> str:
    off = "COALESCE(h.round_off_amount, off.round_off)" if with_extra else "h.round_off_amount"
    phrase = "doc_id IN (SELECT doc_id FROM fx_invoice_extra WHERE lower(text) = 'all taxes included')" if with_extra else "FALSE"
    join = "LEFT JOIN off USING (doc_id)" if with_extra else ""
    reaches = "abs(line_sum + COALESCE(shipping_amount, 0) + COALESCE(round_off_amount, 0) - total_amount) <= 0.01"
    meets = "COALESCE(abs(line_sum - subtotal) <= 0.01, FALSE)"
    return f"""{SUMS},{ROUND_OFF + ',' if with_extra else ''}
joined AS (SELECT h.doc_id, h.subtotal, h.tax_amount, h.tax_rate, h.discount_amount, h.shipping_amount, h.total_amount,
                  lower(trim(h.pricing_type)) AS pt, {off} AS round_off_amount, COALESCE(n_lines, 0) AS n_lines,
                  COALESCE(n_totals, 0) AS n_totals, line_sum, COALESCE(any_discount, FALSE) AS any_discount
           FROM fx_invoice_headers h LEFT JOIN sums USING (doc_id) {join}),
inputs AS (SELECT *, CASE WHEN pt = 'tax_inclusive' THEN TRUE WHEN pt = 'net' THEN FALSE WHEN {phrase} THEN TRUE
                          ELSE COALESCE(tax_amount > 0 AND {reaches} AND NOT {meets}, FALSE) END AS incl FROM joined)"""


sql("invoice_inputs", "fx_invoice_headers", "fx_invoice_extra")(
    """SELECT doc_id, subtotal, tax_amount, tax_rate, discount_amount, shipping_amount, total_amount, round_off_amount,
              n_lines, n_totals, line_sum, any_discount FROM inputs""",
    inputs_cte(True),
)
sql("pricing_model", "fx_invoice_headers", "fx_invoice_extra")(
    "SELECT doc_id, CASE WHEN incl THEN 'TAX_INCLUSIVE' ELSE 'TAX_EXCLUSIVE' END AS pricing_model FROM inputs", inputs_cte(True)
)
sql("round_off_lookup", "fx_invoice_extra")("SELECT doc_id, round_off FROM off", ROUND_OFF.strip())

_Q, _P, _T, _D = "quantity", "unit_price", "total_price", "d"
LINE_MATH = f"""
SELECT doc_id, 'invoice_line_item_' || line_no || '_math' AS rule_name,
       CASE WHEN quantity IS NULL OR total_price IS NULL OR kind IS NULL THEN 'quantity * unit_price == total_price'
            WHEN kind = 'PERCENT' THEN 'quantity * unit_price * (1 - discount_percent / 100) == total_price'
            WHEN per_unit_better THEN 'quantity * (unit_price - discount_amount) == total_price'
            ELSE 'quantity * unit_price - discount_amount == total_price' END AS formula,
       CASE WHEN kind = 'PERCENT' THEN CASE WHEN abs(stepped - total_price) < abs(exact - total_price) THEN stepped ELSE exact END
            WHEN kind = 'AMOUNT' THEN CASE WHEN per_unit_better THEN per_unit ELSE on_line END
            ELSE {r('quantity * unit_price')} END AS calc,
       total_price AS reported, NULL::DOUBLE AS var, {miss(quantity='quantity', unit_price='unit_price', total_price='total_price')} AS missing,
       FALSE AS na
FROM (SELECT *, {STATED} AS kind, {r('quantity * unit_price * (1.0 - discount_percent / 100.0)')} AS exact,
             {r('quantity * unit_price', 2)} AS whole, {r('whole - ' + r('whole * (discount_percent / 100.0)', 2), 2)} AS stepped,
             {r('quantity * unit_price - discount_amount')} AS on_line, {r('quantity * (unit_price - discount_amount)')} AS per_unit,
             COALESCE(abs(per_unit - total_price) < abs(on_line - total_price) AND abs(per_unit - total_price) <= 0.01, FALSE) AS per_unit_better
      FROM lines) l
UNION ALL
SELECT doc_id, 'invoice_line_item_math', 'quantity * unit_price == total_price', NULL, NULL, NULL, 'line_items', FALSE
FROM fx_invoice_headers WHERE doc_id NOT IN (SELECT doc_id FROM lines)"""
sql("missing_line_totals", "fx_invoice_lines_raw")(
    "SELECT doc_id, line_no, 'line_items[' || line_no || '].total_price' AS missing_field FROM lines WHERE total_price IS NULL", LINES.strip()
)
sql("invoice_line_math", "fx_invoice_lines_raw", "fx_invoice_headers")(judged(LINE_MATH), LINES.strip())

SUBTOTAL = f"""
SELECT doc_id, 'invoice_line_items_subtotal_reconciliation' AS rule_name,
       CASE WHEN lack = '' AND gross THEN 'sum(line_items.total_price) == total_amount (tax-inclusive)'
            ELSE 'sum(line_items.total_price) == subtotal' END AS formula,
       line_sum AS calc, CASE WHEN lack = '' THEN target ELSE subtotal END AS reported,
       CASE WHEN target IS NULL THEN 0.0 END AS var, lack AS missing, FALSE AS na
FROM (SELECT *, COALESCE(incl AND (subtotal IS NULL OR abs(line_sum - COALESCE(total_amount, 0)) <= 0.01), FALSE) AS gross,
             CASE WHEN gross THEN total_amount ELSE subtotal END AS target,
             CASE WHEN n_lines = 0 THEN 'line_items' WHEN n_totals < n_lines THEN 'line_items[*].total_price'
                  WHEN subtotal IS NULL AND NOT incl THEN 'subtotal' ELSE '' END AS lack FROM inputs) t"""
sql("invoice_subtotal", "fx_invoice_headers", "fx_invoice_lines_raw")(judged(SUBTOTAL), inputs_cte(False))

TOTAL = f"""
SELECT doc_id, 'invoice_total_reconciliation' AS rule_name,
       CASE WHEN lack <> '' THEN net
            WHEN incl AND adds THEN 'subtotal + tax_amount' || CASE WHEN ship <> 0 THEN ' + shipping_amount' ELSE '' END
                 || CASE WHEN rounded THEN ' + round_off_amount' ELSE '' END || ' == total_amount'
            WHEN incl THEN 'subtotal + shipping_amount' || CASE WHEN rounded THEN ' + round_off_amount' ELSE '' END || ' == total_amount (tax-inclusive)'
            WHEN rounded THEN replace(net, ' ==', ' + round_off_amount ==') ELSE net END AS formula,
       CASE WHEN incl AND adds THEN without WHEN incl THEN {r('COALESCE(subtotal, NULLIF(line_sum, 0), total_amount) + ship + ro')}
            WHEN any_discount AND disc > 0 AND abs(without - total_amount) <= 0.01 AND abs(with_d - total_amount) > 0.01 THEN without
            ELSE with_d END AS calc,
       total_amount AS reported, NULL::DOUBLE AS var, lack AS missing, FALSE AS na
FROM (SELECT *, COALESCE(tax_amount, 0) AS tx, COALESCE(shipping_amount, 0) AS ship, COALESCE(round_off_amount, 0) AS ro,
             COALESCE(discount_amount, 0) AS disc, round_off_amount IS NOT NULL AS rounded,
             'subtotal + tax_amount - discount_amount + shipping_amount == total_amount' AS net,
             COALESCE(abs(subtotal + tx + ship + ro - total_amount) <= 0.01, FALSE) AS adds,
             {r('subtotal + tx + ship + ro')} AS without, {r('subtotal + tx - disc + ship + ro')} AS with_d,
             CASE WHEN total_amount IS NULL OR (subtotal IS NULL AND NOT incl)
                  THEN {miss(subtotal='subtotal', total_amount='total_amount')} ELSE '' END AS lack FROM inputs) t"""
sql("invoice_total", "fx_invoice_headers", "fx_invoice_extra")(judged(TOTAL), inputs_cte(True))

# Components: one candidate per field, best by source, key order, exact before normalised, place.
COMPONENTS = f"""
names AS (SELECT * FROM (VALUES ('cgst', 0), ('sgst', 1), ('utgst', 2), ('igst', 3), ('cess', 4), ('vat', 5)) v(name, ord)),
cand AS (SELECT kv.doc_id, name, ord, kv.rate, num, is_text AND contains(text, '%') AS is_pct, r.i IS NOT NULL AS is_rate,
                ROW_NUMBER() OVER (PARTITION BY kv.doc_id, name ORDER BY source, COALESCE(r.i, a.i), CASE WHEN key = norm THEN 0 ELSE 1 END, pos) AS place
         FROM kv CROSS JOIN names
         LEFT JOIN (VALUES ('_rate', 0), ('_pct', 1), ('_percentage', 2), ('_percent', 3)) r(ending, i) ON norm = name || r.ending
         LEFT JOIN (VALUES ('_amount', 0), ('_val', 1), ('_value', 2), ('', 3)) a(ending, i) ON norm = name || a.ending
         WHERE text IS NOT NULL AND (r.i IS NOT NULL OR a.i IS NOT NULL)),
picked AS (SELECT doc_id, name, ord,
                  arg_min(rate, place) FILTER (WHERE is_rate AND rate IS NOT NULL) AS stated,
                  arg_min(rate, place) FILTER (WHERE NOT is_rate AND is_pct AND rate IS NOT NULL) AS pct,
                  min(place) FILTER (WHERE NOT is_rate AND is_pct AND rate IS NOT NULL) AS pct_place,
                  arg_min(num, place) FILTER (WHERE NOT is_rate AND NOT is_pct AND num IS NOT NULL) AS amount,
                  min(place) FILTER (WHERE NOT is_rate AND NOT is_pct AND num IS NOT NULL) AS amount_place
           FROM cand GROUP BY ALL),
parts0 AS (SELECT doc_id, name, 1000 + ord AS component_order,
                  COALESCE(stated, CASE WHEN amount_place IS NULL OR pct_place < amount_place THEN pct END) AS rate0, amount FROM picked),
gst AS (SELECT doc_id, max(amount) FILTER (WHERE name = 'cgst') AS cg FROM parts0 WHERE name IN ('cgst', 'sgst')
        GROUP BY doc_id HAVING count(*) = 2 AND count(rate0) = 0),
parts AS (SELECT p.doc_id, name, component_order, amount, h.subtotal, h.tax_amount, h.tax_rate,
                 round_even(cg / h.subtotal * 100, 0)::DOUBLE / 100 AS guess,
                 CASE WHEN gst.doc_id IS NOT NULL AND name IN ('cgst', 'sgst')
                      THEN CASE WHEN h.tax_rate > 0 THEN {r('h.tax_rate / 2', 6)}
                                WHEN h.subtotal > 0 AND (abs({r('h.subtotal * guess', 2)} - cg) <= 0.01 OR abs(h.subtotal * guess - cg) <= 0.01)
                                THEN {r('guess', 6)} END
                      ELSE rate0 END AS rate
          FROM parts0 p JOIN fx_invoice_headers h USING (doc_id) LEFT JOIN gst USING (doc_id) WHERE rate0 IS NOT NULL OR amount IS NOT NULL)"""
sql("tax_components", "fx_invoice_headers", "fx_invoice_extra")(
    "SELECT doc_id, component_order::INTEGER AS component_order, name, rate, amount FROM parts", (ROUND_OFF + "," + COMPONENTS).strip()
)

COMPONENT_AMOUNTS = f"""
by_line AS (SELECT p.doc_id, p.name, {r('CAST(sum(CAST(' + r('l.total_price * p.rate', 2) + ' AS DECIMAL(28,6))) AS DOUBLE)', 2)} AS ls
            FROM parts p JOIN fx_invoice_lines_raw l USING (doc_id) GROUP BY ALL),
solved AS (SELECT p.*, p.subtotal * rate AS exact, {r('exact', 2)} AS std, trunc({r('exact', 4)} * 100)::DOUBLE / 100 AS cut,
                  CASE WHEN exact IS NULL THEN amount
                       WHEN abs(amount - exact) <= 0.01 OR abs(amount - std) <= 0.01 OR abs(amount - cut) <= 0.01
                            OR (i.n_lines > 0 AND abs(amount - COALESCE(ls, 0)) <= 0.01) THEN amount ELSE std END AS one
           FROM parts p JOIN inputs i USING (doc_id) LEFT JOIN by_line USING (doc_id, name)),
doc_sums AS (SELECT doc_id, {r('COALESCE(sum(one), 0)', 2)} AS s, {r('sum(cut)', 2)} AS c, count(*) = count(rate) AS all_rates FROM solved GROUP BY doc_id),
amounts AS (SELECT doc_id, component_order, name, rate, amount,
                   CASE WHEN subtotal IS NOT NULL AND abs(s - tax_amount) > 0.01 AND all_rates AND abs(c - tax_amount) <= 0.01 THEN cut ELSE one END AS calculated_amount
            FROM solved JOIN doc_sums USING (doc_id))"""
TAX_CTES = inputs_cte(True) + "," + COMPONENTS + "," + COMPONENT_AMOUNTS
sql("tax_component_amounts", "fx_invoice_headers", "fx_invoice_extra")(
    "SELECT doc_id, name, rate, amount, calculated_amount FROM amounts", TAX_CTES
)

TAX = f"""
SELECT doc_id, 'invoice_tax_calculation' AS rule_name,
       CASE WHEN parts THEN pf WHEN zero THEN 'tax_amount == 0 (tax-exempt / zero-rated)'
            WHEN gross THEN 'total_amount * tax_rate / (1 + tax_rate) == tax_amount (tax-inclusive)'
            ELSE 'subtotal * tax_rate == tax_amount' END AS formula,
       CASE WHEN parts THEN ps WHEN zero THEN 0.0 WHEN gross THEN g ELSE {r('subtotal * tax_rate')} END AS calc,
       CASE WHEN NOT parts AND zero THEN COALESCE(tax_amount, 0) ELSE tax_amount END AS reported,
       CASE WHEN parts THEN NULL WHEN zero THEN 0.0 WHEN gross THEN {r('g - COALESCE(tax_amount, 0)')} END AS var,
       CASE WHEN parts THEN concat_ws(', ', CASE WHEN tax_amount IS NULL THEN 'tax_amount' END, CASE WHEN subtotal IS NULL AND no_amount THEN 'subtotal' END)
            WHEN zero OR gross THEN '' ELSE {miss(subtotal='subtotal', tax_rate='tax_rate', tax_amount='tax_amount')} END AS missing, FALSE AS na
FROM (SELECT i.*, n IS NOT NULL AS parts, ps, pf, no_amount, COALESCE(tax_amount = 0, FALSE) OR COALESCE(tax_rate = 0, FALSE) AS zero,
             incl AND tax_rate IS NOT NULL AND (total_amount IS NOT NULL OR subtotal IS NOT NULL) AS gross,
             {r('COALESCE(total_amount, COALESCE(subtotal, 0) + COALESCE(tax_amount, 0)) * (tax_rate / (1.0 + tax_rate))')} AS g
      FROM inputs i LEFT JOIN (SELECT doc_id, count(*) AS n, {r('CAST(COALESCE(sum(CAST(calculated_amount AS DECIMAL(28,6))), 0) AS DOUBLE)')} AS ps,
                                      string_agg(name || '_amount', ' + ' ORDER BY component_order) || ' == tax_amount' AS pf,
                                      bool_or(amount IS NULL) AS no_amount FROM amounts GROUP BY doc_id) c USING (doc_id)) t
WHERE parts OR zero OR gross OR tax_rate IS NOT NULL OR (tax_amount IS NOT NULL AND subtotal IS NOT NULL)"""
sql("invoice_tax", "fx_invoice_headers", "fx_invoice_extra")(judged(TAX), TAX_CTES)

GENERIC = """CASE WHEN doc_id % 8 = 1 THEN (doc_id % 40) || ' %' WHEN doc_id % 8 = 2 THEN '$5.00' WHEN doc_id % 8 = 3 THEN '5'
                  WHEN doc_id % 8 = 4 THEN 'none' WHEN doc_id % 8 = 5 THEN 'n/k' WHEN doc_id % 8 = 6 THEN '0' END"""
sql("resolve_line_discount", "fx_invoice_lines_raw")(
    f"""
SELECT doc_id, l_linenumber AS line_number, description, quantity, total_price,
       CASE WHEN stated_kind IS NOT NULL THEN stated_kind WHEN g IS NULL THEN NULL WHEN contains(g, '%') THEN 'PERCENT' WHEN contains(g, '$') THEN 'AMOUNT'
            WHEN by_pct THEN 'PERCENT' WHEN by_amt THEN 'AMOUNT' END AS discount_kind,
       CASE WHEN stated_kind = 'PERCENT' THEN discount_percent WHEN stated_kind = 'AMOUNT' THEN discount_amount
            WHEN contains(g, '%') THEN (doc_id % 40)::DOUBLE WHEN contains(g, '$') THEN 5.0 WHEN by_pct OR by_amt THEN n END AS discount_value,
       stated_kind IS NOT NULL OR COALESCE(contains(g, '%') OR contains(g, '$'), FALSE) AS has_discount
FROM (SELECT *, {STATED} AS stated_kind, {GENERIC} AS g, TRY_CAST(g AS DOUBLE) AS n,
             COALESCE(abs({r('quantity * unit_price * (1.0 - n / 100.0)')} - total_price) <= 0.01, FALSE) AS by_pct,
             COALESCE(abs({r('quantity * unit_price - n')} - total_price) <= 0.01, FALSE) AS by_amt
      FROM (SELECT * REPLACE (CASE WHEN doc_id % 3 <> 0 THEN discount_percent END AS discount_percent,
                              CASE WHEN doc_id % 3 <> 0 THEN discount_amount END AS discount_amount) FROM fx_invoice_lines_raw) l) t"""
)

# --- values ----------------------------------------------------------------------------------------------------------

sql("normalize_amounts", "fx_dirty")(f"SELECT doc_id, printed, amount FROM ({with_amount('fx_dirty', 'printed', 'amount')}) t")
sql("normalize_rates", "fx_dirty")(
    f"SELECT doc_id, printed, rate FROM ({with_rate('dirty', 'printed', 'rate')}) t",
    """dirty AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN (doc_id % 150) || CASE WHEN doc_id % 2 = 0 THEN '%' ELSE '' END ELSE printed END AS printed FROM fx_dirty)""",
)




def json_text_number(expression: str) -> str:
    """Number of a text that is one plain number."""
    return f"CASE WHEN regexp_full_match({strip(expression)}, '[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?') THEN TRY_CAST({strip(expression)} AS DOUBLE) END"


# Shown numbers: thousands grouped, at most four decimals, no trailing zeros.
def shown_number(e: str) -> str:
    return f"regexp_replace(regexp_replace(format('{{:,.4f}}', {e}), '0+$', ''), '\\.$', '')"


SIZE = "id * id * 7"
sql("display_values", "fx_invoice_headers", "fx_invoice_lines_raw", "fx_stored")(
    f"""
SELECT c.doc_id, rule_name, array_to_string(list_transform(string_split(rule_name, '_'), lambda w: upper(w[1]) || w[2:]), ' ') AS title,
       {shown_number('calculated_value')} AS calculated, {shown_number('reported_value')} AS reported,
       abs(variance) < 0.0001 AS variance_is_zero,
       CASE WHEN {SIZE} <= 0 THEN '0 Bytes'
            ELSE regexp_replace(CAST(CAST(round(({SIZE}) / pow(1024, u.p), 1) AS DECIMAL(38,1)) AS VARCHAR), '\\.0$', '') || ' ' || u.name END AS size_text
FROM ({judged(SUBTOTAL + ' UNION ALL ' + TOTAL)}) c JOIN fx_stored s ON s.id = c.doc_id
JOIN (VALUES (0, 'Bytes'), (1, 'KB'), (2, 'MB'), (3, 'GB')) u(p, name)
  ON u.p = CASE WHEN {SIZE} >= 1073741824 THEN 3 WHEN {SIZE} >= 1048576 THEN 2 WHEN {SIZE} >= 1024 THEN 1 ELSE 0 END""",
    inputs_cte(False),
)

# --- balance sheet ---------------------------------------------------------------------------------------------------

B_IN = """b_in AS (SELECT * EXCLUDE (share_capital, capital, total_liabilities_and_equity, total_capital_and_liabilities),
  CASE WHEN COALESCE(total_liabilities_and_equity, 0) <> 0 THEN total_liabilities_and_equity ELSE total_capital_and_liabilities END AS total_financing,
  CASE WHEN COALESCE(share_capital, 0) <> 0 THEN share_capital ELSE capital END AS share_capital FROM fx_balance_headers)"""
ASSET_NAME = "regexp_matches(n, 'cash|bank|investment|advance|loan|fixed asset|property|equipment|receivable|inventory|goodwill')"
FINANCE_NAME = "regexp_matches(n, 'capital|reserves|surplus|minority|deposit|borrowing|provision|payable|liabilit|equity|debt')"
B_LINES = f"""b_lines AS (SELECT doc_id, line_no, item_name, amount, line_class FROM (
  SELECT doc_id, line_no, trim(item_name) AS item_name, amount, lower(trim(item_name)) AS n, lower(COALESCE(category, '')) AS c,
         CASE WHEN c LIKE '%asset%' THEN 'asset' WHEN regexp_matches(c, 'liabilit|equity|capital') THEN 'liability_equity'
              WHEN {ASSET_NAME} AND NOT {FINANCE_NAME} THEN 'asset' WHEN {FINANCE_NAME} THEN 'liability_equity' END AS line_class
  FROM fx_balance_lines) t
  WHERE amount IS NOT NULL AND line_class IS NOT NULL AND NOT regexp_matches(n, 'contingent|bills for collection|commitments|guarantees|off-balance')
    AND n NOT IN ('total', 'total assets', 'total capital and liabilities', 'total liabilities and equity'))"""
_EXACT = lambda c: f"CAST(sum(CAST(amount AS DECIMAL(28,6))) FILTER (WHERE line_class = '{c}') AS DOUBLE)"
B_CTES = f"""{B_IN}, {B_LINES},
b_sums AS (SELECT doc_id, count(*) FILTER (WHERE line_class = 'asset') AS na, count(*) FILTER (WHERE line_class <> 'asset') AS nf,
                  {r(_EXACT('asset'))} AS sa, {r(_EXACT('liability_equity'))} AS sf FROM b_lines GROUP BY doc_id),
b AS (SELECT b_in.*, total_liabilities AS tl, total_equity AS te, total_assets AS ta, total_financing AS tf, COALESCE(na, 0) AS na, COALESCE(nf, 0) AS nf, sa, sf
      FROM b_in LEFT JOIN b_sums USING (doc_id))"""
sql("balance_inputs", "fx_balance_headers")("SELECT * FROM b_in", B_IN)
sql("classify_balance_lines", "fx_balance_lines")("SELECT * FROM b_lines", B_LINES)


def _pair_rule(order: int, name: str, a: str, b: str, total: str) -> str:
    return f"""SELECT doc_id, '{name}' AS rule_name, '{a} + {b} == {total}' AS formula, {r(f'{a} + {b}')} AS calc, {total} AS reported,
       NULL::DOUBLE AS var, {miss(**{a: a, b: b, total: total})} AS missing, FALSE AS na FROM b
       WHERE ({a} IS NOT NULL AND {b} IS NOT NULL) OR (nf = 0 AND ({a} IS NOT NULL OR {b} IS NOT NULL))"""


BALANCE = {
    "bs_equation": f"""SELECT doc_id, 'balance_sheet_accounting_equation' AS rule_name,
       CASE WHEN ta IS NULL OR f IS NULL OR (tl IS NOT NULL AND te IS NOT NULL) THEN 'total_liabilities + total_equity == total_assets'
            WHEN tf IS NOT NULL THEN 'total_capital_and_liabilities == total_assets' ELSE 'sum(liability_and_equity_components) == total_assets' END AS formula,
       f AS calc, ta AS reported, NULL::DOUBLE AS var,
       CASE WHEN ta IS NULL OR f IS NULL THEN concat_ws(', ', CASE WHEN ta IS NULL THEN 'total_assets' END,
            CASE WHEN tl IS NULL AND tf IS NULL AND nf = 0 THEN 'total_liabilities' END, CASE WHEN te IS NULL AND tf IS NULL AND nf = 0 THEN 'total_equity' END)
            ELSE '' END AS missing, ta IS NULL OR f IS NULL AS na
       FROM (SELECT *, CASE WHEN tl IS NOT NULL AND te IS NOT NULL THEN {r('tl + te')} WHEN tf IS NOT NULL THEN tf WHEN nf >= 2 THEN sf END AS f FROM b) t""",
    "bs_assets": f"""SELECT doc_id, 'balance_sheet_total_assets_components' AS rule_name,
       CASE WHEN split OR (NOT lined AND (ca IS NOT NULL OR nca IS NOT NULL)) THEN 'current_assets + non_current_assets == total_assets'
            ELSE 'sum(asset_components) == total_assets' END AS formula,
       CASE WHEN split THEN {r('ca + nca')} ELSE sa END AS calc, ta AS reported, NULL::DOUBLE AS var,
       CASE WHEN split OR lined THEN '' WHEN ca IS NOT NULL OR nca IS NOT NULL THEN {miss(current_assets='ca', non_current_assets='nca', total_assets='ta')}
            ELSE 'asset_components' END AS missing, FALSE AS na
       FROM (SELECT *, current_assets AS ca, non_current_assets AS nca, ca IS NOT NULL AND nca IS NOT NULL AND ta IS NOT NULL AS split,
                    b.na >= 2 AND ta IS NOT NULL AS lined FROM b) t""",
    "bs_le_components": """SELECT doc_id, 'balance_sheet_total_liabilities_and_equity_components' AS rule_name,
       'sum(liability_and_equity_components) == total_capital_and_liabilities' AS formula, sf AS calc, COALESCE(tf, ta) AS reported, NULL::DOUBLE AS var,
       '' AS missing, FALSE AS na FROM b WHERE nf >= 2 AND COALESCE(tf, ta) IS NOT NULL""",
    "bs_le_reconciliation": f"""SELECT doc_id, 'balance_sheet_liabilities_and_equity_reconciliation' AS rule_name,
       'total_liabilities + total_equity == total_liabilities_and_equity' AS formula, {r('tl + te')} AS calc, tf AS reported, NULL::DOUBLE AS var,
       '' AS missing, FALSE AS na FROM b WHERE tl IS NOT NULL AND te IS NOT NULL AND tf IS NOT NULL""",
    "bs_liabilities": _pair_rule(5, "balance_sheet_total_liabilities_components", "current_liabilities", "non_current_liabilities", "total_liabilities"),
    "bs_equity": _pair_rule(6, "balance_sheet_total_equity_components", "retained_earnings", "share_capital", "total_equity"),
}
for _name, _body in BALANCE.items():
    sql(_name, "fx_balance_headers", "fx_balance_lines")(judged(_body), B_CTES)

# --- profit and loss, cash flow --------------------------------------------------------------------------------------


def _hits(words: list[str], category: str | None, exclude: list[str]) -> str:
    tests = ["(" + " OR ".join(f"contains(n, '{w}')" for w in words) + ")"]
    tests += [f"NOT contains(n, '{w}')" for w in exclude]
    if category:
        tests.append(f"contains(c, '{category}')")
    return " AND ".join(tests)


def _first_line(name: str, metrics: dict) -> str:
    m = metrics[name]
    return ", ".join(
        f"arg_min(amount, line_no) FILTER (WHERE {_hits(words, category, m.exclude)}) AS {name}_{i}"
        for i, (category, words) in enumerate(m.passes)
    )


def line_lookup(view: str, metrics: dict) -> str:
    any_hit = " OR ".join(f"({_hits(w, c, m.exclude)})" for m in metrics.values() for c, w in m.passes)
    return f"""SELECT doc_id, {', '.join(_first_line(n, metrics) for n in metrics)}
FROM (SELECT doc_id, line_no, NULLIF(amount, 0) AS amount, lower(item_name) AS n, lower(COALESCE(category, '')) AS c FROM {view}) t
WHERE amount IS NOT NULL AND ({any_hit}) GROUP BY doc_id"""


def extra_lookup_sql(metrics: dict) -> str:
    wanted = " UNION ALL ".join(
        f"SELECT '{name}' AS metric, '{key}' AS k, {i} AS i" for name, m in metrics.items() for i, key in enumerate(m.extra)
    )
    picks = ", ".join(f"arg_min(v, rank) FILTER (WHERE metric = '{n}') AS x_{n}" for n in metrics)
    return f"""x_kv AS (SELECT *, lower(replace(replace(key, '-', '_'), ' ', '_')) AS norm FROM ({with_amount('fx_pnl_extra', plain='NOT is_text')}) k WHERE source = 1),
x_wanted AS ({wanted}),
x_cand AS (SELECT doc_id, metric, i AS rank, num AS v FROM x_kv JOIN x_wanted ON key = k
           UNION ALL SELECT doc_id, metric, 1000 + i, last FROM (SELECT doc_id, norm, arg_max_null(num, pos) AS last FROM x_kv GROUP BY ALL) g JOIN x_wanted ON norm = k),
x AS (SELECT doc_id, {picks} FROM x_cand WHERE v IS NOT NULL GROUP BY doc_id)"""


from ledgerline.operators.lookups import BANK_METRICS, CASH_METRICS  # noqa: E402  (fixed look-up data, stated once)

sql("keyword_lookup", "fx_pnl_lines")(line_lookup("fx_pnl_lines", BANK_METRICS))
sql("extra_lookup", "fx_pnl_extra")(
    "SELECT doc_id, " + ", ".join(f"x_{n} AS {n}" for n in BANK_METRICS) + " FROM x", extra_lookup_sql(BANK_METRICS)
)


def _chain(sources: list[str]) -> str:
    return "COALESCE(" + ", ".join([f"NULLIF({s}, 0)" for s in sources[:-1]] + [sources[-1]]) + ")"


def _metric_sql(name: str, metrics: dict, extra: bool) -> str:
    m = metrics[name]
    sources = list(m.header_first) + ([f"x_{name}"] if extra else []) + [f"{name}_{i}" for i in range(len(m.passes))] + list(m.header_last)
    return f"{_chain(sources)} AS m_{name}"


P_CTES = f"""{extra_lookup_sql(BANK_METRICS)}, p_lines AS ({line_lookup('fx_pnl_lines', BANK_METRICS)}),
p AS (SELECT h.*, {', '.join(_metric_sql(n, BANK_METRICS, True) for n in BANK_METRICS)}
      FROM fx_pnl_headers h LEFT JOIN x USING (doc_id) LEFT JOIN p_lines USING (doc_id))"""
sql("bank_metrics", "fx_pnl_headers", "fx_pnl_lines", "fx_pnl_extra")(
    "SELECT doc_id, " + ", ".join(f"m_{n}" for n in BANK_METRICS) + " FROM p", P_CTES
)


def _rule(name: str, formula: str, calc: str, inputs: dict, view: str) -> str:
    reported = list(inputs.values())[-1]
    return f"""SELECT doc_id, '{name}' AS rule_name, {formula} AS formula, {r(calc)} AS calc, {reported} AS reported, NULL::DOUBLE AS var,
       {miss(**inputs)} AS missing, FALSE AS na FROM {view}"""


_same = lambda *names: {n: n for n in names}
PNL = {
    "pnl_gross_profit": _rule("pnl_gross_profit_calculation", "'total_revenue - cost_of_goods_sold == gross_profit'", "total_revenue - cost_of_goods_sold",
                              _same("total_revenue", "cost_of_goods_sold", "gross_profit"), "p"),
    "pnl_operating_income": _rule("pnl_operating_income_calculation", "'gross_profit - operating_expenses == operating_income'", "gross_profit - operating_expenses",
                                  _same("gross_profit", "operating_expenses", "operating_income"), "p"),
    "pnl_net_income": _rule("pnl_net_income_calculation", "'operating_income - interest_expense - tax_expense == net_income'",
                            "operating_income - interest_expense - tax_expense", _same("operating_income", "interest_expense", "tax_expense", "net_income"), "p"),
    "pnl_bank_income": _rule("pnl_bank_total_income", "'interest_earned + other_income == total_income'", "m_interest_earned + m_other_income",
                             {"interest_earned": "m_interest_earned", "other_income": "m_other_income", "total_income": "m_total_income"}, "p"),
    "pnl_bank_expenditure": _rule("pnl_bank_total_expenditure", "'interest_expended + operating_expenses + provisions_and_contingencies == total_expenditure'",
                                  "m_interest_expended + m_operating_expenses + m_provisions",
                                  {"interest_expended": "m_interest_expended", "operating_expenses": "m_operating_expenses",
                                   "provisions_and_contingencies": "m_provisions", "total_expenditure": "m_total_expenditure"}, "p"),
    "pnl_bank_net_profit": _rule("pnl_bank_net_profit_before_minority", "'total_income - total_expenditure == net_profit_for_the_year'", "m_total_income - m_total_expenditure",
                                 {"total_income": "m_total_income", "total_expenditure": "m_total_expenditure", "net_profit_for_the_year": "m_net_profit_year"}, "p"),
    "pnl_bank_consolidated": _rule("pnl_bank_consolidated_net_profit", "'net_profit_for_the_year - minority_interest == consolidated_net_profit'",
                                   "m_net_profit_year - m_minority_interest",
                                   {"net_profit_for_the_year": "m_net_profit_year", "minority_interest": "m_minority_interest",
                                    "consolidated_net_profit": "m_consolidated_profit"}, "p"),
    "pnl_bank_appropriations": _rule("pnl_bank_appropriations_reconciliation",
                                     "CASE WHEN m_amalgamation IS NOT NULL AND m_consolidated_profit IS NOT NULL AND m_brought_forward IS NOT NULL AND m_total_appropriations IS NOT NULL "
                                     "THEN 'consolidated_net_profit + brought_forward_profit + addition_on_amalgamation == total_appropriations' "
                                     "ELSE 'consolidated_net_profit + brought_forward_profit == total_appropriations' END",
                                     "m_consolidated_profit + m_brought_forward + COALESCE(m_amalgamation, 0)",
                                     {"consolidated_net_profit": "m_consolidated_profit", "brought_forward_profit": "m_brought_forward",
                                      "total_appropriations": "m_total_appropriations"}, "p"),
}
for _name, _body in PNL.items():
    sql(_name, "fx_pnl_headers", "fx_pnl_lines", "fx_pnl_extra")(judged(_body), P_CTES)

FLOWS = ["net_cash_from_operating_activities", "net_cash_from_investing_activities", "net_cash_from_financing_activities"]
_CASH_COLUMNS = [*FLOWS, "net_change_in_cash", "beginning_cash_balance", "ending_cash_balance", "effect_of_exchange_rate_changes"]
_CASH_TEXTS = "(" + " UNION ALL ".join(f"SELECT doc_id, '{c}' AS k, {c} AS text FROM fx_cash_headers" for c in _CASH_COLUMNS) + ") u"
C_CTES = f"""c_long AS ({with_amount(_CASH_TEXTS)}),
c_wide AS (SELECT doc_id, {', '.join(f"max(num) FILTER (WHERE k = '{c}') AS {c}" for c in _CASH_COLUMNS)} FROM c_long GROUP BY doc_id),
c_lines AS ({line_lookup('fx_cash_lines', CASH_METRICS)}),
c AS (SELECT w.*, COALESCE(NULLIF(effect_of_exchange_rate_changes, 0), exchange_effect_0) AS e FROM c_wide w LEFT JOIN c_lines USING (doc_id))"""
_SUM = " + ".join(FLOWS)
CASH = {
    "cf_net_change": _rule("cash_flow_net_change_calculation",
                           f"CASE WHEN e IS NOT NULL AND {' AND '.join(f + ' IS NOT NULL' for f in [*FLOWS, 'net_change_in_cash'])} "
                           f"THEN '{_SUM} + effect_of_exchange_rate_changes == net_change_in_cash' ELSE '{_SUM} == net_change_in_cash' END",
                           f"{_SUM} + COALESCE(e, 0)", _same(*FLOWS, "net_change_in_cash"), "c"),
    "cf_ending_cash": _rule("cash_flow_ending_cash_calculation", "'beginning_cash_balance + net_change_in_cash == ending_cash_balance'",
                            "beginning_cash_balance + net_change_in_cash", _same("beginning_cash_balance", "net_change_in_cash", "ending_cash_balance"), "c"),
}
for _name, _body in CASH.items():
    sql(_name, "fx_cash_headers", "fx_cash_lines")(judged(_body), C_CTES)

# --- all checks, summaries and reports -------------------------------------------------------------------------------

_EVERYTHING = " UNION ALL ".join(f"({b})" for b in [LINE_MATH, SUBTOTAL, TOTAL, TAX, *BALANCE.values(), *PNL.values(), *CASH.values()])
ALL_CHECKS = f"""SELECT *, CASE split_part(rule_name, '_', 1) WHEN 'invoice' THEN 'invoice' WHEN 'balance' THEN 'balance_sheet' WHEN 'pnl' THEN 'profit_and_loss'
  ELSE 'cash_flow_statement' END AS document_type FROM ({judged(_EVERYTHING)}) t"""
ALL_CTES = ",".join([LINES, TAX_CTES, B_CTES, P_CTES, C_CTES])
_ALL_VIEWS = ("fx_invoice_headers", "fx_invoice_extra", "fx_balance_headers", "fx_balance_lines", "fx_pnl_headers", "fx_pnl_lines",
              "fx_pnl_extra", "fx_cash_headers", "fx_cash_lines")
sql("all_checks", *_ALL_VIEWS)(ALL_CHECKS, ALL_CTES)

RULE_ORDER = """CASE WHEN rule_name LIKE 'invoice_line_item_%' THEN 1 WHEN rule_name LIKE '%subtotal%' THEN 2 WHEN rule_name LIKE 'invoice_total%' THEN 3
  WHEN rule_name LIKE 'invoice_tax%' THEN 4 WHEN rule_name LIKE '%equation' THEN 11 WHEN rule_name LIKE '%total_assets%' THEN 12
  WHEN rule_name LIKE '%liabilities_and_equity_components' THEN 13 WHEN rule_name LIKE 'balance%reconciliation' THEN 14
  WHEN rule_name LIKE '%total_liabilities_components' THEN 15 WHEN rule_name LIKE '%total_equity_components' THEN 16
  WHEN rule_name = 'pnl_gross_profit_calculation' THEN 21 WHEN rule_name = 'pnl_operating_income_calculation' THEN 22
  WHEN rule_name = 'pnl_net_income_calculation' THEN 23 WHEN rule_name = 'pnl_bank_total_income' THEN 24
  WHEN rule_name = 'pnl_bank_total_expenditure' THEN 25 WHEN rule_name = 'pnl_bank_net_profit_before_minority' THEN 26
  WHEN rule_name = 'pnl_bank_consolidated_net_profit' THEN 27 WHEN rule_name LIKE 'pnl_bank%' THEN 28
  WHEN rule_name = 'cash_flow_net_change_calculation' THEN 31 ELSE 32 END"""
_LINE_NO = "TRY_CAST(regexp_extract(rule_name, 'item_(\\d+)_', 1) AS BIGINT)"
sql("validation_summary", *_ALL_VIEWS)(
    f"""
SELECT doc_id, document_type, count(*) AS total_checks, count(*) FILTER (WHERE status = 'PASS') AS passed_checks,
       count(*) FILTER (WHERE status = 'FAILED') AS failed_checks, count(*) FILTER (WHERE status = 'NOT_APPLICABLE') AS not_applicable_checks,
       failed_checks = 0 AS is_valid,
       CASE WHEN failed_checks > 0 THEN 'Financial validation failed ' || failed_checks || ' check(s): '
            || string_agg(rule_name, ', ' ORDER BY {RULE_ORDER}, {_LINE_NO}) FILTER (WHERE status = 'FAILED') || '.' END AS error
FROM ({ALL_CHECKS}) c GROUP BY doc_id, document_type""",
    ALL_CTES,
)
sql("failed_rules", *_ALL_VIEWS)(
    f"""
SELECT doc_id, document_type, COALESCE(({_LINE_NO} - 1) // 1000, -1) AS piece, count(*) AS total_checks, count(*) FILTER (WHERE status = 'PASS') AS passed_checks,
       count(*) FILTER (WHERE status = 'FAILED') AS failed_checks, count(*) FILTER (WHERE status = 'NOT_APPLICABLE') AS not_applicable_checks,
       COALESCE(string_agg(rule_name, ', ' ORDER BY {RULE_ORDER}, {_LINE_NO}) FILTER (WHERE status = 'FAILED'), '') AS failed_rules
FROM ({ALL_CHECKS}) c GROUP BY ALL""",
    ALL_CTES,
)
sql("rule_report", *_ALL_VIEWS)(
    f"""
SELECT document_type, rule, status, CAST(grouping_id(document_type, rule, status) AS INTEGER) AS level, count(*) AS n_checks,
       count(*) FILTER (WHERE status = 'PASS') AS n_passed, max(abs(variance)) AS max_abs_variance, n_passed / n_checks AS pass_rate
FROM (SELECT *, regexp_replace(rule_name, '_item_\\d+_', '_item_') AS rule FROM ({ALL_CHECKS}) c) t GROUP BY CUBE (document_type, rule, status)""",
    ALL_CTES,
)
_BALANCE_ALL = " UNION ALL ".join(f"({b})" for b in BALANCE.values())
sql("check_filter", "fx_balance_headers", "fx_balance_lines")(
    f"""SELECT doc_id, rule_name, status, variance, count(*) OVER () AS n_in_tab FROM ({judged(_BALANCE_ALL)}) t WHERE status = 'FAILED'""", B_CTES
)

# --- responses -------------------------------------------------------------------------------------------------------

CLEAN = strip("regexp_replace(regexp_replace(" + strip("raw") + ", '^```(json)?', ''), '```$', '')")
PARSED = f"""
clean AS (SELECT doc_id, document_type, {CLEAN} AS clean FROM fx_responses),
parsed AS (SELECT *, CASE WHEN starts_with(clean, '{{') THEN TRY_CAST(clean AS JSON) END AS body,
                  COALESCE(json_exists(body, '$.extracted_data'), FALSE) AS enclosed,
                  CASE WHEN enclosed THEN json_extract(body, '$.extracted_data') ELSE body END AS data FROM clean)"""
sql("strip_fences", "fx_responses")("SELECT doc_id, clean FROM clean", PARSED.strip())
sql("scan_responses", "fx_responses")(
    """SELECT doc_id, document_type, body IS NOT NULL AS is_object,
       CASE WHEN clean = '' THEN 'empty response' WHEN body IS NOT NULL THEN NULL WHEN TRY_CAST(clean AS JSON) IS NULL THEN 'invalid JSON' ELSE 'not an object' END AS error
       FROM parsed""",
    PARSED.strip(),
)
sql("unwrap_payload", "fx_responses")(
    """SELECT doc_id, enclosed, len(json_keys(data))::INTEGER AS n_keys,
              COALESCE(len(json_keys(body, '$.evidence')), 0)::INTEGER AS n_evidence FROM parsed""",
    PARSED.strip(),
)


def _projection(kind: str) -> str:
    from ledgerline.operators.payload import NUMBER_FIELDS, TEXT_FIELDS  # fixed field names

    texts = [f"CASE WHEN json_type(data, '$.{c}') = 'VARCHAR' THEN json_extract_string(data, '$.{c}') END AS {c}" for c in TEXT_FIELDS[kind]]

    def number(names: list[str]) -> str:
        kinds = "COALESCE(" + ", ".join(f"json_type(data, '$.{n}')" for n in names) + ")"
        first = "COALESCE(" + ", ".join(f"json_extract(data, '$.{n}')" for n in names) + ")"
        text = "json_extract_string(" + first + ", '$')"
        return f"CASE {kinds} WHEN 'BOOLEAN' THEN CASE WHEN {text} = 'true' THEN 1.0 ELSE 0.0 END ELSE {json_text_number(text)} END"

    numbers = [f"{number(n)} AS {c}" for c, n in NUMBER_FIELDS[kind].items()]
    return f"SELECT doc_id, {', '.join(texts + numbers)} FROM parsed WHERE document_type = '{kind}'"


for _name, _kind in {"project_invoice": "invoice", "project_balance_sheet": "balance_sheet", "project_pnl": "profit_and_loss",
                     "project_cash_flow": "cash_flow_statement"}.items():
    sql(_name, "fx_responses")(_projection(_kind), PARSED.strip())


def _broken() -> str:
    from ledgerline.operators.payload import LINE_NUMBER, LINE_TEXT, NUMBER_FIELDS, TEXT_FIELDS, TYPES

    text_of = lambda fields: "(" + ", ".join(f"'{n}'" for names in fields.values() for n in names) + ")"
    number_ok = f"(type IN ('NULL', 'BOOLEAN', 'DOUBLE', 'UBIGINT', 'BIGINT') OR (type = 'VARCHAR' AND {json_text_number('atom_text')} IS NOT NULL))"
    text_ok = "type IN ('NULL', 'VARCHAR')"
    top = " OR ".join(
        f"(document_type = '{k}' AND ((key IN {text_of(TEXT_FIELDS[k])} AND NOT {text_ok}) OR (key IN {text_of(NUMBER_FIELDS[k])} AND NOT {number_ok})))"
        for k in TYPES
    )
    line = " OR ".join(
        f"({cond} AND ((key IN {text_of(LINE_TEXT[k])} AND NOT {text_ok}) OR (key IN {text_of(LINE_NUMBER[k])} AND NOT {number_ok})))"
        for k, cond in (("invoice", "document_type = 'invoice'"), ("statement", "document_type <> 'invoice'"))
    )
    return f"""
members AS (SELECT p.doc_id, document_type, e.key, e.type, json_extract_string(e.value, '$') AS atom_text FROM parsed p, json_each(p.data) e WHERE body IS NOT NULL),
items AS (SELECT p.doc_id, document_type, e.value AS item FROM parsed p, json_each(p.data, '$.line_items') e WHERE json_type(p.data, '$.line_items') = 'ARRAY'),
item_members AS (SELECT i.doc_id, document_type, e.key, e.type, json_extract_string(e.value, '$') AS atom_text FROM items i, json_each(i.item) e),
broken AS (SELECT doc_id FROM members WHERE {top} OR (key = 'line_items' AND type <> 'ARRAY') OR (key = 'additional_fields' AND type <> 'OBJECT')
           UNION SELECT doc_id FROM item_members WHERE {line}
           UNION SELECT doc_id FROM items WHERE document_type <> 'invoice' AND COALESCE(json_type(item, '$.item_name'), '') <> 'VARCHAR'),
results AS (SELECT p.*, CASE WHEN body IS NULL THEN 'FAILED' WHEN doc_id IN (SELECT doc_id FROM broken) THEN 'PARTIAL' ELSE 'SUCCESS' END AS extraction_status FROM parsed p)"""


RESULTS = PARSED.strip() + "," + _broken()
sql("extraction_result_status", "fx_responses")(
    """SELECT doc_id, document_type, extraction_status,
       CASE WHEN clean = '' THEN 'empty response' WHEN extraction_status = 'PARTIAL' THEN 'schema error' WHEN body IS NOT NULL THEN NULL
            WHEN TRY_CAST(clean AS JSON) IS NULL THEN 'invalid JSON' ELSE 'not an object' END AS reason FROM results""",
    RESULTS,
)
sql("evidence_rows", "fx_responses")(
    """SELECT p.doc_id, e.key AS field, json_extract_string(e.value, '$.source_snippet') AS source_snippet,
              CAST(json_extract_string(e.value, '$.page_number') AS INTEGER) AS page_number
       FROM parsed p, json_each(p.body, '$.evidence') e WHERE p.body IS NOT NULL AND json_exists(p.body, '$.evidence') AND e.type = 'OBJECT'""",
    PARSED.strip(),
)
sql("line_rows", "fx_responses")(
    """
SELECT doc_id, line_no, COALESCE(json_extract_string(item, '$.description'), CASE WHEN document_type = 'invoice' THEN 'Item ' || line_no END) AS description,
       json_extract_string(item, '$.item_name') AS item_name, json_extract_string(item, '$.category') AS category,
       CAST(json_extract_string(item, '$.quantity') AS DOUBLE) AS quantity, CAST(json_extract_string(item, '$.unit_price') AS DOUBLE) AS unit_price,
       CAST(json_extract_string(item, '$.total_price') AS DOUBLE) AS total_price, CAST(json_extract_string(item, '$.amount') AS DOUBLE) AS amount,
       CASE WHEN extraction_status = 'SUCCESS' THEN CAST(CAST(json_extract_string(item, '$.discount_pct') AS DOUBLE) AS VARCHAR) END AS discount_percent,
       CASE WHEN extraction_status = 'SUCCESS' THEN CAST(json_extract_string(item, '$.gross_worth') AS DOUBLE) END AS gross_amount,
       CAST(json_extract_string(item, '$.page_number') AS INTEGER) AS page_number
FROM (SELECT r.doc_id, document_type, extraction_status, CAST(CAST(e.key AS INTEGER) + 1 AS INTEGER) AS line_no, e.value AS item
      FROM results r, json_each(r.data, '$.line_items') e WHERE json_type(r.data, '$.line_items') = 'ARRAY') t""",
    RESULTS,
)
sql("extra_rows", "fx_responses")(
    f"""SELECT doc_id, pos::INTEGER AS pos, key, lower(replace(replace(key, '-', '_'), ' ', '_')) AS key_norm, CASE WHEN is_text THEN text END AS text, is_text, num
        FROM ({with_amount('(SELECT p.doc_id, row_number() OVER (PARTITION BY p.doc_id ORDER BY e.id) - 1 AS pos, e.key, json_extract_string(e.value, chr(36)) AS text, COALESCE(e.type = ' + "'VARCHAR'" + ', FALSE) AS is_text FROM parsed p, json_each(p.data, ' + "'$.additional_fields'" + ') e WHERE json_type(p.data, ' + "'$.additional_fields'" + ') = ' + "'OBJECT'" + ')', plain='NOT is_text')}) t""",
    PARSED.strip(),
)
DISPATCHED = """
SELECT doc_id, checked_type, checked_type IN ('invoice', 'balance_sheet', 'profit_and_loss', 'cash_flow_statement') AS is_supported
FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'invoice' WHEN doc_id % 31 = 1 THEN 'receipt' ELSE document_type END AS given,
             CASE WHEN lower(json_extract_string(data, '$.statement_type')) IN ('invoice', 'balance_sheet', 'profit_and_loss', 'cash_flow_statement')
                  THEN lower(json_extract_string(data, '$.statement_type'))
                  WHEN given = 'invoice' AND (json_exists(data, '$.total_assets') OR json_exists(data, '$.current_assets')) AND NOT json_exists(data, '$.subtotal')
                  THEN 'balance_sheet' ELSE given END AS checked_type FROM parsed) t"""
sql("dispatch_type", "fx_responses")(DISPATCHED, PARSED.strip())
sql("document_summary", "fx_responses", *_ALL_VIEWS)(
    f"""
SELECT doc_id, checked_type AS document_type, COALESCE(n, 0) AS total_checks, COALESCE(p, 0) AS passed_checks, COALESCE(f, 0) AS failed_checks,
       COALESCE(na, 0) AS not_applicable_checks, is_supported AND COALESCE(f, 0) = 0 AS is_valid,
       CASE WHEN NOT is_supported THEN 'No checks exist for documents of type ' || chr(39) || checked_type || chr(39) || '.'
            WHEN f > 0 THEN 'Financial validation failed ' || f || ' check(s).' END AS error
FROM ({DISPATCHED}) d LEFT JOIN (
  SELECT doc_id, document_type AS checked_type, count(*) AS n, count(*) FILTER (WHERE status = 'PASS') AS p, count(*) FILTER (WHERE status = 'FAILED') AS f,
         count(*) FILTER (WHERE status = 'NOT_APPLICABLE') AS na FROM ({ALL_CHECKS}) c GROUP BY ALL) s USING (doc_id, checked_type)""",
    ",".join([PARSED.strip(), ALL_CTES]),
)
sql("field_partition", "fx_responses")(
    """
SELECT p.doc_id, e.key, CASE WHEN e.key = 'line_items' AND e.type = 'ARRAY' THEN 'line_items' WHEN e.type IN ('ARRAY', 'OBJECT') THEN 'nested'
            WHEN e.key IN ('company_name', 'vendor_name', 'invoice_number', 'reporting_period', 'statement_type') THEN 'entity' ELSE 'financial' END AS part,
       COALESCE(json_extract_string(e.value, '$'), '') = '' AS is_null,
       CASE WHEN e.type IN ('ARRAY', 'OBJECT') THEN NULL WHEN e.type IN ('DOUBLE', 'UBIGINT', 'BIGINT') THEN
            regexp_replace(regexp_replace(CAST(CAST(json_extract_string(e.value, '$') AS DECIMAL(20,2)) AS VARCHAR), '0+$', ''), '\\.$', '')
            ELSE json_extract_string(e.value, '$') END AS text,
       CASE WHEN e.type IN ('DOUBLE', 'UBIGINT', 'BIGINT') THEN CAST(json_extract_string(e.value, '$') AS DOUBLE) END AS number
FROM parsed p, json_each(p.data) e WHERE p.body IS NOT NULL""",
    PARSED.strip(),
)

# --- pages and text --------------------------------------------------------------------------------------------------

ROUTED = f"""
routed AS (SELECT *, CASE WHEN COALESCE({strip('text')}, '') <> '' THEN 'digital' WHEN n_images > 0 THEN 'scanned' WHEN rendered THEN 'rasterized' ELSE 'blank' END AS route
           FROM fx_pages)"""
sql("page_route", "fx_pages")(
    """SELECT doc_id, page_number, route, route IN ('scanned', 'rasterized') AS is_scanned,
       CASE route WHEN 'scanned' THEN 'Page ' || page_number || ': no text, read from its image.'
                  WHEN 'rasterized' THEN 'Page ' || page_number || ': neither text nor image, rendered for recognition.'
                  WHEN 'blank' THEN 'Page ' || page_number || ': nothing to read.' END AS warning FROM routed""",
    ROUTED.strip(),
)
TEXT_STATUS = f"""
SELECT doc_id, count(*) AS n_pages, count(ocr_error) AS n_errors, bool_or(COALESCE({strip('text')}, '') <> '') AS has_text,
       CASE WHEN count(ocr_error) = 0 THEN 'SUCCESS' WHEN bool_or(COALESCE({strip('text')}, '') <> '') THEN 'PARTIAL_SUCCESS' ELSE 'FAILED' END AS extraction_status
FROM fx_pages GROUP BY doc_id"""
sql("extraction_status", "fx_pages")(TEXT_STATUS)
sql("full_text", "fx_pages")(
    f"""SELECT doc_id, n_pages, {strip("COALESCE(t, '')")} AS text
        FROM (SELECT doc_id, count(*) AS n_pages, string_agg(text, chr(10) || chr(10) ORDER BY page_number) FILTER (WHERE text <> '') AS t FROM fx_pages GROUP BY doc_id) q"""
)
CONTEXT = f"""SELECT doc_id, string_agg('--- [PAGE ' || page_number || '] ---' || chr(10) || {strip("COALESCE(text, '')")} || chr(10), chr(10) ORDER BY page_number) AS context
FROM fx_pages GROUP BY doc_id"""
sql("page_context", "fx_pages")(CONTEXT)
_says = lambda words: "(" + " OR ".join(f"contains(h, '{w}')" for w in words) + ")"
_BS = _says(["BALANCE SHEET", "CONSOLIDATED BALANCE SHEET", "STATEMENT OF FINANCIAL POSITION", "STATEMENT OF ASSETS AND LIABILITIES", "CAPITAL AND LIABILITIES"])
_PL = _says(["PROFIT AND LOSS", "PROFIT & LOSS", "INCOME STATEMENT", "STATEMENT OF OPERATIONS", "STATEMENT OF EARNINGS", "STATEMENT OF COMPREHENSIVE INCOME"])
_CF = _says(["CASH FLOW STATEMENT", "STATEMENT OF CASH FLOWS", "CASH FLOWS STATEMENT"])
_IN = _says(["TAX INVOICE", "COMMERCIAL INVOICE", "BILL OF SUPPLY", "PROFORMA INVOICE", "INVOICE NUMBER", "INVOICE DATE", "BILL TO", "SHIP TO", "GSTIN"])
RECONCILED = f"""SELECT doc_id, requested_type, CASE WHEN {_BS} AND NOT {_IN} THEN 'balance_sheet' WHEN {_PL} AND NOT {_IN} THEN 'profit_and_loss'
       WHEN {_CF} AND NOT {_IN} THEN 'cash_flow_statement' WHEN {_IN} AND NOT ({_BS} OR {_PL} OR {_CF}) THEN 'invoice' ELSE requested_type END AS reconciled_type
FROM (SELECT *, upper(text) AS h FROM fx_text) t"""
sql("reconcile_type", "fx_text")(RECONCILED)
sql("request_table", "fx_pages", "fx_text")(
    f"""
SELECT c.doc_id, t.reconciled_type AS document_type, 'Read the ' || replace(t.reconciled_type, '_', ' ') || ' and answer with one JSON object.' AS system_prompt,
       'Document type: ' || upper(replace(t.reconciled_type, '_', ' ')) || chr(10) || chr(10) ||
         CASE WHEN s.list IS NOT NULL THEN 'Attached page images: ' || s.list || '.' ELSE c.context END AS user_prompt,
       s.list IS NOT NULL AS by_image
FROM ({CONTEXT}) c JOIN ({RECONCILED}) t USING (doc_id)
LEFT JOIN (SELECT doc_id, string_agg(page_number, ', ' ORDER BY page_number) AS list FROM routed WHERE route IN ('scanned', 'rasterized') GROUP BY doc_id) s USING (doc_id)""",
    ROUTED.strip(),
)
_MARK = "[REDACTED_API_KEY]"
sql("redact", "fx_text")(
    f"""
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(text, 'secret-key-9', '{_MARK}'),
         'AIza[0-9A-Za-z\\-_]{{35}}', '{_MARK}', 'g'), '(key=)[A-Za-z0-9\\-_]+', '\\1{_MARK}', 'g'),
         '(Bearer\\s+)[A-Za-z0-9\\-_.]+', '\\1{_MARK}', 'g'), '(token = ")[^"]+', '\\1{_MARK}', 'g') AS text
FROM (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'GET /v1?key=abc-DEF_123&x=1 ' WHEN 1 THEN 'Authorization: Bearer  tok.en-1_2 '
                     WHEN 2 THEN 'AIza' || repeat('a1', 18) || ' ' WHEN 3 THEN 'my secret-key-9 here ' ELSE '' END || text AS text FROM fx_text) t"""
)

# --- files -----------------------------------------------------------------------------------------------------------

FILE_FACTS = """
facts AS (SELECT doc_id, name, hex_content AS h, CAST(length(hex_content) / 2 AS BIGINT) AS length,
                 lower(regexp_extract(name, '(\\.[^.]+)$', 1)) AS extension,
                 CASE extension WHEN '.pdf' THEN 'pdf' WHEN '.png' THEN 'png' WHEN '.jpg' THEN 'jpeg' WHEN '.jpeg' THEN 'jpeg'
                      WHEN '' THEN CASE WHEN starts_with(h, '255044462D') THEN 'pdf' WHEN starts_with(h, '89504E470D0A1A0A') THEN 'png'
                                        WHEN starts_with(h, 'FFD8') THEN 'jpeg' END END AS file_type
          FROM fx_files)"""
TRIAGED = (
    FILE_FACTS.strip()
    + """,
texts AS (SELECT f.*, CASE WHEN starts_with(h, '255044462D') THEN '%PDF-1.4' || chr(10) || d.text || CASE WHEN d.doc_id % 12 = 4 THEN '' WHEN d.doc_id % 8 = 0
                 THEN '<< /Type /Pages /Kids [] /Count ' || (d.doc_id % 6) || ' >>' ELSE '<< /Type /Page >> << /Type/Page /Parent 1 >>' END || chr(10) || '%%EOF' ELSE '' END AS t
          FROM facts f JOIN documents d USING (doc_id)),
counted AS (SELECT *, COALESCE(list_max(list_transform(list_filter(regexp_extract_all(t, '<<([\\s\\S]*?)>>', 1),
                                lambda x: contains(x, '/Type') AND contains(x, '/Pages') AND contains(x, '/Count')),
                                lambda x: TRY_CAST(regexp_extract(x, '/Count\\s+(\\d+)', 1) AS INTEGER))),
                            NULLIF(len(regexp_extract_all(t, '/Type\\s*/Page\\b')), 0)) AS pages FROM texts),
why AS (SELECT *, CASE WHEN length = 0 THEN 'The file is empty.'
             WHEN file_type IS NULL THEN 'Files of type ' || CASE WHEN extension = '' THEN 'unknown' ELSE extension END || ' are not accepted, only PDF, PNG and JPEG.'
             WHEN file_type = 'pdf' AND length < 32 THEN 'Unreadable PDF: shorter than any PDF'
             WHEN file_type = 'pdf' AND t = '' THEN 'Unreadable PDF: no PDF header'
             WHEN file_type = 'pdf' AND pages IS NULL THEN 'Unreadable PDF: no page objects'
             WHEN file_type = 'pdf' AND pages <= 0 THEN 'The PDF has no pages.'
             WHEN file_type = 'pdf' AND pages > 3 THEN 'The PDF has ' || pages || ' pages, 3 are allowed.'
             WHEN file_type = 'png' AND NOT starts_with(h, '89504E470D0A1A0A') THEN 'Unreadable image: no PNG signature'
             WHEN file_type = 'png' AND NOT ends_with(h, '49454E44') THEN 'Unreadable image: no IEND chunk'
             WHEN file_type = 'jpeg' AND NOT starts_with(h, 'FFD8') THEN 'Unreadable image: no JPEG start marker'
             WHEN file_type = 'jpeg' AND NOT ends_with(h, 'FFD9') THEN 'Unreadable image: no JPEG end marker' END AS error FROM counted),
triaged AS (SELECT doc_id, name, extension, file_type, error IS NULL AS is_valid,
                   CASE WHEN file_type = 'pdf' AND t <> '' AND length > 0 THEN CAST(pages AS INTEGER) END AS page_count, COALESCE(error, '') AS error FROM why)"""
)
sql("triage_type", "fx_files")("SELECT doc_id, name, extension, file_type FROM facts", FILE_FACTS.strip())
sql("triage_reject", "fx_files")(
    "SELECT doc_id, name, file_type, error FROM triaged WHERE error LIKE 'The file is empty%' OR error LIKE 'Files of type%'", TRIAGED
)
_SHOWN_FILES = "SELECT doc_id, name, file_type, is_valid, page_count, error FROM triaged"
sql("triage_pdf", "fx_files")(_SHOWN_FILES + " WHERE file_type = 'pdf'", TRIAGED)
sql("triage_image", "fx_files")(_SHOWN_FILES + " WHERE file_type IN ('png', 'jpeg')", TRIAGED)
sql("triage_prefilter", "fx_files")(
    "SELECT doc_id, name, length FROM facts WHERE extension IN ('.pdf', '.png', '.jpg', '.jpeg') AND length BETWEEN 1 AND 4000", FILE_FACTS.strip()
)

# --- attempts --------------------------------------------------------------------------------------------------------

LADDER = "ladder AS (SELECT * FROM (VALUES ('beta', 1), ('alpha', 2), ('gamma-lite', 3)) v(model, rank))"


def _phrases(words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(e, '{w}')" for w in words) + ")"


def _attempt_sql() -> str:
    from ledgerline.operators.attempts import NOT_FOUND_PHRASES, QUOTA_PHRASES, TRANSIENT_PHRASES  # fixed phrases

    return f"""
SELECT request_id, model, attempt, error_class,
       CASE WHEN error_class = 'ok' THEN 'done' WHEN error_class = 'transient' AND attempt < 3 THEN 'retry' WHEN error_class = 'fatal' THEN 'raise' ELSE 'next_model' END AS action,
       CASE WHEN error_class = 'transient' AND attempt < 3 THEN CAST(CASE WHEN asked > 0 THEN least(asked + 2, 15) ELSE 3 * attempt END AS DOUBLE) END AS wait_s
FROM (SELECT *, lower(COALESCE(error, '')) AS e, COALESCE(TRY_CAST(regexp_extract(e, 'retry in (\\d+(\\.\\d+)?)s', 1) AS DOUBLE), 0) AS asked,
             CASE WHEN ok THEN 'ok' WHEN COALESCE(code = 404, FALSE) OR {_phrases(NOT_FOUND_PHRASES)} THEN 'not_found'
                  WHEN COALESCE(code = 429, FALSE) OR {_phrases(QUOTA_PHRASES)} THEN 'quota' WHEN asked > 10 AND rank < 3 THEN 'long_wait'
                  WHEN COALESCE(code IN (500, 502, 503, 504), FALSE) OR {_phrases(TRANSIENT_PHRASES)} THEN 'transient' ELSE 'fatal' END AS error_class
      FROM fx_attempts JOIN ladder USING (model)) t"""


sql("classify_attempts", "fx_attempts")(_attempt_sql(), LADDER)
sql("resolve_attempts", "fx_attempts")(
    """SELECT request_id, first(model ORDER BY rank, attempt) FILTER (WHERE ok) AS model, bool_or(ok) AS answered,
              CAST(min(rank) FILTER (WHERE ok) AS INTEGER) AS model_rank, CAST(first(attempt ORDER BY rank, attempt) FILTER (WHERE ok) AS INTEGER) AS winning_attempt,
              count(*) FILTER (WHERE NOT ok) AS n_failed, count(*) AS n_attempts
       FROM fx_attempts JOIN ladder USING (model) GROUP BY request_id""",
    LADDER,
)

# --- status and store ------------------------------------------------------------------------------------------------

# Every stage's own verdict side by side, joined by document; the checks are those of the type the response is checked as.
OUTCOMES = f"""
typed AS (SELECT r.*, CASE WHEN clean = '' THEN 'empty response' WHEN extraction_status = 'PARTIAL' THEN 'schema error' WHEN body IS NOT NULL THEN NULL
                           WHEN TRY_CAST(clean AS JSON) IS NULL THEN 'invalid JSON' ELSE 'not an object' END AS reason,
                 CASE WHEN extraction_status = 'PARTIAL' AND lower(json_extract_string(data, '$.statement_type')) IN ('invoice', 'balance_sheet', 'profit_and_loss', 'cash_flow_statement')
                      THEN lower(json_extract_string(data, '$.statement_type')) ELSE document_type END AS own_type FROM results r),
evidence AS (SELECT p.doc_id, count(*) AS n FROM parsed p, json_each(p.body, '$.evidence') e
             WHERE p.body IS NOT NULL AND json_exists(p.body, '$.evidence') AND e.type = 'OBJECT' GROUP BY p.doc_id),
judgement AS (SELECT doc_id, document_type AS own_type, count(*) AS n, count(*) FILTER (WHERE status = 'PASS') AS p, count(*) FILTER (WHERE status = 'FAILED') AS f,
                     count(*) FILTER (WHERE status = 'NOT_APPLICABLE') AS na FROM ({ALL_CHECKS}) c GROUP BY ALL),
told AS (SELECT doc_id, 'file' AS stage, 'error' AS severity, 0 AS position, error AS message FROM triaged WHERE error <> ''
         UNION ALL SELECT doc_id, 'text', 'error', page_number, 'Page ' || page_number || ': ' || ocr_error FROM fx_pages WHERE ocr_error IS NOT NULL
         UNION ALL SELECT doc_id, 'text', 'warning', page_number, 'Page ' || page_number || CASE route WHEN 'scanned' THEN ': no text, read from its image.'
                   WHEN 'rasterized' THEN ': neither text nor image, rendered for recognition.' ELSE ': nothing to read.' END FROM routed WHERE route <> 'digital'
         UNION ALL SELECT doc_id, 'extraction', CASE WHEN extraction_status = 'FAILED' THEN 'error' ELSE 'warning' END, 0, reason FROM typed WHERE reason IS NOT NULL),
outcome AS (
  SELECT t.doc_id, t.is_valid AS is_stored,
         CASE WHEN NOT t.is_valid THEN 'file' WHEN NOT COALESCE(x.has_text, FALSE) THEN 'text' WHEN COALESCE(r.extraction_status, 'FAILED') = 'FAILED' THEN 'extraction' ELSE 'checks' END AS last_stage,
         x.extraction_status AS text_status, x.n_pages, COALESCE(v.n, 0) AS n_evidence, COALESCE(j.n, 0) AS n, COALESCE(j.p, 0) AS p, COALESCE(j.f, 0) AS f, COALESCE(j.na, 0) AS na
  FROM triaged t LEFT JOIN ({TEXT_STATUS}) x USING (doc_id) LEFT JOIN typed r USING (doc_id) LEFT JOIN evidence v USING (doc_id)
  LEFT JOIN judgement j ON j.doc_id = r.doc_id AND j.own_type = r.own_type)"""
_OUTCOME_VIEWS = ("fx_files", "fx_pages", "fx_responses", *_ALL_VIEWS)
_OUTCOME_CTES = ",".join([TRIAGED, RESULTS, ALL_CTES, ROUTED.strip(), OUTCOMES.strip()])
sql("processing_status", *_OUTCOME_VIEWS)(
    """SELECT doc_id, CASE last_stage WHEN 'file' THEN 'VALIDATION_FAILED' WHEN 'checks' THEN CASE WHEN f = 0 THEN 'COMPLETED' ELSE 'VALIDATION_FAILED' END
                     ELSE 'EXTRACTION_FAILED' END AS processing_status, last_stage, is_stored FROM outcome""",
    _OUTCOME_CTES,
)
sql("document_metadata", *_OUTCOME_VIEWS)(
    """SELECT doc_id, last_stage, CASE WHEN done THEN n_pages END AS page_count, CASE WHEN done THEN n_evidence END AS evidence_count, CASE WHEN done THEN o.n END AS total_checks,
              CASE WHEN done THEN p END AS passed_checks, CASE WHEN done THEN f END AS failed_checks, CASE WHEN done THEN na END AS not_applicable_checks, CASE WHEN done THEN f = 0 END AS is_valid,
              CASE last_stage WHEN 'text' THEN COALESCE(text_status, 'FAILED') WHEN 'extraction' THEN 'FAILED' END AS extraction_status,
              CASE WHEN NOT done THEN COALESCE(e.n, 0) END AS n_errors, CASE WHEN NOT done THEN COALESCE(w.n, 0) END AS n_warnings
       FROM (SELECT *, last_stage = 'checks' AS done, last_stage AS stage FROM outcome WHERE is_stored) o
       LEFT JOIN (SELECT doc_id, stage, count(*) AS n FROM told WHERE severity = 'error' GROUP BY ALL) e USING (doc_id, stage)
       LEFT JOIN (SELECT doc_id, stage, count(*) AS n FROM told WHERE severity = 'warning' GROUP BY ALL) w USING (doc_id, stage)""",
    _OUTCOME_CTES,
)
_TOLD = "SELECT doc_id, {}severity, CAST(position // 1000 AS BIGINT) AS piece, count(*) AS n_messages, string_agg(message, '; ' ORDER BY position) AS messages FROM told {} GROUP BY ALL"
sql("stage_messages", *_OUTCOME_VIEWS)(_TOLD.format("stage, ", ""), _OUTCOME_CTES)
sql("extraction_messages", *_OUTCOME_VIEWS)(_TOLD.format("", "WHERE stage = 'text'"), _OUTCOME_CTES)
sql("list_documents", "fx_stored")(
    """SELECT id, document_name, document_type, processing_status, created_at FROM fx_stored
       WHERE document_type = 'invoice' AND processing_status = 'COMPLETED' ORDER BY created_at DESC, id DESC LIMIT 50 OFFSET 20"""
)
sql("document_by_name", "fx_stored")("SELECT * FROM fx_stored WHERE document_name = 'statement-7.pdf' ORDER BY created_at DESC, id DESC LIMIT 1")
sql("document_by_id", "fx_stored")("SELECT * FROM fx_stored WHERE id = 42")
sql("latest_documents", "fx_stored")(
    "SELECT * FROM fx_stored QUALIFY ROW_NUMBER() OVER (PARTITION BY document_name ORDER BY created_at DESC, id DESC) = 1"
)
sql("store_append", "fx_stored")("SELECT id, document_name, document_type, processing_status, created_at FROM fx_stored")

sql("store_lookup", "fx_stored")(
    """SELECT *, 'id' AS found_by FROM fx_stored WHERE id = 42
       UNION ALL (SELECT *, 'name' FROM fx_stored WHERE document_name = 'statement-7.pdf' ORDER BY created_at DESC, id DESC LIMIT 1)"""
)


def build() -> dict[str, str]:
    return dict(ORACLE)
