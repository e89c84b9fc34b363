"""Invoice rules: line arithmetic, subtotal, total and tax."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerline.functions.checks import Rule, emit_checks, finish, missing
from ledgerline.functions.numeric import DEFAULT_TOLERANCE, amount, exact_sum, normalize_rates, round_to
from ledgerline.operators.discounts import resolve_line_discount
from ledgerline.operators import taxes as tax
from ledgerline.operators.fields import ROUND_OFF_KEYS, round_off_rank
from ledgerline.session import compiled_methods

TYPE = "invoice"

# Accepted pricing_type words, phrases that mark tax-inclusive prices, and the formula texts.
INCLUSIVE_WORDS = ["tax_inclusive", "inclusive", "gross"]
EXCLUSIVE_WORDS = ["tax_exclusive", "exclusive", "net"]
INCLUSIVE_PHRASES = "inclusive of tax|tax inclusive|vat inclusive|all taxes included"
LINE_PLAIN = "quantity * unit_price == total_price"
LINE_PERCENT = "quantity * unit_price * (1 - discount_percent / 100) == total_price"
LINE_AMOUNT = "quantity * unit_price - discount_amount == total_price"
LINE_UNIT_AMOUNT = "quantity * (unit_price - discount_amount) == total_price"
SUBTOTAL_NET = "sum(line_items.total_price) == subtotal"
SUBTOTAL_GROSS = "sum(line_items.total_price) == total_amount (tax-inclusive)"
TOTAL_NET = "subtotal + tax_amount - discount_amount + shipping_amount == total_amount"
TOTAL_NET_ROUNDED = "subtotal + tax_amount - discount_amount + shipping_amount + round_off_amount == total_amount"
TOTAL_GROSS = "subtotal + shipping_amount == total_amount (tax-inclusive)"
TOTAL_GROSS_ROUNDED = "subtotal + shipping_amount + round_off_amount == total_amount (tax-inclusive)"
TAX_RATE = "subtotal * tax_rate == tax_amount"
TAX_GROSS = "total_amount * tax_rate / (1 + tax_rate) == tax_amount (tax-inclusive)"
TAX_ZERO = "tax_amount == 0 (tax-exempt / zero-rated)"

INCLUSIVE, EXCLUSIVE = "TAX_INCLUSIVE", "TAX_EXCLUSIVE"


def _or_zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0.0))


def _line_facts(lines: DataFrame, tolerance: float, from_text: bool) -> tuple[DataFrame, list[Column]]:
    """The lines with their discount, and what a document's row needs of each of them."""
    inclusive = F.col("is_tax_inclusive") if "is_tax_inclusive" in lines.columns else F.lit(False)
    df = resolve_line_discount(lines, tolerance, from_text)
    return df, [amount(lines, "total_price").alias("own_total"), inclusive.cast("boolean").alias("is_inclusive"), F.col("has_discount")]


def _line_aggregates() -> list[Column]:
    return [
        F.count_if(F.col("kind") == 1).alias("n_lines"),
        F.count("own_total").alias("n_totals"),
        exact_sum(F.col("own_total")).alias("total_sum"),
        F.bool_or("is_inclusive").alias("any_inclusive"),
        F.bool_or("has_discount").alias("any_discount"),
    ]


def _with_line_sum(df: DataFrame) -> DataFrame:
    """``line_sum`` reads ``total_price`` alone, and is null unless every line has one."""
    no = F.lit(False)
    return df.withColumns(
        {
            "line_sum": F.when((F.col("n_lines") > 0) & (F.col("n_lines") == F.col("n_totals")), round_to(F.col("total_sum"), 4)),
            "any_inclusive": F.coalesce("any_inclusive", no),
            "any_discount": F.coalesce("any_discount", no),
        }
    ).drop("total_sum")


def line_stats(lines: DataFrame, tolerance: float = DEFAULT_TOLERANCE, from_text: bool = True) -> DataFrame:
    """Per-document sums over the lines, combined map-side: one narrow row per document crosses the network."""
    df, facts = _line_facts(lines, tolerance, from_text)
    return _with_line_sum(df.select("doc_id", F.lit(1).alias("kind"), *facts).groupBy("doc_id").agg(*_line_aggregates()))


def missing_line_totals(lines: DataFrame) -> DataFrame:
    """The lines whose total is missing, one row each, with the field name a check reports for them."""
    return lines.where(amount(lines, "total_price").isNull()).select(
        "doc_id", "line_no", F.format_string("line_items[%d].total_price", F.col("line_no")).alias("missing_field")
    )


def _first_present(df: DataFrame, *names: str) -> Column:
    """Amount of the first column that holds a value; zero is a value."""
    present = [n for n in names if n in df.columns]
    if not present:
        return F.lit(None).cast("double")
    chosen = amount(df, present[-1])
    for name in reversed(present[:-1]):
        chosen = F.when(F.col(name).isNotNull(), amount(df, name)).otherwise(chosen)
    return chosen


HEADER_AMOUNTS = ["subtotal", "tax_amount", "tax_rate", "discount_amount", "shipping_amount", "total_amount", "round_off_amount"]


def _header_facts(headers: DataFrame) -> DataFrame:
    text = F.col("pricing_type") if "pricing_type" in headers.columns else F.lit(None).cast("string")
    direct_round_off = F.coalesce(*[amount(headers, key) for key in ROUND_OFF_KEYS])
    if "tax_rate" in headers.columns:
        headers = normalize_rates(headers, ["tax_rate"])
    word = F.lower(F.trim(text))
    return headers.select(
        "doc_id",
        F.lit(0).alias("kind"),
        _first_present(headers, "subtotal", "taxable_amount", "taxable_value").alias("subtotal"),
        _first_present(headers, "tax_amount", "tax").alias("tax_amount"),
        amount(headers, "tax_rate").alias("tax_rate"),
        amount(headers, "discount_amount").alias("discount_amount"),
        amount(headers, "shipping_amount").alias("shipping_amount"),
        _first_present(headers, "total_amount", "total").alias("total_amount"),
        direct_round_off.alias("round_off_amount"),
        F.when(word.isin(INCLUSIVE_WORDS), True).when(word.isin(EXCLUSIVE_WORDS), False).alias("stated_inclusive"),
    )


def _field_facts(extra: DataFrame) -> DataFrame:
    """What the rules read of a field: a rounding adjustment, a component, or a phrase; other fields stay behind."""
    phrase = (F.col("source") == 1) & F.lower(F.concat_ws(" ~ ", "key", "text")).rlike(INCLUSIVE_PHRASES)
    facts = {"off_rank": round_off_rank(), "is_phrase": phrase, **tax.field_facts()}
    # Only keys decide here: a condition on parsed amounts would be evaluated once more for every use.
    wanted = extra.where(F.col("key_norm").isin(ROUND_OFF_KEYS + tax.FIELD_KEYS) | phrase)
    return wanted.withColumns(facts).select("doc_id", F.lit(2).alias("kind"), "num", "rate", *facts)


def invoice_inputs(
    headers: DataFrame, lines: DataFrame | None, extra: DataFrame | None = None, tolerance: float = DEFAULT_TOLERANCE,
    from_text: bool = True, components: DataFrame | None = None, taxes: bool = False,
) -> DataFrame:
    """One row per invoice with every amount the rules read, the line sums and the pricing model; doc_id is a header's key.

    Headers, fields, structured components and lines are put under one another and meet in one aggregation by document, which
    combines map-side and needs the only exchange. With ``taxes`` the row also has the components (``parts``): then the
    lines come in after the rates are known, see ``taxes.meet_lines``.
    """
    late = taxes and not (extra is None and components is None)
    rows = _header_facts(compiled_methods(headers))
    known = [F.max(c).alias(c) for c in HEADER_AMOUNTS] + [F.bool_or("stated_inclusive").alias("stated_inclusive"), F.bool_or(F.col("kind") == 0).alias("_is_invoice")]
    if extra is not None:
        rows = rows.unionByName(_field_facts(extra), allowMissingColumns=True)
        known += [F.min_by("num", "off_rank").alias("_field_off"), F.bool_or("is_phrase").alias("any_phrase")]
        known += tax.field_aggregates() if late else []
    if late and components is not None:
        entry = F.struct("pos", "name", "rate", "amount")
        rows = rows.unionByName(components.select("doc_id", F.lit(3).alias("kind"), entry.alias("entry")), allowMissingColumns=True)
        known += [F.collect_list("entry").alias("entries")]
    if lines is not None:
        df, facts = _line_facts(lines, tolerance, from_text)
        if not late:
            rows = rows.unionByName(df.select("doc_id", F.lit(1).alias("kind"), *facts), allowMissingColumns=True)
            known += _line_aggregates()
    docs = rows.groupBy("doc_id").agg(*known).where("_is_invoice").drop("_is_invoice")
    if late:
        own = tax.field_parts() if extra is not None else F.array().cast(tax.PARTS)
        docs = docs.withColumn("parts", tax.merged_parts(own, tax.structured_parts()) if components is not None else own)
        docs = docs.drop(*[c for c in docs.columns if c.startswith(("_stated_", "_percent_", "_amount_")) or c == "entries"])
        docs = tax.with_readings(tax.gst_rates(docs, tolerance), tolerance)
        if lines is not None:
            docs = tax.meet_lines(docs, df.select("doc_id", *[c for c in ("line_no",) if c in df.columns], *facts))
            docs = tax.with_readings(docs, tolerance).drop("open_rates")
    zero, no, null = F.lit(0).cast("bigint"), F.lit(False), F.lit(None)
    if lines is None:
        docs = docs.withColumns({"n_lines": zero, "n_totals": zero, "total_sum": null.cast("double"), "any_inclusive": no, "any_discount": no})
        docs = docs.withColumn("line_taxes", F.array().cast("array<struct<no:int,tax:decimal(38,6),whole:boolean>>")) if late else docs
    docs = _with_line_sum(docs.withColumns({"n_lines": F.coalesce("n_lines", zero), "n_totals": F.coalesce("n_totals", zero)}))
    if extra is not None:
        docs = docs.withColumns({"round_off_amount": F.coalesce("round_off_amount", "_field_off"), "any_phrase": F.coalesce("any_phrase", no)}).drop("_field_off")
    else:
        docs = docs.withColumn("any_phrase", no)
    if late:
        docs = tax.resolve_parts(docs, tolerance)
    elif taxes:
        docs = docs.withColumns(
            {"n_components": F.lit(0), "component_sum": null.cast("double"), "component_formula": null.cast("string"), "any_amountless": no}
        )
    return docs.withColumn("pricing_model", pricing_model(tolerance))


def pricing_model(tolerance: float = DEFAULT_TOLERANCE) -> Column:
    """Whether printed prices include tax: stated, marked on a line, said in the extra fields, or shown by arithmetic."""
    reaches_total = (
        F.abs(F.col("line_sum") + _or_zero("shipping_amount") + _or_zero("round_off_amount") - F.col("total_amount"))
        <= tolerance
    )
    meets_subtotal = F.coalesce(F.abs(F.col("line_sum") - F.col("subtotal")) <= tolerance, F.lit(False))
    return (
        F.when(F.col("stated_inclusive"), INCLUSIVE)
        .when(~F.col("stated_inclusive"), EXCLUSIVE)
        .when(F.col("any_inclusive") | F.col("any_phrase"), INCLUSIVE)
        .when((F.col("tax_amount") > 0) & reaches_total & ~meets_subtotal, INCLUSIVE)
        .otherwise(EXCLUSIVE)
    )


def invoice_line_checks(
    lines: DataFrame, tolerance: float = DEFAULT_TOLERANCE, from_text: bool = True
) -> DataFrame:
    """One arithmetic check per line; a projection of the lines without any exchange."""
    q, p, t, d = F.col("_q"), F.col("_p"), F.col("_t"), F.col("discount_value")
    kind = F.col("discount_kind")
    df = resolve_line_discount(lines, tolerance, from_text)
    df = df.withColumns(
        {
            "_raw": F.when(kind == "PERCENT", q * p * (1.0 - d / 100.0)).when(kind == "AMOUNT", q * p - d).otherwise(q * p),
            "_whole": round_to(q * p, 2),
            "_unit_raw": q * (p - d),
        }
    )
    df = df.withColumns(
        {
            "_exact": round_to(F.col("_raw"), 4),
            "_cut": round_to(F.col("_whole") * (d / 100.0), 2),
            "_per_unit": round_to(F.col("_unit_raw"), 4),
        }
    )
    df = df.withColumn(
        "_other",
        F.when(kind == "PERCENT", round_to(F.col("_whole") - F.col("_cut"), 2)).when(kind == "AMOUNT", F.col("_per_unit")),
    )
    nearer = F.abs(F.col("_other") - t) < F.abs(F.col("_exact") - t)
    use_other = F.coalesce(
        F.when(kind == "PERCENT", nearer).when(kind == "AMOUNT", nearer & (F.abs(F.col("_other") - t) <= tolerance)),
        F.lit(False),
    )
    df = df.withColumn("_use_other", use_other).select(
        "doc_id",
        F.lit(TYPE).alias("document_type"),
        F.lit(1).alias("rule_order"),
        F.col("line_no").cast("bigint").alias("line_no"),
        F.concat(F.lit("invoice_line_item_"), F.col("line_no").cast("string"), F.lit("_math")).alias("rule_name"),
        F.when((q.isNull() | p.isNull() | t.isNull()) | kind.isNull(), LINE_PLAIN)
        .when(kind == "PERCENT", LINE_PERCENT)
        .when(F.col("_use_other"), LINE_UNIT_AMOUNT)
        .otherwise(LINE_AMOUNT)
        .alias("formula"),
        F.create_map(
            F.lit("quantity"), q, F.lit("unit_price"), p, F.lit("total_price"), t,
            F.lit("discount_percent"), F.when(kind == "PERCENT", d), F.lit("discount_amount"), F.when(kind == "AMOUNT", d),
        ).alias("input_values"),
        F.when(F.col("_use_other"), F.col("_other")).otherwise(F.col("_exact")).alias("_calculated"),
        t.alias("reported_value"),
        F.lit(None).cast("double").alias("_variance"),
        missing(quantity=q, unit_price=p, total_price=t).alias("_lacking"),
        F.lit(False).alias("_blocked"),
    )
    return finish(df, tolerance)


def no_lines_rule(tolerance: float) -> Rule:
    """The single not-applicable line check of an invoice without lines."""
    null = F.lit(None).cast("double")
    return Rule(1, "invoice_line_item_math", LINE_PLAIN, null, null, F.lit("line_items"), emit=F.col("n_lines") == 0)


def _prepared(inputs: DataFrame, tolerance: float) -> DataFrame:
    """Intermediate amounts of the document rules as columns, each computed once."""
    subtotal, total, tax_rate = F.col("subtotal"), F.col("total_amount"), F.col("tax_rate")
    plus = subtotal + _or_zero("tax_amount") + _or_zero("shipping_amount") + _or_zero("round_off_amount")
    minus = (
        subtotal + _or_zero("tax_amount") - _or_zero("discount_amount") + _or_zero("shipping_amount")
        + _or_zero("round_off_amount")
    )
    base = F.coalesce(subtotal, F.nullif(F.col("line_sum"), F.lit(0.0)), total)
    tax_base = F.coalesce(total, _or_zero("subtotal") + _or_zero("tax_amount"))
    zero = F.coalesce(F.col("tax_amount") == 0.0, F.lit(False)) | F.coalesce(tax_rate == 0.0, F.lit(False))
    df = inputs.withColumns(
        {
            "_incl": F.col("pricing_model") == INCLUSIVE,
            "_plus": plus,
            "_minus": minus,
            "_gross_base": base + _or_zero("shipping_amount") + _or_zero("round_off_amount"),
            "_gross_tax": tax_base * (tax_rate / (1.0 + tax_rate)),
            "_zero_tax": zero,
            "_rate_tax": subtotal * tax_rate,
            "_rounded": F.col("round_off_amount").isNotNull(),
        }
    )
    meets_total = F.abs(F.col("line_sum") - _or_zero("total_amount")) <= tolerance
    return df.withColumns(
        {
            "_without": round_to(F.col("_plus"), 4),
            "_with": round_to(F.col("_minus"), 4),
            "_gross_total": round_to(F.col("_gross_base"), 4),
            "_added_up": F.col("_incl") & F.coalesce(F.abs(F.col("_plus") - total) <= tolerance, F.lit(False)),
            "_to_total": F.coalesce(F.col("_incl") & (subtotal.isNull() | meets_total), F.lit(False)),
            "_gross_tax": round_to(F.col("_gross_tax"), 4),
            "_rate_tax": round_to(F.col("_rate_tax"), 4),
            "_by_gross": F.col("_incl") & tax_rate.isNotNull() & (total.isNotNull() | subtotal.isNotNull()),
        }
    )


def subtotal_rule(tolerance: float) -> Rule:
    target = F.when(F.col("_to_total"), F.col("total_amount")).otherwise(F.col("subtotal"))
    lacking = (
        F.when(F.col("n_lines") == 0, "line_items")
        .when(F.col("n_totals") < F.col("n_lines"), "line_items[*].total_price")
        .when(F.col("subtotal").isNull() & ~F.col("_incl"), "subtotal")
        .otherwise("")
    )
    return Rule(
        2,
        "invoice_line_items_subtotal_reconciliation",
        F.when((lacking == "") & F.col("_to_total"), SUBTOTAL_GROSS).otherwise(SUBTOTAL_NET),
        F.col("line_sum"),
        F.when(lacking == "", target).otherwise(F.col("subtotal")),
        lacking,
        {"subtotal": F.col("subtotal"), "line_item_count": F.col("n_lines")},
        variance=F.when(target.isNull(), F.lit(0.0)),
    )


def total_rule(tolerance: float) -> Rule:
    subtotal, total, inclusive, rounded = F.col("subtotal"), F.col("total_amount"), F.col("_incl"), F.col("_rounded")
    already_in_lines = (
        F.col("any_discount")
        & (F.col("discount_amount") > 0)
        & (F.abs(F.col("_without") - total) <= tolerance)
        & (F.abs(F.col("_with") - total) > tolerance)
    )
    not_given = total.isNull() | (subtotal.isNull() & ~inclusive)
    gross_formula = F.concat(
        F.lit("subtotal + tax_amount"),
        F.when(_or_zero("shipping_amount") != 0, " + shipping_amount").otherwise(""),
        F.when(rounded, " + round_off_amount").otherwise(""),
        F.lit(" == total_amount"),
    )
    return Rule(
        3,
        "invoice_total_reconciliation",
        F.when(not_given, TOTAL_NET)
        .when(F.col("_added_up"), gross_formula)
        .when(inclusive & rounded, TOTAL_GROSS_ROUNDED)
        .when(inclusive, TOTAL_GROSS)
        .when(rounded, TOTAL_NET_ROUNDED)
        .otherwise(TOTAL_NET),
        F.when(F.col("_added_up"), F.col("_without"))
        .when(inclusive, F.col("_gross_total"))
        .when(already_in_lines, F.col("_without"))
        .otherwise(F.col("_with")),
        total,
        F.when(not_given, missing(subtotal=subtotal, total_amount=total)).otherwise(""),
        {
            "subtotal": subtotal,
            "tax_amount": F.col("tax_amount"),
            "discount_amount": F.col("discount_amount"),
            "shipping_amount": F.col("shipping_amount"),
            "total_amount": total,
            "round_off_amount": F.col("round_off_amount"),
        },
    )


def tax_rule(tolerance: float) -> Rule:
    """Components first, then zero tax, then the inclusive form, then rate times subtotal; otherwise no check."""
    subtotal, tax, tax_rate, total = F.col("subtotal"), F.col("tax_amount"), F.col("tax_rate"), F.col("total_amount")
    parts, zero, gross = F.coalesce(F.col("n_components"), F.lit(0)) > 0, F.col("_zero_tax"), F.col("_by_gross")
    by_rate = tax_rate.isNotNull() | (tax.isNotNull() & subtotal.isNotNull())
    part_lacking = F.concat_ws(
        ", ",
        F.when(tax.isNull(), "tax_amount"),
        F.when(subtotal.isNull() & F.coalesce(F.col("any_amountless"), F.lit(False)), "subtotal"),
    )
    return Rule(
        4,
        "invoice_tax_calculation",
        F.when(parts, F.col("component_formula")).when(zero, TAX_ZERO).when(gross, TAX_GROSS).otherwise(TAX_RATE),
        F.when(parts, F.col("component_sum"))
        .when(zero, F.lit(0.0))
        .when(gross, F.col("_gross_tax"))
        .otherwise(F.col("_rate_tax")),
        F.when(~parts & zero, _or_zero("tax_amount")).otherwise(tax),
        F.when(parts, part_lacking).when(zero | gross, "").otherwise(missing(subtotal=subtotal, tax_rate=tax_rate, tax_amount=tax)),
        {"subtotal": subtotal, "tax_rate": tax_rate, "tax_amount": tax, "total_amount": total},
        variance=F.when(parts, F.lit(None).cast("double"))
        .when(zero, F.lit(0.0))
        .when(gross, round_to(F.col("_gross_tax") - _or_zero("tax_amount"), 4)),
        emit=parts | zero | gross | by_rate,
    )


def invoice_header_checks(inputs: DataFrame, tolerance: float = DEFAULT_TOLERANCE, only: list[int] | None = None) -> DataFrame:
    """No lines (1), subtotal (2), total (3) and tax (4) checks of each invoice in one pass over its input row."""
    rules = {1: no_lines_rule, 2: subtotal_rule, 3: total_rule, 4: tax_rule}
    wanted = [rule(tolerance) for order, rule in rules.items() if only is None or order in only]
    return emit_checks(_prepared(inputs, tolerance), TYPE, wanted, tolerance)


def invoice_checks(
    headers: DataFrame, lines: DataFrame, extra: DataFrame | None = None, components: DataFrame | None = None,
    tolerance: float = DEFAULT_TOLERANCE, from_text: bool = True,
) -> DataFrame:
    """All invoice checks: one per line, then those of the document."""
    inputs = invoice_inputs(headers, lines, extra, tolerance, from_text, components, taxes=True)
    return invoice_line_checks(lines, tolerance, from_text).unionByName(invoice_header_checks(inputs, tolerance))
