"""Raw extraction responses to typed headers, lines, fields, tax components and evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerline.functions.json_values import (
    amount_of,
    as_double,
    as_text,
    first_truthy_value,
    get,
    is_array,
    is_number,
    is_object,
    is_present,
    is_string,
    says_percent,
    strict_double,
    truthy,
    type_of,
)
from ledgerline.functions.numeric import rate_of_amount, strip
from ledgerline.operators.fields import with_field_values
from ledgerline.operators.taxes import NAMES as TAX_NAMES
from ledgerline.session import compiled_methods

# The fields of each document type as name -> accepted names in priority order.
TYPES = ["invoice", "balance_sheet", "profit_and_loss", "cash_flow_statement"]
_PLAIN = lambda names: {n: [n] for n in names.split()}
TEXT_FIELDS = {
    "invoice": _PLAIN(
        "invoice_number invoice_date due_date purchase_order_number vendor_name vendor_address vendor_tax_id "
        "customer_name customer_address pricing_type discount_scope currency payment_terms"
    ),
    "balance_sheet": _PLAIN("company_name statement_date reporting_period currency"),
    "profit_and_loss": _PLAIN("company_name reporting_period period_start_date period_end_date currency"),
    "cash_flow_statement": _PLAIN("company_name reporting_period period_start_date period_end_date currency"),
}
NUMBER_FIELDS = {
    "invoice": {
        **_PLAIN("subtotal taxable_amount tax_amount tax_rate discount_amount shipping_amount"),
        "round_off_amount": ["round_off_amount", "round_off", "rounding"],
        "total_amount": ["total_amount"],
    },
    "balance_sheet": {
        **_PLAIN(
            "current_assets non_current_assets total_assets current_liabilities non_current_liabilities "
            "total_liabilities retained_earnings"
        ),
        "share_capital": ["share_capital", "capital", "equity_capital"],
        "total_equity": ["total_equity"],
        "total_liabilities_and_equity": [
            "total_liabilities_and_equity",
            "total_capital_and_liabilities",
            "total_equity_and_liabilities",
            "total_capital_liabilities",
        ],
    },
    "profit_and_loss": _PLAIN(
        "total_revenue cost_of_goods_sold gross_profit operating_expenses operating_income interest_expense tax_expense "
        "net_income"
    ),
    "cash_flow_statement": _PLAIN(
        "net_cash_from_operating_activities net_cash_from_investing_activities net_cash_from_financing_activities "
        "net_change_in_cash beginning_cash_balance ending_cash_balance"
    ),
}
# Names that stand for one amount in payloads that did not fit, and whether a name counts once it is written
# (given) or only if it is neither empty nor zero (filled).
LOOSE_CHAINS = {
    "invoice": [
        ("given", ["subtotal", "taxable_amount", "taxable_value"]),
        ("given", ["tax_amount", "tax"]),
        ("given", ["total_amount", "total"]),
    ],
    "balance_sheet": [
        (
            "filled",
            [
                "total_liabilities_and_equity",
                "total_capital_and_liabilities",
                "total_equity_and_liabilities",
                "total_capital_liabilities",
            ],
        ),
        ("filled", ["share_capital", "capital"]),
    ],
}
LINE_TEXT = {"invoice": _PLAIN("description item_code source_snippet"), "statement": _PLAIN("item_name category source_snippet")}
LINE_NUMBER = {
    "invoice": {
        **_PLAIN("quantity unit_price"),
        "discount_percent": ["discount_percent", "discount_pct", "discount_rate"],
        "discount_amount": ["discount_amount", "discount_value", "discount"],
        **_PLAIN("tax_rate tax_amount total_price"),
        "gross_amount": ["gross_amount", "gross_total", "gross_worth"],
        "page_number": ["page_number"],
    },
    "statement": _PLAIN("amount page_number"),
}
# Names the rules also accept in payloads that did not fit the typed fields.
LOOSE_NUMBERS = {
    "invoice": ["taxable_value", "tax", "total"],
    "balance_sheet": ["total_capital_and_liabilities", "total_equity_and_liabilities", "total_capital_liabilities", "capital"],
    "profit_and_loss": ["total_expenditure"],
    "cash_flow_statement": ["effect_of_exchange_rate_changes", "exchange_rate_effect"],
}
BALANCE_KEYS = ["total_assets", "total_capital_and_liabilities", "current_assets"]
INVOICE_KEYS = ["subtotal", "tax_rate", "tax_amount", "vendor_name"]

SUCCESS, PARTIAL, FAILED = "SUCCESS", "PARTIAL", "FAILED"


def strip_fences(text: Column) -> Column:
    """Drop a leading ```json or ``` and a trailing ``` around a response."""
    bare = strip(text)
    return strip(F.regexp_replace(F.regexp_replace(bare, r"^```(?:json)?", ""), r"```$", ""))


def parse_responses(responses: DataFrame) -> DataFrame:
    """Responses as objects: doc_id, document_type, clean text, ``body`` and ``data`` VARIANT, error.

    ``data`` is the enclosed extracted_data when that holds anything, else the whole object. The text is parsed once. Of
    a key that an object repeats the last value counts; the session is set to accept such objects.
    """
    responses.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    df = compiled_methods(responses).select(
        "doc_id", F.lower(strip(F.col("document_type"))).alias("document_type"), strip_fences(F.col("raw")).alias("clean")
    )
    df = df.withColumn("body", F.when(F.col("clean").startswith("{"), F.try_parse_json("clean")))
    df = df.withColumns({"_inner": get(F.col("body"), "extracted_data"), "_kind": type_of(get(F.col("body"), "extracted_data"))})
    kind = F.col("_kind")
    filled = (
        F.when(kind.rlike("^(OBJECT<.|ARRAY<)"), as_text(F.col("_inner")) != "[]")
        .when(kind == "STRING", as_text(F.col("_inner")) != "")
        .when(kind.rlike("^(VOID|OBJECT)"), F.lit(False))
        .otherwise(as_double(F.col("_inner")) != 0.0)
    )
    error = (
        F.when(F.coalesce(F.col("clean"), F.lit("")) == "", "empty response")
        .when(F.col("body").isNotNull(), None)
        .when(~F.col("clean").startswith("{") & F.try_parse_json("clean").isNotNull(), "not an object")
        .otherwise("invalid JSON")
    )
    df = df.withColumns({"enclosed": F.coalesce(filled, F.lit(False)), "error": error})
    data = F.when(F.col("enclosed"), F.col("_inner")).otherwise(F.col("body"))
    return df.select("doc_id", "document_type", "clean", "body", data.alias("data"), "enclosed", "error")


def _first_key(value: Column, names: list[str]) -> Column:
    """Value of the first name that is present, even if it is null."""
    return F.coalesce(*[get(value, n) for n in names]) if len(names) > 1 else get(value, names[0])


def _bad_number(value: Column) -> Column:
    return is_present(value) & strict_double(value).isNull()


def _bad_flag(value: Column) -> Column:
    """Booleans, 0/1 and the usual yes/no words are flags."""
    words = F.lower(as_text(value)).isin("true", "false", "1", "0", "yes", "no", "on", "off", "t", "f", "y", "n", "1.0", "0.0")
    return is_present(value) & ~F.coalesce(words, F.lit(False))


def _any_of(conditions: list[Column]) -> Column:
    result = conditions[0]
    for condition in conditions[1:]:
        result = result | condition
    return result


def _bad_member(text: dict, numbers: dict, more=lambda key, value: []):
    """Test of one member of an object; fields with several names are tested apart, by their first name present."""
    single = [n[0] for c, n in numbers.items() if len(n) == 1 and c != "page_number"]

    def check(entry: Column) -> Column:
        key, value = entry["key"], entry["value"]
        chain = F.when(key.isin(list(text)), is_present(value) & ~is_string(value)).when(key.isin(single), _bad_number(value))
        if "page_number" in numbers:
            whole = strict_double(value)
            chain = chain.when(key == "page_number", is_present(value) & (whole.isNull() | (whole != F.floor(whole))))
        for condition, test in more(key, value):
            chain = chain.when(condition, test)
        return F.coalesce(chain, F.lit(False))

    return check


def _bad_object(value: Column, text: dict, numbers: dict, more=lambda key, value: []) -> Column:
    entries = F.map_entries(F.try_variant_get(value, "$", "map<string,variant>"))
    bad = F.coalesce(F.exists(entries, _bad_member(text, numbers, more)), F.lit(False))
    for names in numbers.values():
        if len(names) > 1:
            bad = bad | _bad_number(_first_key(value, names))
    return bad


def _bad_line(kind: str):
    def more(key: Column, value: Column) -> list:
        return [(key == "is_tax_inclusive", _bad_flag(value))] if kind == "invoice" else []

    def check(item: Column) -> Column:
        bad = ~is_object(item) | _bad_object(item, LINE_TEXT[kind], LINE_NUMBER[kind], more)
        return bad if kind == "invoice" else bad | ~is_string(get(item, "item_name"))

    return check


def schema_error(data: Column, document_type: Column) -> Column:
    """Whether a payload breaks the typed fields of its document type."""

    def of(kind: str) -> Column:
        line_kind = "invoice" if kind == "invoice" else "statement"
        items = F.try_variant_get(data, "$.line_items", "array<variant>")

        def more(key: Column, value: Column) -> list:
            tests = [(key == "line_items", ~is_array(value)), (key == "additional_fields", ~is_object(value))]
            if kind == "invoice":
                parts = F.try_variant_get(value, "$", "array<variant>")
                tests.append((key == "tax_components", ~is_array(value) | F.exists(parts, lambda p: ~is_object(p))))
            return tests

        return _bad_object(data, TEXT_FIELDS[kind], NUMBER_FIELDS[kind], more) | F.coalesce(
            F.exists(items, _bad_line(line_kind)), F.lit(False)
        )

    chain = None
    for kind in TYPES:
        chain = F.when(document_type == kind, of(kind)) if chain is None else chain.when(document_type == kind, of(kind))
    return chain.otherwise(F.lit(False))


def extraction_result(parsed: DataFrame) -> DataFrame:
    """Add extraction_status and reason; a payload that does not fit its type is kept raw as PARTIAL."""
    broken = ~is_object(F.col("data")) | schema_error(F.col("data"), F.col("document_type"))
    usable = is_object(F.col("data"))
    df = parsed.withColumn("_broken", F.when(F.col("body").isNotNull(), broken))
    known = F.coalesce(F.col("document_type").isin(TYPES), F.lit(False))
    return df.withColumns(
        {
            "extraction_status": F.when(~known | F.col("body").isNull(), FAILED)
            .when(~F.col("_broken"), SUCCESS)
            .when(usable, PARTIAL)
            .otherwise(FAILED),
            "reason": F.when(~known, "unsupported document type")
            .when(F.col("error").isNotNull(), F.col("error"))
            .when(F.col("_broken"), "schema error"),
        }
    ).drop("_broken")


def _typed_number(data: Column, names: list[str]) -> Column:
    return strict_double(data, names[0]) if len(names) == 1 else strict_double(_first_key(data, names))


def project_headers(parsed: DataFrame, document_type: str) -> DataFrame:
    """Typed header of one document type; unknown keys are dropped."""
    data = F.col("data")
    return parsed.where(F.col("document_type") == document_type).select(
        "doc_id",
        *[F.when(is_string(get(data, c)), F.try_variant_get(data, f"$.{c}", "string")).alias(c) for c in TEXT_FIELDS[document_type]],
        *[_typed_number(data, n).alias(c) for c, n in NUMBER_FIELDS[document_type].items()],
    )


def rule_headers(results: DataFrame, document_type: str) -> DataFrame:
    """Header as the rules read it: typed for fitting payloads, loosely parsed names for PARTIAL ones.

    Which of several names counts is decided by what is written there, before the amount is read; all names of such a
    chain then hold its amount.
    """
    data = F.col("data")
    raw = F.col("extraction_status") == PARTIAL
    numbers = {}
    for column, names in NUMBER_FIELDS[document_type].items():
        numbers[column] = F.when(raw, amount_of(data, column)).otherwise(_typed_number(data, names))
    for column in LOOSE_NUMBERS[document_type]:
        numbers[column] = F.when(raw, amount_of(data, column))
    chains = {}
    for number, (kind, names) in enumerate(LOOSE_CHAINS.get(document_type, [])):
        found = [get(data, n) for n in names]
        first = first_truthy_value(*found) if kind == "filled" else F.coalesce(*[F.when(is_present(v), v) for v in found])
        chains[f"_chain_{number}"] = F.when(raw, first)
        for column in names:
            typed = _typed_number(data, NUMBER_FIELDS[document_type][column]) if column in NUMBER_FIELDS[document_type] else F.lit(None)
            numbers[column] = F.when(raw, amount_of(F.col(f"_chain_{number}"))).otherwise(typed)
    text = TEXT_FIELDS[document_type]
    mine = results.where((F.col("checked_type") == document_type) & F.col("extraction_status").isin(SUCCESS, PARTIAL))
    df = mine.withColumns(chains).select(
        "doc_id",
        *[F.try_variant_get(data, f"$.{c}", "string").alias(c) for c in text],
        *[v.alias(c) for c, v in numbers.items()],
        (raw & says_percent(get(data, "tax_rate"))).alias("_percent"),
    )
    if document_type == "invoice":
        df = df.withColumn("tax_rate", rate_of_amount(F.col("tax_rate"), F.col("_percent")))
    return df.drop("_percent")


def _keys(df: DataFrame) -> list[str]:
    return [c for c in ("doc_id", "checked_type") if c in df.columns]


def explode_lines(results: DataFrame) -> DataFrame:
    """Line items of all documents with their 1-based place; names as the rules know them."""
    items = results.select(
        *_keys(results),
        (F.col("extraction_status") == PARTIAL).alias("_raw") if "extraction_status" in results.columns else F.lit(True).alias("_raw"),
        (F.col("checked_type" if "checked_type" in results.columns else "document_type") == "invoice").alias("_invoice"),
        F.posexplode(F.try_variant_get("data", "$.line_items", "array<variant>")).alias("_pos", "_item"),
    ).where(is_object(F.col("_item")))
    item, raw = F.col("_item"), F.col("_raw")
    line_no = F.col("_pos") + 1

    def typed(names: list[str]) -> Column:
        return _typed_number(item, names)

    def number(name: str, names: list[str] | None = None) -> Column:
        return F.when(raw, amount_of(item, name)).otherwise(typed(names or [name]))

    def text(name: str) -> Column:
        return F.try_variant_get(item, f"$.{name}", "string")

    def loose(name: str) -> Column:
        return F.when(raw, text(name))

    both = lambda name: amount_of(item, name)
    invoice_numbers = LINE_NUMBER["invoice"]
    return items.select(
        *_keys(results),
        line_no.cast("int").alias("line_no"),
        F.when(F.coalesce(text("description"), F.lit("")) != "", text("description"))
        .when(F.col("_invoice"), F.format_string("Item %d", line_no))
        .alias("description"),
        text("item_name").alias("item_name"),
        text("category").alias("category"),
        F.when(is_present(get(item, "quantity")), number("quantity")).otherwise(F.when(raw, both("qty"))).alias("quantity"),
        F.when(is_present(get(item, "unit_price")), number("unit_price")).otherwise(F.when(raw, both("rate"))).alias("unit_price"),
        number("total_price").alias("total_price"),
        F.when(raw | ~F.col("_invoice"), number("amount")).alias("amount"),
        F.when(raw, is_present(get(item, "total_price"))).alias("total_price_given"),
        F.when(raw, is_present(get(item, "amount"))).alias("amount_given"),
        F.when(raw, truthy(get(item, "amount"))).alias("amount_filled"),
        F.when(raw, loose("discount_percent"))
        .otherwise(typed(invoice_numbers["discount_percent"]).cast("string"))
        .alias("discount_percent"),
        loose("discount_percentage").alias("discount_percentage"),
        loose("discount_pct").alias("discount_pct"),
        loose("discount_rate").alias("discount_rate"),
        F.when(raw, loose("discount_amount"))
        .otherwise(typed(invoice_numbers["discount_amount"]).cast("string"))
        .alias("discount_amount"),
        loose("discount_value").alias("discount_value"),
        loose("discount").alias("discount"),
        F.coalesce(F.when(raw, as_text(get(item, "is_tax_inclusive")) == "true").otherwise(
            F.lower(as_text(get(item, "is_tax_inclusive"))).isin("true", "1", "yes", "on", "t", "y")), F.lit(False)
        ).alias("is_tax_inclusive"),
        number("gross_amount", invoice_numbers["gross_amount"]).alias("gross_amount"),
        text("item_code").alias("item_code"),
        text("source_snippet").alias("source_snippet"),
        as_double(get(item, "page_number")).try_cast("int").alias("page_number"),
    )


def _members(text: Column) -> Column:
    """Entries of a JSON object in their written order; a repeated key keeps its first place and its last value."""
    pairs = F.map_entries(F.from_json(text, "map<string,variant>"))
    keys = F.transform(pairs, lambda p: p["key"])
    last = F.transform(F.array_distinct(keys), lambda k: F.element_at(F.filter(pairs, lambda p: p["key"] == k), -1))
    return F.when(F.size(F.array_distinct(keys)) == F.size(keys), pairs).otherwise(last)


def _object_rows(df: DataFrame, text: Column, source: int) -> DataFrame:
    """Members of a JSON object in their written order."""
    members = df.select(*_keys(df), F.posexplode(_members(text)).alias("pos", "_member"))
    members = members.withColumns({"key": F.col("_member.key"), "_value": F.col("_member.value")})
    value = F.col("_value")
    return members.select(
        *_keys(df),
        F.lit(source).alias("source"),
        "pos",
        "key",
        as_text(value).alias("text"),
        is_string(value).alias("is_text"),
    )


def explode_extra(results: DataFrame) -> DataFrame:
    """Additional fields of every document, and the top-level keys of PARTIAL ones, as value rows."""
    extra, whole = _texts(results)
    rows = _object_rows(results, extra, 1)
    if "extraction_status" in results.columns:
        partial = results.where(F.col("extraction_status") == PARTIAL)
        rows = rows.unionByName(_object_rows(partial, whole, 0))
    return with_field_values(rows)


def ordered_texts() -> dict[str, Column]:
    """JSON text of the additional fields and of the whole payload; text keeps the order of keys, VARIANT does not."""
    clean, enclosed = F.col("clean"), F.col("enclosed")
    return {
        "extra_text": F.when(enclosed, F.get_json_object(clean, "$.extracted_data.additional_fields")).otherwise(
            F.get_json_object(clean, "$.additional_fields")
        ),
        "whole_text": F.when(enclosed, F.get_json_object(clean, "$.extracted_data")).otherwise(clean),
    }


def _texts(results: DataFrame) -> tuple[Column, Column]:
    """Text of the additional fields and of the whole payload, as stored or cut from the response."""
    if "extra_text" in results.columns:
        return F.col("extra_text"), F.col("whole_text")
    texts = ordered_texts()
    return texts["extra_text"], texts["whole_text"]


def explode_components(results: DataFrame) -> DataFrame:
    """Structured tax components: entries of the first filled list or object among tax_components and taxes."""
    data = F.col("data")
    extra = get(data, "additional_fields")
    raw = F.col("extraction_status") == PARTIAL
    extra_text, whole_text = _texts(results)
    # Each place with its JSON text, which keeps the order of an object's members.
    places = [
        (get(data, "tax_components"), F.get_json_object(whole_text, "$.tax_components")),
        (get(extra, "tax_components"), F.get_json_object(extra_text, "$.tax_components")),
        (F.when(raw, get(data, "taxes")), F.get_json_object(whole_text, "$.taxes")),
        (get(extra, "taxes"), F.get_json_object(extra_text, "$.taxes")),
    ]
    source = first_truthy_value(*[value for value, _ in places])
    text = F.coalesce(*[F.when(truthy(value), text) for value, text in places])
    kind = "checked_type" if "checked_type" in results.columns else "document_type"
    df = results.where(F.col(kind) == "invoice").select("doc_id", source.alias("_source"), text.alias("_text"))
    entry = F.col("_entry")
    listed = (
        df.where(is_array(F.col("_source")))
        .select("doc_id", F.posexplode(F.try_variant_get("_source", "$", "array<variant>")).alias("pos", "_entry"))
        .where(is_object(entry))
        .select(
            "doc_id",
            "pos",
            F.lower(strip(as_text(first_truthy_value(get(entry, "name"), get(entry, "tax_type"), get(entry, "type"))))).alias("name"),
            first_truthy_value(get(entry, "rate"), get(entry, "tax_rate"), get(entry, "percentage"), get(entry, "pct")).alias("_rate"),
            first_truthy_value(get(entry, "amount"), get(entry, "tax_amount"), get(entry, "value")).alias("_amount"),
        )
        .where(F.coalesce(F.col("name"), F.lit("")) != "")
    )
    percent = is_string(entry) & strip(as_text(entry)).endswith("%")
    keyed = (
        df.where(is_object(F.col("_source")))
        .select("doc_id", F.posexplode(_members(F.col("_text"))).alias("pos", "_member"))
        .withColumns({"name": F.lower(strip(F.col("_member.key"))), "_entry": F.col("_member.value")})
        .where(F.col("name").rlike("|".join(TAX_NAMES)) & (is_object(entry) | is_string(entry) | is_number(entry)))
        .select(
            "doc_id",
            "pos",
            "name",
            F.when(is_object(entry), first_truthy_value(get(entry, "rate"), get(entry, "tax_rate"), get(entry, "pct")))
            .when(percent, entry)
            .alias("_rate"),
            F.when(is_object(entry), first_truthy_value(get(entry, "amount"), get(entry, "tax_amount"), get(entry, "value")))
            .when(~percent, entry)
            .alias("_amount"),
        )
    )
    return (
        listed.unionByName(keyed)
        .select(
            "doc_id",
            "pos",
            "name",
            amount_of(F.col("_rate")).alias("_number"),
            says_percent(F.col("_rate")).alias("_percent"),
            amount_of(F.col("_amount")).alias("amount"),
        )
        .withColumn("rate", rate_of_amount(F.col("_number"), F.col("_percent")))
        .drop("_number", "_percent")
    )


def explode_evidence(parsed: DataFrame) -> DataFrame:
    """One row per field with source evidence; entries that are no objects are dropped."""
    rows = parsed.select(
        "doc_id", F.explode(F.try_variant_get("body", "$.evidence", "map<string,variant>")).alias("field", "_entry")
    ).where(is_object(F.col("_entry")))
    return rows.select(
        "doc_id",
        "field",
        as_text(get(F.col("_entry"), "source_snippet")).alias("source_snippet"),
        as_double(get(F.col("_entry"), "page_number")).try_cast("int").alias("page_number"),
    )


def dispatch_type(parsed: DataFrame) -> DataFrame:
    """Add checked_type: the type a payload names itself, or the one its keys give away, else the given one."""
    data = F.col("data")

    def stated(key: str) -> Column:
        value = F.lower(strip(as_text(get(data, key))))
        return F.when(value.isin(TYPES), value)

    has = lambda keys: _any_of([get(data, k).isNotNull() for k in keys])
    given_away = (F.col("document_type") == "invoice") & has(BALANCE_KEYS) & ~has(INVOICE_KEYS)
    chosen = F.coalesce(
        stated("document_type"),
        stated("statement_type"),
        F.when(given_away, "balance_sheet"),
        F.nullif(F.col("document_type"), F.lit("")),
        F.lit("unknown"),
    )
    return parsed.withColumn("checked_type", chosen).withColumn("is_supported", F.col("checked_type").isin(TYPES))


def checked_type_of_results(results: DataFrame) -> DataFrame:
    """Type dispatch after typing: only PARTIAL payloads still carry keys that could override their type."""
    loose = dispatch_type(results)
    return loose.withColumn(
        "checked_type", F.when(F.col("extraction_status") == PARTIAL, F.col("checked_type")).otherwise(F.col("document_type"))
    )


def partition_fields(parsed: DataFrame) -> DataFrame:
    """Each top-level key of a payload as line_items, nested, entity or financial field, with its display text."""
    # Keys that describe the parties and the period rather than an amount.
    entity = [
        "entity_name", "company_name", "vendor_name", "vendor_address", "vendor_tax_id",
        "customer_name", "customer_address", "customer_tax_id",
        "invoice_number", "invoice_date", "due_date", "payment_terms",
        "period_end_date", "period_start_date", "fiscal_year", "reporting_period",
        "currency", "reporting_scale", "document_type", "statement_type",
    ]
    rows = parsed.select("doc_id", F.explode(F.try_variant_get("data", "$", "map<string,variant>")).alias("key", "_value"))
    value = F.col("_value")
    part = (
        F.when((F.col("key") == "line_items") & is_array(value), "line_items")
        .when(is_array(value) | is_object(value), "nested")
        .when(F.col("key").isin(entity), "entity")
        .otherwise("financial")
    )
    shown = F.when(is_present(value), as_text(value))
    return rows.select(
        "doc_id",
        "key",
        part.alias("part"),
        (F.coalesce(shown, F.lit("")) == "").alias("is_null"),
        F.when(part.isin("entity", "financial"), shown).alias("text"),
        F.when(is_number(value) & part.isin("entity", "financial"), as_double(value)).alias("number"),
    )
