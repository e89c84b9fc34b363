"""Line discounts: which kind a line carries and how large it is."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from ledgerline.functions.numeric import (
    DEFAULT_TOLERANCE,
    amount,
    is_given,
    parse_amount,
    parse_float,
    round_to,
    strip,
)

# Field names in priority order, currency marks, discount words and the patterns built on them.
PERCENT_FIELDS = ["discount_percent", "discount_percentage", "discount_pct", "discount_rate"]
AMOUNT_FIELDS = ["discount_amount", "discount_value"]
CURRENCY_MARKS = r"[$€£¥₹]|USD|EUR|GBP|INR"
WORDS = r"(?:discount|disc|dis\b|less|off|rebate)"
WORD_PARTS = ["dis", "less", "off", "rebate"]  # every one of WORDS has one of these
NUMBER = r"(\d+(?:\.\d+)?)"
PERCENT_ANYWHERE = rf"{NUMBER}\s*%"
WORD_THEN_PERCENT = rf"(?i){WORDS}\s*[:=]?\s*{NUMBER}\s*%"
PERCENT_THEN_WORD = rf"(?i){NUMBER}\s*%\s*{WORDS}"
WORD_THEN_AMOUNT = rf"(?i){WORDS}\s*[:=]?\s*[$€£¥₹]?\s*{NUMBER}(?!\s*%)"

PERCENT, AMOUNT = "PERCENT", "AMOUNT"


def _pair(kind: str, value: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), value.cast("double").alias("value"))


def _none() -> Column:
    return F.lit(None).cast("struct<kind:string,value:double>")


def _found(text: Column, pattern: str) -> Column:
    """First capture of a pattern as double, null where it does not match."""
    return F.regexp_extract(text, pattern, 1).try_cast("double")


def _is_text(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, StringType)


def _percent_field(df: DataFrame, name: str) -> Column:
    if _is_text(df, name):
        number = parse_float(F.regexp_replace(strip(F.col(name)), r"%$", ""))
    else:
        number = F.col(name).cast("double")
    if name == "discount_rate":
        number = F.when((number > 0.0) & (number <= 1.0), number * 100.0).otherwise(number)
    return number


def _first_given(df: DataFrame, names: list[str], read) -> tuple[Column, Column]:
    """Whether any of the fields is given, and the number of the first one that is."""
    given, number = F.lit(False), F.lit(None).cast("double")
    for name in reversed([n for n in names if n in df.columns]):
        present = F.col(name).isNotNull()
        given = present | given
        number = F.when(present, read(df, name)).otherwise(number)
    return given, number


def _fits_percent(value: Column, tolerance: float) -> Column:
    extended = F.col("_q") * F.col("_p")
    return value.between(0.0, 100.0) & (
        F.abs(round_to(extended * (1.0 - value / 100.0), 4) - F.col("_t")) <= tolerance
    )


def _bare_number(value: Column, tolerance: float) -> Column:
    """A number without unit is whatever reading reproduces the line total; a percentage wins a tie."""
    as_amount = (value >= 0.0) & (F.abs(round_to(F.col("_q") * F.col("_p") - value, 4) - F.col("_t")) <= tolerance)
    return F.when(_fits_percent(value, tolerance), _pair(PERCENT, value)).when(as_amount, _pair(AMOUNT, value))


def _in_totals(text: Column, tolerance: float) -> Column:
    """First n% in the text that reproduces the line total, exactly or rounded in steps."""

    def reproduces(value: Column) -> Column:
        whole = F.col("_whole")
        stepped = round_to(whole - round_to(whole * (value / 100.0), 2), 2)
        return _fits_percent(value, tolerance) | (
            value.between(0.0, 100.0) & (F.abs(stepped - F.col("_t")) <= tolerance)
        )

    numbers = F.transform(F.regexp_extract_all(text, F.lit(PERCENT_ANYWHERE), F.lit(1)), lambda s: s.try_cast("double"))
    return F.when(text.contains("%"), F.get(F.filter(numbers, reproduces), 0))


def with_line_inputs(lines: DataFrame) -> DataFrame:
    """Quantity, price and total of a line under their second names too (a zero counts as present)."""

    def either(first: str, second: str) -> Column:
        if second not in lines.columns:
            return amount(lines, first)
        if first not in lines.columns:
            return amount(lines, second)
        return F.when(is_given(lines, first), amount(lines, first)).otherwise(amount(lines, second))

    return lines.withColumns(
        {"_q": either("quantity", "qty"), "_p": either("unit_price", "rate"), "_t": either("total_price", "amount")}
    )


def resolve_line_discount(
    lines: DataFrame, tolerance: float = DEFAULT_TOLERANCE, from_text: bool = True
) -> DataFrame:
    """Add discount_kind and discount_value, and has_discount as seen without the line's quantity, price and total."""
    df = with_line_inputs(lines)
    texts = [c for c in ("source_snippet", "description") if c in df.columns] if from_text else []
    has_generic = "discount" in df.columns
    null = F.lit(None).cast("double")
    percent_given, percent = _first_given(df, PERCENT_FIELDS, _percent_field)
    amount_given, money = _first_given(df, AMOUNT_FIELDS, amount)
    generic = F.col("discount") if has_generic else F.lit(None).cast("string")
    generic_text = has_generic and _is_text(df, "discount")
    # What each source says, as one number per column.
    readings = {
        "_percent": percent,
        "_money": money,
        "_generic_percent": F.when(generic.contains("%"), _found(generic, PERCENT_ANYWHERE)) if generic_text else null,
        "_generic_money": F.when(generic.rlike(CURRENCY_MARKS), parse_amount(generic)) if generic_text else null,
        "_bare": (parse_float(generic) if generic_text else generic.cast("double")) if has_generic else null,
        "_whole": round_to(F.col("_q") * F.col("_p"), 2),
    }
    named = percent_given | amount_given | generic.isNotNull()
    df = df.withColumns({f"_lower_{name}": F.when(~named, F.lower(F.col(name))) for name in texts})
    for name in texts:
        text = F.col(name)
        # The patterns are tried only where they count and one of their words is there.
        has_word = reduce(Column.__or__, [F.col(f"_lower_{name}").contains(w) for w in WORD_PARTS])
        worded = F.coalesce(_found(text, WORD_THEN_PERCENT), _found(text, PERCENT_THEN_WORD))
        readings[f"_percent_{name}"] = F.when(has_word & text.contains("%"), worded)
        readings[f"_money_{name}"] = F.when(has_word, _found(text, WORD_THEN_AMOUNT))
    df = df.withColumns(readings)
    in_range = lambda c: F.when(F.col(c).between(0.0, 100.0), _pair(PERCENT, F.col(c)))
    not_negative = lambda c: F.when(F.col(c) >= 0.0, _pair(AMOUNT, F.col(c)))
    worded = [reading for name in texts for reading in (in_range(f"_percent_{name}"), not_negative(f"_money_{name}"))]
    stated = (
        F.when(percent_given, in_range("_percent"))
        .when(amount_given, not_negative("_money"))
        .when(generic.contains("%") if generic_text else F.lit(False), in_range("_generic_percent"))
        .when(generic.isNotNull(), not_negative("_generic_money"))
        .otherwise(F.coalesce(*worded) if worded else _none())
    )
    # Only the line's total can tell what a bare number, or a percentage somewhere in the text, means.
    in_totals = [_in_totals(F.col(name), tolerance) for name in texts]
    df = df.withColumns({"_stated": stated, "_in_text": F.when(~named, F.coalesce(*in_totals)) if texts else null})
    derived = F.when(percent_given | amount_given, _none()).when(
        generic.isNotNull(), _bare_number(F.col("_bare"), tolerance)
    ).otherwise(F.when(F.col("_in_text").isNotNull(), _pair(PERCENT, F.col("_in_text"))))
    df = df.withColumns(
        {"_discount": F.coalesce(F.col("_stated"), derived), "has_discount": F.col("_stated").isNotNull()}
    )
    return df.withColumns({"discount_kind": F.col("_discount.kind"), "discount_value": F.col("_discount.value")}).drop(
        "_discount", "_stated", "_in_text", *readings, *[f"_lower_{name}" for name in texts]
    )
