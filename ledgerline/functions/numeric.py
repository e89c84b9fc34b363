"""Amounts, rates and rounding as column expressions.

All arithmetic is IEEE double, as in the documents' JSON. Sums over rows go through decimals so that a result never
depends on how the rows were partitioned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BooleanType, NumericType, StringType

# Every character that counts as white space, and the currency marks an amount may carry.
SPACE = r"\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CURRENCY = "$€£¥₹"

DEFAULT_TOLERANCE = 0.01

_PLAIN = rf"^[{SPACE}]*[-+]?(?:\d+(?:\.\d*)?|\.\d+)[{SPACE}]*$"
_BRACKETS = r"^[^()]*$|" + rf"^[{SPACE}]*\([^()]*\)[{SPACE}]*$"
_NEGATIVE = rf"^[{SPACE}]*[(-]|(?:-|[Cc][Rr])[{SPACE}]*$"
_PERCENT = rf"%[{SPACE}]*(?:-|[Cc][Rr])?[{SPACE}]*\)?[{SPACE}]*$"
# Every alternative takes at least one character: an empty match would skip the character after it.
_NOISE = (
    rf"^[{SPACE}]*(?:\([{SPACE}]*[-+]?|[-+])"
    rf"|%[{SPACE}]*(?:-|[Cc][Rr])?[{SPACE}]*\)?[{SPACE}]*$"
    rf"|(?:-|[Cc][Rr])[{SPACE}]*\)?[{SPACE}]*$"
    rf"|\)[{SPACE}]*$"
    rf"|[A-Za-z{CURRENCY}{SPACE}]"
)
_SPACE_CHARS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_FLOAT = r"^[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?$"


def strip(text: Column) -> Column:
    """Remove white space of every kind from both ends."""
    return F.btrim(text, F.lit(_SPACE_CHARS))


def round_to(value: Column, digits: int) -> Column:
    """Round half-even on the scaled double; values too large to carry that many digits stay as they are."""
    scale = float(10**digits)
    return F.when(F.abs(value) >= 2.0**53 / scale, value).otherwise(F.rint(value * scale) / scale)


def truncate_cents(value: Column) -> Column:
    """Cut (not round) to two decimals after settling the fourth."""
    whole = (round_to(value, 4) * 100).try_cast("bigint")
    return F.coalesce(whole.cast("double") / 100.0, value)


def parse_float(text: Column) -> Column:
    """A plain or exponent literal as double, anything else null."""
    bare = strip(text)
    return F.when(bare.rlike(_FLOAT), bare.try_cast("double"))


def parse_amount(text: Column) -> Column:
    """Read a printed amount: brackets, trailing minus and CR negate, % divides by 100, currency and letters drop out.

    Every step occurs once in the expression, so that a projection of many amounts still fits generated code.
    """
    digits = F.regexp_replace(text, _NOISE, "")
    digits = F.regexp_replace(digits, r"^(\d+),(\d{1,2})$", "$1.$2")
    digits = F.regexp_replace(digits, r",|(?<=\d)_(?=\d)", "")
    size = F.when(text.rlike(_BRACKETS), digits.try_cast("double")) / F.when(text.rlike(_PERCENT), 100.0).otherwise(1.0)
    # A sign left inside, as in "+-5", counts only where no other mark negates.
    number = F.round(size, 6)
    return F.when(text.rlike(_PLAIN), F.round(strip(text).try_cast("double"), 6)).otherwise(
        F.when(text.rlike(_NEGATIVE), F.least(number, -number)).otherwise(number)
    )


def amount(df: DataFrame, name: str) -> Column:
    """Amount of a column by its type: numbers as they are, booleans 1/0, text parsed; null when the column is absent."""
    if name not in df.columns:
        return F.lit(None).cast("double")
    kind = df.schema[name].dataType
    if isinstance(kind, StringType):
        return parse_amount(F.col(name))
    if isinstance(kind, (NumericType, BooleanType)):
        return F.col(name).cast("double")
    return F.lit(None).cast("double")


def is_given(df: DataFrame, name: str) -> Column:
    """Whether a field was written at all; ``<name>_given`` knows it where the amount could not be read."""
    known = F.col(name).isNotNull()
    return F.coalesce(F.col(f"{name}_given"), known) if f"{name}_given" in df.columns else known


def is_filled(df: DataFrame, name: str) -> Column:
    """Whether a field is neither null, empty nor zero; ``<name>_filled`` knows it where the amount could not be read."""
    if isinstance(df.schema[name].dataType, StringType):
        known = F.coalesce(F.col(name), F.lit("")) != ""
    else:
        known = F.coalesce(F.col(name).cast("double"), F.lit(0.0)) != 0.0
    return F.coalesce(F.col(f"{name}_filled"), known) if f"{name}_filled" in df.columns else known


def rate_of_amount(number: Column, is_percent: Column) -> Column:
    """Fraction an amount stands for as a rate; values above 1 are percentages. ``number`` should be a plain column."""
    return (
        F.when(is_percent, number)
        .when(number.between(0.0, 1.0), round_to(number, 6))
        .when((number > 1.0) & (number <= 100.0), round_to(number / 100.0, 6))
    )


def normalize_amounts(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: amount(df, c) for c in columns})


def normalize_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    """Printed rates as fractions: '9%' and '9' and '0.09' are all 0.09."""
    is_text = {c: isinstance(df.schema[c].dataType, StringType) for c in columns}
    read = df.withColumns({f"_amount_{c}": amount(df, c) for c in columns})
    percent = {c: F.coalesce(F.col(c).contains("%"), F.lit(False)) if is_text[c] else F.lit(False) for c in columns}
    rates = {c: rate_of_amount(F.col(f"_amount_{c}"), percent[c]) for c in columns}
    return read.withColumns(rates).drop(*[f"_amount_{c}" for c in columns])


def exact_sum(value: Column) -> Column:
    """Order-independent sum through decimals; null where an amount of 1e22 or more makes it impossible to hold."""
    held = value.try_cast("decimal(28,6)")
    return F.when(F.count(held) == F.count(value), F.sum(held).cast("double"))


def first_truthy(*candidates: Column) -> Column:
    """First candidate that is neither null nor zero, else the last candidate as it is."""
    *head, last = candidates
    return F.coalesce(*[F.nullif(c, F.lit(0.0)) for c in head], last)


def display_number(value: Column) -> Column:
    """Grouped thousands with up to four decimals and no trailing zeros."""
    shown = F.format_number(value, 4)
    return F.regexp_replace(F.regexp_replace(shown, r"0+$", ""), r"\.$", "")


def display_key(key: Column) -> Column:
    """snake_case key as a title; only the first letter of a word changes."""
    spaced = F.replace(key, F.lit("_"), F.lit(" "))
    words = F.transform(F.split(spaced, " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2))))
    return F.when(F.length(key) > 0, F.array_join(words, " ")).otherwise(F.lit("—"))


def display_bytes(size: Column, decimals: int = 1) -> Column:
    """Byte count with a binary unit."""
    units = ["Bytes", "KB", "MB", "GB"]  # fixed values
    shown = F.lit("0 Bytes")
    expr = None
    for power, unit in reversed(list(enumerate(units))):
        scaled = F.round(size / float(1024**power), decimals)
        text = F.concat(F.regexp_replace(scaled.cast("decimal(38,%d)" % decimals).cast("string"), r"\.0+$", ""), F.lit(" " + unit))
        cond = size >= 1024**power
        expr = F.when(cond, text) if expr is None else expr.when(cond, text)
    return F.when(size.isNull() | (size <= 0), shown).otherwise(expr.otherwise(shown))
