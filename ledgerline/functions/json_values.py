"""Typed access to VARIANT values."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ledgerline.functions.numeric import SPACE, parse_amount


def get(value: Column, key: str) -> Column:
    """Member of an object as VARIANT; SQL NULL when the key is absent, a JSON null when it is null."""
    return F.try_variant_get(value, f"$.{key}", "variant")


def type_of(value: Column) -> Column:
    return F.schema_of_variant(value)


def is_object(value: Column) -> Column:
    return F.coalesce(type_of(value).startswith("OBJECT"), F.lit(False))


def is_array(value: Column) -> Column:
    return F.coalesce(type_of(value).startswith("ARRAY"), F.lit(False))


def is_string(value: Column) -> Column:
    return F.coalesce(type_of(value) == "STRING", F.lit(False))


def is_present(value: Column) -> Column:
    """Neither absent nor a JSON null."""
    return F.coalesce(type_of(value) != "VOID", F.lit(False))


def is_number(value: Column) -> Column:
    return F.coalesce(type_of(value).rlike("^(BIGINT|DOUBLE|DECIMAL|INT|FLOAT)"), F.lit(False))


def as_text(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def as_double(value: Column) -> Column:
    return F.try_variant_get(value, "$", "double")


def truthy(value: Column) -> Column:
    """False for absent, null, false, zero, and empty text, list or object."""
    text = as_text(value)
    return F.coalesce(
        F.when(is_string(value), text != "")
        .when(is_object(value) | is_array(value), ~text.isin("{}", "[]"))
        .when(is_present(value), as_double(value) != 0.0),
        F.lit(False),
    )


def first_truthy_value(*values: Column) -> Column:
    *head, last = values
    return F.coalesce(*[F.when(truthy(v), v) for v in head], last)


def amount_of(value: Column, key: str | None = None) -> Column:
    """Amount of a JSON value: numbers and booleans as they are, text parsed, anything else null."""
    if key:
        return F.when(is_string(get(value, key)), parse_amount(F.try_variant_get(value, f"$.{key}", "string"))).otherwise(
            F.try_variant_get(value, f"$.{key}", "double")
        )
    return F.when(is_string(value), parse_amount(as_text(value))).otherwise(as_double(value))


def says_percent(value: Column) -> Column:
    return is_string(value) & F.coalesce(as_text(value).contains("%"), F.lit(False))


_STRICT = rf"^[{SPACE}]*[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?[{SPACE}]*$|^(?:true|false)$"


def strict_double(value: Column, key: str | None = None) -> Column:
    """A number, a boolean or text holding one plain number; null for anything else. ``key`` reads a member."""
    path = f"$.{key}" if key else "$"
    text = F.try_variant_get(value, path, "string")
    return F.when(text.rlike(_STRICT), F.try_variant_get(value, path, "double"))
