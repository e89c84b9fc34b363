"""Check rows: one set of output columns shared by every rule."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from ledgerline.functions.numeric import DEFAULT_TOLERANCE, round_to
from ledgerline.session import compiled_methods

PASS, FAILED, NOT_APPLICABLE = "PASS", "FAILED", "NOT_APPLICABLE"  # fixed values

CHECK_COLUMNS = [
    "doc_id",
    "document_type",
    "rule_order",
    "line_no",
    "rule_name",
    "formula",
    "input_values",
    "calculated_value",
    "reported_value",
    "variance",
    "status",
    "tolerance",
    "missing_fields",
]


def missing(**inputs: Column) -> Column:
    """Names of the null inputs, joined by ', ' ('' when all are present)."""
    return F.concat_ws(", ", *[F.when(value.isNull(), F.lit(name)) for name, value in inputs.items()])


def missing_array(joined: Column) -> Column:
    return F.when(joined == "", F.array().cast("array<string>")).otherwise(F.split(joined, ", "))


def input_map(inputs: dict[str, Column]) -> Column:
    if not inputs:
        return F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))
    flat = [part for name, value in inputs.items() for part in (F.lit(name), value.cast("double"))]
    return F.create_map(*flat)


@dataclass
class Rule:
    """One check of a document, as expressions over its row.

    ``lacking`` is the joined list of missing inputs; a non-empty list makes the check NOT_APPLICABLE, and so does
    ``blocked``. ``variance`` replaces calculated - reported where a rule needs its own; ``emit`` drops the row when false.
    """

    order: int
    name: str
    formula: Column | str
    calculated: Column
    reported: Column
    lacking: Column
    inputs: dict[str, Column] = field(default_factory=dict)
    variance: Column | None = None
    emit: Column | None = None
    blocked: Column | None = None


def finish(df: DataFrame, tolerance: float) -> DataFrame:
    """Turn (_calculated, reported_value, _variance, _lacking, _blocked) into the public columns."""
    applicable = ~F.col("_blocked") & (F.col("_lacking") == "")
    variance = F.coalesce(F.col("_variance"), round_to(F.col("_difference"), 4))
    return (
        df.withColumn("_difference", F.col("_calculated") - F.col("reported_value"))
        .withColumn("variance", F.when(applicable, variance + 0.0))
        .withColumns(
            {
                "calculated_value": F.when(applicable, F.col("_calculated")),
                "status": F.when(~applicable, NOT_APPLICABLE)
                .when(F.abs(F.col("variance")) <= tolerance, PASS)
                .otherwise(FAILED),
                "tolerance": F.lit(float(tolerance)),
                "missing_fields": missing_array(F.col("_lacking")),
            }
        )
        .select(*CHECK_COLUMNS)
    )


def emit_checks(
    docs: DataFrame, document_type: str, rules: list[Rule], tolerance: float = DEFAULT_TOLERANCE
) -> DataFrame:
    """Fan one document row out to one row per rule.

    What a rule computes is laid out in columns first, then the rows are multiplied by a literal list of rule numbers
    and each output column picks its rule's. Unused columns are pruned, nothing shuffles, and the expressions stay
    small enough for generated code.
    """
    null = F.lit(None).cast("double")
    parts = {
        "formula": lambda r: F.lit(r.formula) if isinstance(r.formula, str) else r.formula,
        "inputs": lambda r: input_map(r.inputs),
        "calculated": lambda r: r.calculated,
        "reported": lambda r: r.reported,
        "variance": lambda r: null if r.variance is None else r.variance,
        "lacking": lambda r: r.lacking,
        "blocked": lambda r: F.lit(False) if r.blocked is None else r.blocked,
        "emit": lambda r: F.lit(True) if r.emit is None else r.emit,
    }
    laid_out = compiled_methods(docs).select(
        "doc_id", *[of(rule).alias(f"_{part}_{rule.order}") for part, of in parts.items() for rule in rules]
    )

    def pick(part: str) -> Column:
        if len(rules) == 1:
            return F.col(f"_{part}_{rules[0].order}")
        chosen = None
        for rule in rules:
            hit, value = F.col("rule_order") == rule.order, F.col(f"_{part}_{rule.order}")
            chosen = F.when(hit, value) if chosen is None else chosen.when(hit, value)
        return chosen

    if len(rules) == 1:
        fanned = laid_out.withColumn("rule_order", F.lit(rules[0].order))
    else:
        fanned = laid_out.withColumn("rule_order", F.explode(F.array(*[F.lit(r.order) for r in rules])))
    if any(r.emit is not None for r in rules):
        fanned = fanned.where(pick("emit"))
    name = F.lit(rules[0].name)
    for rule in rules[1:]:
        name = F.when(F.col("rule_order") == rule.order, rule.name).otherwise(name)
    fanned = fanned.select(
        "doc_id",
        F.lit(document_type).alias("document_type"),
        "rule_order",
        F.lit(None).cast("bigint").alias("line_no"),
        name.alias("rule_name"),
        pick("formula").alias("formula"),
        pick("inputs").alias("input_values"),
        pick("calculated").alias("_calculated"),
        pick("reported").alias("reported_value"),
        pick("variance").alias("_variance"),
        pick("lacking").alias("_lacking"),
        pick("blocked").alias("_blocked"),
    )
    return finish(fanned, tolerance)


def with_message(checks: DataFrame) -> DataFrame:
    """Add a readable sentence per check, made from its own columns."""
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("nothing"))
    text = (
        F.when(
            F.col("status") == NOT_APPLICABLE,
            F.concat(F.col("rule_name"), F.lit(" not applicable, missing: "), F.array_join("missing_fields", ", ")),
        )
        .when(
            F.col("status") == PASS,
            F.concat(F.col("rule_name"), F.lit(" passed: "), number("calculated_value"), F.lit(" agrees with "), number("reported_value")),
        )
        .otherwise(
            F.concat(
                F.col("rule_name"),
                F.lit(" failed: calculated "),
                number("calculated_value"),
                F.lit(", reported "),
                number("reported_value"),
                F.lit(", off by "),
                number("variance"),
            )
        )
    )
    return checks.withColumn("message", text)
