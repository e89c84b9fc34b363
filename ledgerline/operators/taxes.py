"""Statutory tax components of an invoice and the amount each of them stands for.

The components of one document stand in its payload, so they travel as one short array in the document's row; what needs
the lines (the tax summed line by line) is worked out where the lines are, spread over ``SALTS`` tasks a hot document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerline.functions.numeric import DEFAULT_TOLERANCE
from ledgerline.operators.numbering import hot_keys, is_one_of

# Component names in order, and the endings of their rate and amount fields.
NAMES = ["cgst", "sgst", "utgst", "igst", "cess", "vat"]
RATE_ENDINGS = ["_rate", "_pct", "_percentage", "_percent"]
AMOUNT_ENDINGS = ["_amount", "_val", "_value", ""]

FIELD_KEYS = [n + e for n in NAMES for e in RATE_ENDINGS + AMOUNT_ENDINGS]
PARTS = "array<struct<component_order:int,name:string,rate:double,amount:double>>"
#: Tasks over which the lines of one hot document are spread when they meet its rates.
SALTS = 32


def _round(value: str, digits: int) -> str:
    """SQL of numeric.round_to."""
    scale = 10**digits
    return f"CASE WHEN abs({value}) >= {2**53 / scale!r}D THEN {value} ELSE rint({value} * {scale}D) / {scale}D END"


def _grown(old: str, index: bool = False, **new: str) -> Column:
    """The parts with further fields, each an expression over the part p (and its index i)."""
    fields = [f"'{name}', p.{name}" for name in old.split() if name not in new] + [f"'{name}', {value}" for name, value in new.items()]
    return F.expr(f"transform(parts, {'(p, i)' if index else 'p'} -> named_struct({', '.join(fields)}))")


def _alias(name: str) -> str:
    """SQL: component, reading and priority that a normalised field name stands for."""
    entries = [
        f"'{n}{ending}', named_struct('name', '{n}', 'is_rate', {is_rate}, 'place', {place})"
        for n in NAMES
        for is_rate, endings in (("true", RATE_ENDINGS), ("false", AMOUNT_ENDINGS))
        for place, ending in enumerate(endings)
    ]
    return f"element_at(map({', '.join(entries)}), key_norm).{name}"


def field_facts() -> dict[str, Column]:
    """What a field row says about a component: its name, its rank among the document's fields, and how to read it.

    The rank is source, then place of the ending, then exact before normalised names, then position, in one integer.
    """
    rank = f"((source * 4L + {_alias('place')}) * 2L + CAST(key <> key_norm AS BIGINT)) * {1 << 32}L + pos"
    reading = f"""CASE WHEN {_alias('is_rate')} THEN IF(rate IS NOT NULL, 'stated', NULL)
        WHEN is_text AND contains(text, '%') THEN IF(rate IS NOT NULL, 'percent', NULL) WHEN num IS NOT NULL THEN 'amount' END"""
    return {
        "part_name": F.expr(f"IF(text IS NOT NULL, {_alias('name')}, NULL)"),
        "part_rank": F.expr(rank).cast("bigint"),
        "part_reading": F.expr(reading),
    }


def field_aggregates() -> list[Column]:
    """Per component the stated rate, the percentage if it comes before any amount, and the amount, each of the first field."""
    found = []
    for name in NAMES:
        mine = f"part_name = '{name}'"
        found += [
            F.expr(f"min_by(rate, IF({mine} AND part_reading = 'stated', part_rank, NULL))").alias(f"_stated_{name}"),
            F.expr(f"min_by(IF(part_reading = 'percent', rate, NULL), IF({mine} AND part_reading <> 'stated', part_rank, NULL))").alias(f"_percent_{name}"),
            F.expr(f"min_by(num, IF({mine} AND part_reading = 'amount', part_rank, NULL))").alias(f"_amount_{name}"),
        ]
    return found


def field_parts() -> Column:
    """Components named by single fields, from the columns of ``field_aggregates``."""
    parts = [
        f"IF(coalesce(_stated_{n}, _percent_{n}, _amount_{n}) IS NOT NULL, named_struct('component_order', {1000 + place}, 'name', '{n}', "
        f"'rate', coalesce(_stated_{n}, _percent_{n}), 'amount', _amount_{n}), NULL)"
        for place, n in enumerate(NAMES)
    ]
    return F.expr(f"CAST(filter(array({', '.join(parts)}), p -> p IS NOT NULL) AS {PARTS})")


def structured_parts() -> Column:
    """Components of a payload's own list ``entries``: a repeated name keeps its first place and last values."""
    of_name = "filter(entries, e -> e.name = n)"
    last = f"element_at(array_sort({of_name}), -1)"
    part = f"named_struct('component_order', array_min({of_name}).pos, 'name', n, 'rate', {last}.rate, 'amount', {last}.amount)"
    return F.expr(f"CAST(transform(array_distinct(transform(entries, e -> e.name)), n -> {part}) AS {PARTS})")


def merged_parts(fields: Column, structured: Column) -> Column:
    """All components; a structured entry hides a field of the same name."""
    hidden = F.transform(structured, lambda p: p["name"])
    return F.concat(structured, F.filter(fields, lambda p: ~F.array_contains(hidden, p["name"])))


def gst_rates(docs: DataFrame, tolerance: float = DEFAULT_TOLERANCE) -> DataFrame:
    """Give a CGST/SGST pair without rates half the total rate, or a whole-percent rate that reproduces the amount."""
    own = lambda name: f"get(filter(parts, p -> p.name = '{name}'), 0)"
    exact = "(subtotal * _guess)"
    fits = f"abs({_round(exact, 2)} - _cgst.amount) <= {tolerance!r}D OR abs({exact} - _cgst.amount) <= {tolerance!r}D"
    implied = f"CASE WHEN tax_rate > 0 THEN {_round('(tax_rate / 2D)', 6)} WHEN subtotal > 0 AND ({fits}) THEN {_round('_guess', 6)} END"
    pair = "_cgst IS NOT NULL AND _sgst IS NOT NULL AND _cgst.rate IS NULL AND _sgst.rate IS NULL"
    return (
        docs.withColumns({"_cgst": F.expr(own("cgst")), "_sgst": F.expr(own("sgst"))})
        .withColumns({"_pair": F.expr(pair), "_guess": F.expr("rint(try_divide(_cgst.amount, subtotal) * 100) / 100D")})
        .withColumn("_implied", F.expr(implied))
        .withColumn("parts", F.array_sort(_grown("component_order name rate amount", rate="IF(_pair AND p.name IN ('cgst', 'sgst'), _implied, p.rate)", amount="p.amount")))
        .drop("_pair", "_cgst", "_sgst", "_guess", "_implied")
    )


def with_readings(docs: DataFrame, tolerance: float = DEFAULT_TOLERANCE) -> DataFrame:
    """Add to every component its tax as exact, rounded and cut amount, and whether one of these explains the reported one.

    ``open_rates`` lists the components that only the lines can explain.
    """
    base = "component_order name rate amount"
    cut = f"coalesce(CAST(try_cast({_round('p.exact', 4)} * 100D AS BIGINT) AS DOUBLE) / 100D, p.exact)"
    near = " OR ".join(f"abs(p.amount - p.{name}) <= {tolerance!r}D" for name in ("exact", "rounded", "cut"))
    return (
        docs.withColumn("parts", _grown(base, True, no="i", exact="subtotal * p.rate"))
        .withColumn("parts", _grown(f"{base} no exact", rounded=_round("p.exact", 2), cut=cut))
        .withColumn("parts", _grown(f"{base} no exact rounded cut", explained=near))
        .withColumn("open_rates", F.expr("transform(filter(parts, p -> NOT p.explained), p -> named_struct('no', p.no, 'rate', p.rate))"))
    )


def meet_lines(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """Documents with the facts of their lines, and for each open rate the tax of the lines rounded line by line.

    Rows of documents and lines (own_total, is_inclusive, has_discount) meet under (doc_id, salt): a hot document (many lines) with
    open rates goes to all salts, and its lines are spread over these, so no task holds a large document; all others have salt 0.
    Sorted, the document comes first and its rates run on to the lines behind it. What a salt holds is combined where it is; a
    last narrow exchange brings at most SALTS rows a component together. Documents without a row in ``docs`` drop out.
    """
    is_hot = is_one_of("doc_id", hot_keys(lines))
    keys = [c for c in ("line_no", "own_total") if c in lines.columns]
    spread = F.when(is_hot, F.pmod(F.xxhash64(*keys), F.lit(SALTS))).otherwise(0).cast("int")
    sent = lines.select("doc_id", spread.alias("salt"), F.lit(1).alias("kind"), "own_total", "is_inclusive", "has_discount")
    # Outer: Spark would otherwise filter by the exploded array, and work out the components once more for that.
    salts = F.explode_outer(F.sequence(F.lit(0), F.when(is_hot & (F.size("open_rates") > 0), SALTS - 1).otherwise(0)))
    # The readings of a component are worked out again behind the exchanges, so that only what they are made of travels.
    docs = docs.withColumn("parts", F.expr(f"CAST(transform(parts, p -> named_struct('component_order', p.component_order, 'name', p.name, 'rate', p.rate, 'amount', p.amount)) AS {PARTS})"))
    whole = docs.select("doc_id", "open_rates", F.struct(*[c for c in docs.columns if c not in ("doc_id", "open_rates")]).alias("doc"), salts.alias("salt"))
    both = sent.unionByName(whole.select("doc_id", "salt", F.lit(0).alias("kind"), "open_rates", F.expr("IF(salt = 0, doc, NULL)").alias("doc")), allowMissingColumns=True)
    run = Window.partitionBy("doc_id", "salt").orderBy("kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    taxes = f"transform(open_rates, r -> named_struct('no', r.no, 'tax', {_round('(own_total * r.rate)', 2)}))"
    fanned = both.withColumn("open_rates", F.last("open_rates", ignorenulls=True).over(run)).select(
        "doc_id", "salt", "own_total", "is_inclusive", "has_discount", "doc", (F.col("kind") == 1).alias("is_line"),
        F.expr(f"explode_outer(concat(array(named_struct('no', -1, 'tax', CAST(NULL AS DOUBLE))), IF(kind = 1 AND open_rates IS NOT NULL, {taxes}, array())))").alias("part"),
    )
    own = "part.no = -1 AND is_line"
    held, tax = f"IF({own}, try_cast(own_total AS DECIMAL(28,6)), NULL)", "try_cast(part.tax AS DECIMAL(28,6))"
    salted = fanned.groupBy("doc_id", "salt", F.col("part.no").alias("no")).agg(
        F.expr(f"count_if({own})").alias("n_lines"),
        F.expr(f"count(IF({own}, own_total, NULL))").alias("n_totals"),
        F.expr(f"count({held})").alias("n_held"),
        F.expr(f"sum({held})").alias("held"),
        F.bool_or("is_inclusive").alias("any_inclusive"),
        F.bool_or("has_discount").alias("any_discount"),
        F.expr(f"sum({tax})").alias("tax"),
        F.expr(f"count({tax}) = count(part.tax)").alias("whole"),
        F.first(F.expr("IF(part.no = -1, doc, NULL)"), ignorenulls=True).alias("doc"),
    )
    merged = salted.groupBy("doc_id").agg(
        F.first("doc", ignorenulls=True).alias("doc"),
        F.sum("n_lines").alias("n_lines"),
        F.sum("n_totals").alias("n_totals"),
        F.expr("IF(sum(n_held) = sum(n_totals), CAST(sum(held) AS DOUBLE), NULL)").alias("total_sum"),
        F.bool_or("any_inclusive").alias("any_inclusive"),
        F.bool_or("any_discount").alias("any_discount"),
        F.expr("collect_list(IF(no >= 0, named_struct('no', no, 'tax', tax, 'whole', whole), NULL))").alias("line_taxes"),
    )
    return merged.where("doc IS NOT NULL").select("doc_id", "doc.*", "n_lines", "n_totals", "total_sum", "any_inclusive", "any_discount", "line_taxes")


def resolve_parts(docs: DataFrame, tolerance: float = DEFAULT_TOLERANCE) -> DataFrame:
    """Add calculated_amount to every component, and what the tax rule reads of all: number, sum, names, any without amount.

    A reported amount stands when it equals the exact, rounded, cut or line-by-line tax; else the rounded tax is taken.
    """
    base = "component_order name rate amount exact rounded cut explained"
    zero = "CAST(0 AS DECIMAL(38,6))"
    added = lambda values: f"CAST(aggregate({values}, {zero}, (s, v) -> CAST(s + coalesce(v, {zero}) AS DECIMAL(38,6))) AS DOUBLE)"
    mine = "filter(line_taxes, t -> t.no = p.no)"
    total = added(f"transform({mine}, t -> t.tax)")
    by_line = f"IF(n_lines > 0, coalesce(IF(forall({mine}, t -> t.whole), {_round(total, 2)}, NULL), 0D), NULL)"
    fits = f"coalesce(NOT p.explained AND abs(p.amount - p.by_line) <= {tolerance!r}D, false)"
    resolved = f"CASE WHEN p.exact IS NULL THEN p.amount WHEN p.explained OR {fits} THEN p.amount ELSE p.rounded END"
    plain = lambda name: _round(f"aggregate(parts, 0D, (s, p) -> s + coalesce(p.{name}, 0D))", 2)
    use_cut = f"""coalesce(subtotal IS NOT NULL AND abs(_sum - tax_amount) > {tolerance!r}D AND forall(parts, p -> p.rate IS NOT NULL)
        AND abs(_cut_sum - tax_amount) <= {tolerance!r}D, false)"""
    values = "filter(transform(parts, p -> p.calculated_amount), v -> v IS NOT NULL)"
    exact = f"IF(forall({values}, v -> try_cast(v AS DECIMAL(28,6)) IS NOT NULL), {added(f'transform({values}, v -> try_cast(v AS DECIMAL(28,6)))')}, NULL)"
    return (
        docs.withColumn("parts", _grown(base, by_line=by_line))
        .withColumn("parts", _grown(base, resolved=resolved))
        .withColumns({"_sum": F.expr(plain("resolved")), "_cut_sum": F.expr(plain("cut"))})
        .withColumn("_use_cut", F.expr(use_cut))
        .withColumn("parts", _grown("component_order name rate amount", calculated_amount="IF(_use_cut, p.cut, p.resolved)"))
        .withColumns(
            {
                "n_components": F.size("parts"),
                "_exact": F.expr(f"coalesce({exact}, 0D)"),
                "component_formula": F.expr("concat(array_join(transform(parts, p -> concat(p.name, '_amount')), ' + '), ' == tax_amount')"),
                "any_amountless": F.expr("exists(parts, p -> p.amount IS NULL)"),
            }
        )
        .withColumn("component_sum", F.expr(_round("_exact", 4)))
        .drop("_sum", "_cut_sum", "_use_cut", "_exact", "line_taxes")
    )


def part_rows(docs: DataFrame, *columns: str) -> DataFrame:
    """One row per component of each document."""
    exploded = docs.select("doc_id", F.explode_outer("parts").alias("_part")).where("_part IS NOT NULL")  # outer: see meet_lines
    return exploded.select("doc_id", *[F.col(f"_part.{c}").alias(c) for c in columns])
