"""Cell-by-cell comparison of two layers: which cells changed, and why."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.functions.json_types import json_kind, json_text
from terrace.functions.text import NUMERIC, trimmed, zfill
from terrace.operators.roles import Role, holds, interpreted, padded, read, stored_value

#: The names of the causes, in the order in which their rules are tried.
CAUSES = (
    "unchanged",
    "unreadable_lossy",
    "other:semantic_difference",
    "derived_field",
    "null_canonicalization",
    "date_year_month_normalization",
    "identifier_padding",
    "numeric_formatting",
    "primitive_type_normalization",
    "other",
)
ORDINAL = "_ordinal"


def token(df: DataFrame, column: str) -> Column:
    """What is stored, with its type: struct(kind, value). 1, 1.0 and "1" differ; null has kind null."""
    kind = dict(df.dtypes)[column]
    c = F.col(column)
    if kind == "variant":
        name, text = json_kind(c), json_text(c)
    else:
        static = {"bigint": "int", "int": "int", "smallint": "int", "tinyint": "int", "double": "float", "float": "float", "string": "str", "boolean": "bool", "date": "date"}
        name, text = F.lit(static.get(kind, kind)), c.cast("string")
        if kind in ("double", "float"):
            text = F.when(~F.isnan(c), text)
    return F.struct(F.when(text.isNull(), "null").otherwise(F.coalesce(name, F.lit("null"))).alias("kind"), text.alias("value"))


def _texts(roles: Sequence[Role], df: DataFrame, layer: str, side: str = "") -> DataFrame:
    """_ordinal and for each role, by its number, `<side>t` (stored text) and `<side>k` (type of what is stored)."""

    def kind(role: Role) -> Column:
        names = [c for c in (role.bronze if layer == "bronze" else role.silver) if c in df.columns]
        return F.lit("str") if len(names) > 1 else token(df, names[0])["kind"]

    return df.select(ORDINAL, *[c for i, r in enumerate(roles) for c in (stored_value(r, layer, df.columns).cast("string").alias(f"{side}t{i}"), kind(r).alias(f"{side}k{i}"))])


def _cell(role: Role, text: Column, kind: Column, value: Column) -> tuple[Column, ...]:
    """A cell's stored text, type of what is stored, whether it can be read, and canonical value."""
    return text, F.when(text.isNull(), "null").otherwise(kind), ~holds(text, role.null_tokens) | value.isNotNull(), padded(role, value)


def _cells(roles: Sequence[Role], df: DataFrame, layer: str, side: str) -> DataFrame:
    """_ordinal and for each role a struct `<side>_<role>` of its cell, t, k, r and v. Text, reading and
    padding are a projection each, so that no cell is read twice."""
    values = _texts(roles, df, layer).select("*", *[read(r, F.col(f"t{i}")).alias(f"v{i}") for i, r in enumerate(roles)])
    cells = [_cell(r, *(F.col(f"{c}{i}") for c in "tkv")) for i, r in enumerate(roles)]
    return values.select(ORDINAL, *[F.struct(*[c.alias(n) for n, c in zip("tkrv", cell, strict=True)]).alias(f"{side}_{r.name}") for r, cell in zip(roles, cells, strict=True)])


def cause(role: Role, b: tuple[Column, ...], s: tuple[Column, ...]) -> Column:
    """The first rule that explains a cell's change. b and s: its cells in bronze and silver.

    Unchanged is the same text of the same type. Cells that cannot be read or stand for different
    values come next; then what the role's declaration explains, from derivation to plain typing.
    """
    btext, bkind, breadable, bvalue = b
    stext, skind, sreadable, svalue = s
    was_text, is_text = bkind == "str", skind == "str"
    out = (
        F.when(btext.eqNullSafe(stext) & (bkind == skind), "unchanged")
        .when(~breadable | ~sreadable, "unreadable_lossy")
        .when(~bvalue.eqNullSafe(svalue), "other:semantic_difference")
    )
    if role.kind == "parts":
        return out.otherwise("derived_field")
    if role.null_tokens:
        out = out.when((skind == "null") & was_text & trimmed(btext).isin(list(role.null_tokens)), "null_canonicalization")
    if role.cast in ("year_month", "date", "datetime"):
        return out.otherwise("date_year_month_normalization")
    if role.zfill:
        out = out.when(was_text & is_text & (zfill(trimmed(btext), role.zfill) == stext), "identifier_padding")
    if role.cast in NUMERIC:
        return out.when(was_text & F.contains(btext, F.lit(",")), "numeric_formatting").otherwise("primitive_type_normalization")
    if role.cast is None:
        out = out.when(bkind.isin("int", "float") & is_text, "primitive_type_normalization")
    return out.otherwise("other")


def structural(role: Role) -> str:
    """How the role's column itself changed: derived, coalesce, rename or same_name."""
    if role.kind != "direct":
        return {"parts": "derived"}.get(role.kind, role.kind)
    return "same_name" if role.bronze[0] == role.name else "rename"


def _verdict(role: Role, b: tuple[Column, ...], s: tuple[Column, ...]) -> Column:
    """What is counted of a pair of cells."""
    comparable = b[2] & s[2]
    return F.struct(F.lit(role.name).alias("role"), F.lit(role.required).alias("required"), cause(role, b, s).alias("cause"), comparable.alias("comparable"), (comparable & b[3].eqNullSafe(s[3])).alias("preserved"))


def _pairs(bronze: DataFrame, silver: DataFrame, roles: Sequence[Role]) -> DataFrame:
    """(role, required, cause, comparable, preserved, n): each row's cells are read, then paired."""
    both = _cells(roles, bronze, "bronze", "b").join(_cells(roles, silver, "silver", "s"), ORDINAL)
    found = [_verdict(r, *(tuple(F.col(f"{side}_{r.name}")[n] for n in "tkrv") for side in "bs")) for r in roles]
    return both.select(F.inline(F.array(*found)), F.lit(1).cast("bigint").alias("n"))


def _pairs_by_value(bronze: DataFrame, silver: DataFrame, roles: Sequence[Role]) -> DataFrame:
    """_pairs with the stored texts paired first: each different pair of a role is counted, on the map
    side, and read once with its count. No layer is passed over twice and nothing is broadcast."""
    both = _texts(roles, bronze, "bronze", "b").join(_texts(roles, silver, "silver", "s"), ORDINAL)
    names = ("bt", "bk", "st", "sk")
    each = [F.struct(F.lit(i).alias("i"), *[F.col(f"{n}{i}").alias(n) for n in names]) for i in range(len(roles))]
    counted = both.select(F.inline(F.array(*each))).groupBy("i", *names).agg(F.count(F.lit(1)).alias("n"))
    # One reader a role, of which a pair meets its own only.
    of_role = lambda made: F.coalesce(*[F.when(F.col("i") == i, made(r)) for i, r in enumerate(roles)])
    values = counted.select("*", *[of_role(lambda r, t=t: read(r, F.col(t))).alias(v) for t, v in (("bt", "bv"), ("st", "sv"))])
    found = of_role(lambda r: _verdict(r, *(_cell(r, *(F.col(f"{side}{c}") for c in "tkv")) for side in "bs")))
    return values.select(found.alias("found"), "n").select("found.*", "n")


def pair_and_classify(bronze: DataFrame, silver: DataFrame, roles: Sequence[Role], by_value: bool = True) -> DataFrame:
    """(role, required, rows, changed, comparable, preserved, and a column for each cause), one row a role.

    Layers are paired by _ordinal. changed: what is stored differs; comparable: both sides can be
    read; preserved: comparable and of the same value. Causes add up to rows. by_value reads each
    different pair of texts once; else every row's cells are read.
    """
    pairs = (_pairs_by_value if by_value else _pairs)(bronze, silver, roles)
    # Counted by what can differ first: few rows, on the map side; then spread over columns.
    long = pairs.groupBy("role", "required", "cause", "comparable", "preserved").agg(F.sum("n").alias("n"))
    of = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))
    return long.groupBy("role", "required").agg(
        F.sum("n").alias("rows"),
        of(F.col("cause") != "unchanged").alias("changed"),
        of(F.col("comparable")).alias("comparable"),
        of(F.col("preserved")).alias("preserved"),
        *[of(F.col("cause") == c).alias(c) for c in CAUSES],
    )


def rates(pairs: DataFrame) -> DataFrame:
    """Adds change_rate, coverage and preservation (null where nothing is comparable)."""
    return pairs.withColumns({"change_rate": F.try_divide("changed", "rows"), "coverage": F.try_divide("comparable", "rows"), "preservation": F.try_divide("preserved", F.when(F.col("comparable") > 0, F.col("comparable")))})


def aggregate(pairs: DataFrame, required_only: bool = False) -> DataFrame:
    """Rates of all roles together, from summed counts and never from means of rates."""
    kept = pairs.filter("required") if required_only else pairs
    return rates(kept.agg(*[F.sum(c).alias(c) for c in ("rows", "changed", "comparable", "preserved")]))


def row_identity_violations(bronze: DataFrame, silver: DataFrame, roles: Sequence[Role]) -> DataFrame:
    """The _ordinals at which a required role cannot be read or differs between the layers."""
    required = [r for r in roles if r.required]
    if not required:
        raise ValueError("no role is required: rows have no identity")
    value = lambda df, layer, r: interpreted(r, stored_value(r, layer, df.columns))
    left = bronze.select(F.col(ORDINAL), *[value(bronze, "bronze", r).alias(f"b_{r.name}") for r in required])
    right = silver.select(F.col(ORDINAL), *[value(silver, "silver", r).alias(f"s_{r.name}") for r in required])
    same = F.lit(True)
    for r in required:
        same = same & F.coalesce(F.col(f"b_{r.name}") == F.col(f"s_{r.name}"), F.lit(False))
    return left.join(right, ORDINAL, "full_outer").filter(~same).select(ORDINAL)


def assert_row_identity(bronze: DataFrame, silver: DataFrame, roles: Sequence[Role]) -> None:
    bad = row_identity_violations(bronze, silver, roles).orderBy(ORDINAL)
    first = [r[0] for r in bad.limit(5).collect()]
    if first:
        raise ValueError(f"rows differ between the layers at {first} (the first of {bad.count()})")
