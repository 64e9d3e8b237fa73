"""Roles: the columns of a contract as both layers hold them, and how a layer's value is read."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.functions import text as fn
from terrace.operators.contract import Contract


@dataclass(frozen=True)
class Role:
    """kind: how the value came about (direct, coalesce or parts). bronze and silver: its columns."""

    name: str
    kind: str
    bronze: tuple[str, ...]
    silver: tuple[str, ...]
    cast: str | None = None
    required: bool = False
    null_tokens: tuple[str, ...] = ()
    zfill: int | None = None


def plan_roles(contract: Contract, columns: Sequence[str] = ()) -> list[Role]:
    """The roles of a contract by name. A required column that no rule and none of `columns`, those
    that pass through, gives a source is an error."""
    source_of = {dst: src for src, dst in contract.rename.items()}
    roles: dict[str, Role] = {}

    def tokens(*names: str) -> tuple[str, ...]:
        found = list(contract.null_tokens)
        for n in names:
            found += contract.column_null_tokens.get(n, {}).get("tokens", ())
        return tuple(dict.fromkeys(found))

    def add(name: str, kind: str, bronze: Sequence[str], silver: Sequence[str], cast: str | None = None) -> None:
        roles[name] = Role(name, kind, tuple(bronze), tuple(silver), cast or contract.casts.get(name), name in contract.required, tokens(name, *bronze), contract.zfill.get(name))

    for src, dst in contract.rename.items():
        add(dst, "direct", [src], [dst])
    for target, candidates in contract.coalesce.items():
        add(contract.rename.get(target, target), "coalesce", candidates, [contract.rename.get(target, target)])
    for name in contract.casts:
        if name not in roles:
            add(name, "direct", [source_of.get(name, name)], [name])
    for name, rule in contract.derived.items():
        parts = [rule["year"], rule["month"], rule["day"]]
        add(name, "parts", [source_of.get(p, p) for p in parts], [name], "date")
    for name in contract.required:
        if name not in roles:
            if name not in columns:
                raise ValueError(f"required column {name} has no source")
            add(name, "direct", [name], [name])
    return [roles[n] for n in sorted(roles)]


def holds(c: Column, tokens: Sequence[str]) -> Column:
    """There, and not a token for a missing value."""
    there = c.isNotNull()
    return there & ~c.cast("string").isin(list(tokens)) if tokens else there


def stored_value(role: Role, layer: str, columns: Sequence[str]) -> Column:
    """The role's stored value in a layer (bronze or silver), as it is spelt there.

    A coalesced role takes the first candidate that holds a value, else the first stored spelling;
    parts are joined as a date's text, in bronze only.
    """
    names = [c for c in (role.bronze if layer == "bronze" else role.silver) if c in columns]
    if not names:
        raise ValueError(f"{layer} has no column of role {role.name}")
    if role.kind == "parts" and layer == "bronze":
        return fn.date_text(*names)
    if role.kind == "coalesce" and len(names) > 1:
        return F.coalesce(*[F.when(holds(F.col(c), role.null_tokens), F.col(c)) for c in names], *map(F.col, names))
    return F.col(names[0])


def project(df: DataFrame, roles: Sequence[Role], layer: str, keep: Sequence[str] = ()) -> DataFrame:
    """One column a role, beside the columns named in keep."""
    return df.select(*keep, *[stored_value(r, layer, df.columns).alias(r.name) for r in roles])


def assert_symmetric(a: DataFrame, b: DataFrame) -> None:
    if set(a.columns) != set(b.columns):
        raise ValueError(f"the projections differ in {sorted(set(a.columns) ^ set(b.columns))}")


def interpreted(role: Role, stored: Column) -> Column:
    """The value that a stored spelling stands for, as text; null where missing or unreadable.

    Tokens count before anything is trimmed; the cast reads the rest, numbers and dates in their
    plain spelling; padding comes last.
    """
    return padded(role, read(role, stored.cast("string")))


def read(role: Role, text: Column) -> Column:
    """What the role's cast reads in a stored text, as text again."""
    value = F.when(holds(text, role.null_tokens), text)
    if role.cast:
        if role.cast not in fn.CASTS:
            raise ValueError(f"no interpreter for cast {role.cast} of role {role.name}")
        value = fn.CASTS[role.cast](value).cast("string")
    return value


def padded(role: Role, value: Column) -> Column:
    return fn.zfill(value, role.zfill) if role.zfill else value


def coalesce_sources(bronze: DataFrame, candidates: Sequence[str], tokens: Sequence[str] = ()) -> DataFrame:
    """(source, rows): how many rows each candidate supplied, in order; rows that none supplied
    have a null source. Candidates that supplied none are left out."""
    there = [c for c in candidates if c in bronze.columns]
    first = F.lit(None).cast("string")
    for c in reversed(there):
        first = F.when(holds(F.col(c), tokens), c).otherwise(first)
    return bronze.select(first.alias("source")).groupBy("source").agg(F.count(F.lit(1)).alias("rows"))


def tokens_of(role: Role) -> Mapping[str, tuple[str, ...]]:
    return {c: role.null_tokens for c in role.bronze}
