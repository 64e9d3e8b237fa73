"""Reading texts once a value instead of once a row.

Columns of few different values (districts, months, names) are split off into a dictionary of their
(value, type) pairs. Text functions run over the dictionary alone; the rows get the results back by a
broadcast join. Whether a dictionary is worth it, and may be broadcast, is measured: one aggregation
over the source counts all groups' different values, and only groups that shrink enough take that road.
The others evaluate row by row. Both roads give the same rows.

`encoded` keeps the two apart for layers that are read many times: rows hold a dense code, the values
lie beside them, and every later evaluation is a join by small whole numbers.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrace.functions.json_types import json_kind, json_text
from terrace.sources.scratch import stored

#: A dictionary may have this many values and bytes of text; it must be this many times smaller than the rows.
MOST, MOST_BYTES, SHRINK = 100_000, 8 << 20, 8


@dataclass(frozen=True)
class Group:
    """Columns that are read together, and what is read out of them: name -> expression over the inputs."""

    inputs: Sequence[str]
    outputs: Mapping[str, Column] = field(default_factory=dict)


def _keys(df: DataFrame, inputs: Sequence[str]) -> list[Column]:
    """What tells two inputs apart. A variant has no equality: its type and its text have."""
    kinds = dict(df.dtypes)
    return [k for c in inputs for k in ((json_kind(c), json_text(c)) if kinds[c] == "variant" else (F.col(c),))]


def _on(number: int, width: int) -> list[str]:
    return [f"__k{number}_{i}" for i in range(width)]


def shrinking(df: DataFrame, groups: Sequence[Group], most: int = MOST, shrink: float = SHRINK) -> list[bool]:
    """For each group whether its values are few enough, by one aggregation that estimates them all."""
    counts = [F.approx_count_distinct(F.xxhash64(*_keys(df, g.inputs)), 0.02).alias(f"n{i}") for i, g in enumerate(groups)]
    row = df.agg(F.count(F.lit(1)).alias("rows"), *counts).first()
    return [row[f"n{i}"] <= most and row[f"n{i}"] * shrink <= row["rows"] for i in range(len(groups))]


def values_of(df: DataFrame, groups: Sequence[Group]) -> DataFrame:
    """(__group, and for each group its keys and inputs): the different (value, type) pairs of all groups,
    null in the columns of the others, by one pass over the source. Nulls are values."""
    keys = [_keys(df, g.inputs) for g in groups]
    named = [(n, k) for i, ks in enumerate(keys) for n, k in zip(_on(i, len(ks)), ks, strict=True)]
    types = dict(df.dtypes)
    inputs = list(dict.fromkeys(c for g in groups for c in g.inputs))
    variants = [c for c in inputs if types[c] == "variant"]
    table = df.select(*[k.alias(n) for n, k in named], *variants)
    kinds = dict(table.dtypes)
    each, known = [], {}
    for i, g in enumerate(groups):
        names = _on(i, len(keys[i]))
        own, left = {*names, *g.inputs}, iter(names)
        known |= {c: next(left) for c in g.inputs for _ in range(1 + (types[c] == "variant"))}
        each.append(F.struct(F.lit(i).alias("__group"), *[(F.col(c) if c in own else F.lit(None).cast(kinds[c])).alias(c) for c in table.columns]))
    grouped = table.select(F.inline(F.array(*each))).groupBy("__group", *dict(named))
    # Other inputs are their own keys: without an aggregate of texts the rows are grouped by hash, not by a
    # sort. Of variants any one stands for those of its type and text.
    found = grouped.agg(*[F.any_value(c).alias(c) for c in variants]) if variants else grouped.agg(F.count(F.lit(1)).alias("__n"))
    return found.select("__group", *dict(named), *[F.col(c if c in variants else known[c]).alias(c) for c in inputs])


def _sizes(values: DataFrame) -> dict[int, tuple[int, int]]:
    """(rows, bytes) of each group's stored dictionary: no longer an estimate."""
    size = F.lit(0)
    for c, kind in values.dtypes:
        size = size + F.when(F.col(c).isNotNull(), F.octet_length(c) if kind in ("string", "binary") else F.lit(16)).otherwise(0)
    return {r["__group"]: (r["n"], r["bytes"]) for r in values.groupBy("__group").agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes")).collect()}


def _small(size: tuple[int, int], most: int) -> bool:
    """Whether a dictionary may be broadcast."""
    return size[0] <= 2 * most and size[1] <= MOST_BYTES


def _same(df: DataFrame, number: int, inputs: Sequence[str]) -> Column:
    """Rows of df and of a dictionary that belong together; nulls are equal."""
    same, keys = F.lit(True), _keys(df, inputs)
    for n, key in zip(_on(number, len(keys)), keys, strict=True):
        same = same & key.eqNullSafe(F.col(n))
    return same


def evaluated(df: DataFrame, groups: Sequence[Group], most: int = MOST, shrink: float = SHRINK, roads: Sequence[bool] | None = None) -> DataFrame:
    """df without the groups' inputs and with their outputs. No input may belong to two groups.

    roads says for each group whether to go by its values, for callers who know; else it is measured.
    A group that is sent there and turns out too large to broadcast is joined by shuffle.
    """
    roads = shrinking(df, groups, most, shrink) if roads is None else roads
    gone = {c for g in groups for c in g.inputs}
    taken, read = df, {n: c for g, by_value in zip(groups, roads, strict=True) if not by_value for n, c in g.outputs.items()}
    few = [g for g, by_value in zip(groups, roads, strict=True) if by_value]
    if few:
        values = stored(values_of(df, few), "values")
        sizes = _sizes(values)
        for number, group in enumerate(few):
            keys = [c for c in values.columns if c.startswith(f"__k{number}_")]
            told = values.filter(F.col("__group") == number).select(*keys, *[c.alias(f"__{number}_{n}") for n, c in group.outputs.items()])
            told = F.broadcast(told) if _small(sizes.get(number, (0, 0)), most) else told
            # Every value of the rows is in the dictionary, so an inner join keeps each row once.
            taken = taken.join(told, _same(df, number, group.inputs)).drop(*keys)
            read |= {n: F.col(f"__{number}_{n}") for n in group.outputs}
    kept = [c for c in df.columns if c not in gone]
    return taken.select(*kept, *[read[n].alias(n) for g in groups for n in g.outputs])


@dataclass
class Encoded:
    """rows: a frame whose group is replaced by `code`, 0 to n - 1 in the order of the values (or the frame
    as it was, where values is none); values: code and inputs."""

    rows: DataFrame
    values: DataFrame | None
    group: Group
    code: str

    def read(self, outputs: Mapping[str, Column]) -> DataFrame:
        """The rows with what the outputs read out of the group's inputs, in place of these."""
        kept = [c for c in self.rows.columns if c not in (*self.group.inputs, self.code)]
        if self.values is None:
            return self.rows.select(*kept, *[c.alias(n) for n, c in outputs.items()])
        told = self.values.select(F.col(self.code), *[c.alias(f"__{n}") for n, c in outputs.items()])
        return self.rows.join(F.broadcast(told), self.code).select(*kept, *[F.col(f"__{n}").alias(n) for n in outputs])

    def decoded(self) -> DataFrame:
        """The frame as it was."""
        return self.read({c: F.col(c) for c in self.group.inputs})


def encoded(df: DataFrame, inputs: Sequence[str], code: str = "code", most: int = MOST, shrink: float = SHRINK) -> Encoded:
    """Splits a dictionary off a frame, where its values are few and small; else nothing changes."""
    group = Group(inputs)
    if not shrinking(df, [group], most, shrink)[0]:
        return Encoded(df, None, group, code)
    values = stored(values_of(df, [group]), "values")
    if not _small(_sizes(values).get(0, (0, 0)), most):
        return Encoded(df, None, group, code)
    keys = [c for c in values.columns if c.startswith("__k0_")]
    # At most 2 * most rows are numbered in one place.
    numbered = stored(values.withColumn(code, (F.row_number().over(Window.orderBy(*keys)) - 1).cast("int")), "codes")
    rows = df.join(F.broadcast(numbered.select(code, *keys)), _same(df, 0, inputs)).select(*[c for c in df.columns if c not in inputs], code)
    return Encoded(rows, numbered.select(code, *inputs), group, code)
