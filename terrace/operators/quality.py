"""Six quality metrics of a layer, all from one aggregation over one scan."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.functions import text as fn

TYPED = ("numeric", "date", "code")
METRICS = ("missing_rate", "parsing_failure_rate", "type_consistency", "code_validity", "schema_conformance", "duplicate_rate")


@dataclass(frozen=True)
class ColumnSpec:
    """kind: numeric, date, code or text. interpret reads the stored column (default: the naive view of
    its kind); minimum is exclusive; valid lists codes; predicate is a further bound."""

    name: str
    kind: str = "text"
    required: bool = True
    null_tokens: tuple[str, ...] = ()
    interpret: Callable[[Column], Column] | None = None
    minimum: float | None = None
    valid: tuple[str, ...] | None = None
    predicate: Callable[[Column], Column] | None = None


@dataclass(frozen=True)
class QualitySpec:
    columns: tuple[ColumnSpec, ...]
    key: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        names = [c.name for c in self.columns]
        if not names:
            raise ValueError("the specification has no column")
        if len(set(names)) < len(names):
            raise ValueError("a column is specified twice")


def _missing(c: ColumnSpec) -> Column:
    col = F.col(c.name)
    return col.isNull() | (col.cast("string").isin(list(c.null_tokens)) if c.null_tokens else F.lit(False))


def _value(c: ColumnSpec) -> Column:
    if c.interpret:
        return c.interpret(F.col(c.name))
    if c.kind == "numeric":
        return fn.to_float(fn.trimmed(c.name))
    if c.kind == "date":
        return fn.to_datetime(c.name)
    return F.col(c.name).cast("string")


def _unreadable(c: ColumnSpec) -> Column:
    return ~_missing(c) & _value(c).isNull()


def _fits(c: ColumnSpec) -> Column:
    value = _value(c)
    bounds = [value.isNotNull()]
    if c.minimum is not None:
        bounds.append(value > c.minimum)
    if c.valid is not None:
        bounds.append(value.cast("string").isin(list(c.valid)))
    if c.predicate:
        bounds.append(F.coalesce(c.predicate(value), F.lit(False)))
    return ~_missing(c) & F.coalesce(reduce(lambda a, b: a & b, bounds), F.lit(False))


def _share(part: Column, whole: Column, empty: float | None) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(empty).cast("double"))


def _sum(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns) if columns else F.lit(0)


def measure_quality(df: DataFrame, spec: QualitySpec, metrics: Sequence[str] = METRICS) -> DataFrame:
    """One row: rows and the metrics, and missing_<column> for each required column.

    missing_rate: missing cells of required columns; parsing_failure_rate: rows with a required cell
    that cannot be read; type_consistency: readable shares of the present cells of typed columns;
    code_validity: listed shares of present codes; schema_conformance: rows whose required cells are
    there, readable and in bounds; duplicate_rate: rows equal to another by key (else in whole).
    Null where there is nothing to measure. An empty table is refused by the caller's first look at
    `rows`; a missing column or an unknown metric is refused here.
    """
    for c in spec.columns:
        if c.name not in df.columns:
            raise ValueError(f"no column {c.name}")
    if unknown := [m for m in metrics if m not in METRICS]:
        raise ValueError(f"unknown metric {unknown[0]}")
    rows = F.count(F.lit(1))
    required = [c for c in spec.columns if c.required]
    typed = [c for c in spec.columns if c.kind in TYPED]
    codes = [c for c in spec.columns if c.valid is not None]
    present = lambda cs: _sum([F.count_if(~_missing(c)) for c in cs])
    found = {
        "missing_rate": _share(_sum([F.count_if(_missing(c)) for c in required]), rows * len(required), 0.0),
        "parsing_failure_rate": _share(F.count_if(reduce(or_, map(_unreadable, required))) if required else F.lit(0), rows, 0.0),
        "type_consistency": _share(present(typed) - _sum([F.count_if(_unreadable(c)) for c in typed]), present(typed), None),
        "code_validity": _share(_sum([F.count_if(~_missing(c) & F.coalesce(_value(c).cast("string").isin(list(c.valid)), F.lit(False))) for c in codes]), present(codes), None),
        "schema_conformance": _share(F.count_if(reduce(lambda a, b: a & b, map(_fits, required))), rows, 1.0) if required else F.lit(1.0),
        "duplicate_rate": _share(rows - F.count_distinct(F.struct(*(spec.key or df.columns))), rows, 0.0),
    }
    return df.agg(rows.alias("rows"), *[found[m].alias(m) for m in metrics], *[_share(F.count_if(_missing(c)), rows, 0.0).alias(f"missing_{c.name}") for c in required])


def per_column(df: DataFrame, spec: QualitySpec) -> DataFrame:
    """(column, missing_rate, parsing_failure_rate, schema_conformance) of each column as if it were
    the only one and required; one aggregation for all."""
    for c in spec.columns:
        if c.name not in df.columns:
            raise ValueError(f"no column {c.name}")
    rows = F.count(F.lit(1))
    rated = [
        F.struct(F.lit(c.name).alias("column"), _share(F.count_if(_missing(c)), rows, 0.0).alias("missing_rate"), _share(F.count_if(_unreadable(c)), rows, 0.0).alias("parsing_failure_rate"), _share(F.count_if(_fits(c)), rows, 1.0).alias("schema_conformance"))
        for c in spec.columns
    ]
    return df.agg(F.array(*rated).alias("all")).select(F.inline("all"))


def duplicate_rate(df: DataFrame, key: Sequence[str] = ()) -> DataFrame:
    """The share of rows that repeat an earlier row's key; nulls equal each other. Two-step counting:
    rows by key first, so that a frequent key costs one row a task."""
    groups = df.groupBy(*(key or df.columns)).count()
    return groups.agg(_share(F.sum("count") - F.count(F.lit(1)), F.sum("count"), 0.0).alias("duplicate_rate"))


def schema_report(df: DataFrame, order: str | None = None) -> DataFrame:
    """(column, type, present_share, example) by column; the example is the first by `order`, or the
    smallest value where the table has no order. One aggregation."""
    rows = F.count(F.lit(1))
    kinds = dict(df.dtypes)
    columns = [c for c in df.columns if c != order]
    example = lambda c: F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))) if order else F.min(c)
    told = [F.struct(F.lit(c).alias("column"), F.lit(kinds[c]).alias("type"), _share(F.count(c), rows, 0.0).alias("present_share"), example(c).cast("string").alias("example")) for c in columns]
    return df.agg(F.array(*told).alias("all")).select(F.inline("all"))


def macro(reports: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Unweighted means of metrics, nulls left out."""
    return reports.agg(*[F.avg(m).alias(m) for m in metrics])
