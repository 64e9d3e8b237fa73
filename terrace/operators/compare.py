"""Comparing frames: by key, by position, within a tolerance; and digests of their content."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.operators.matching import unmatched
from terrace.sources.scratch import stored

SAMPLES = 3
_KINDS = {"bigint": "number", "int": "number", "smallint": "number", "tinyint": "number", "double": "number", "float": "number", "string": "text", "boolean": "bool", "date": "time", "timestamp": "time", "timestamp_ntz": "time"}


@dataclass
class Comparison:
    equal: bool
    why: list[str] = field(default_factory=list)
    differing: dict[str, int] = field(default_factory=dict)
    samples: dict[str, list] = field(default_factory=dict)


def close(a: Column, b: Column, kind: str, rtol: float = 0.0, atol: float = 0.0) -> Column:
    """Equal, nulls and NaN each equal to themselves; numbers within atol + rtol * |b|."""
    same = a.eqNullSafe(b)
    if kind in ("double", "float") and (rtol or atol):
        near = F.abs(a - b) <= atol + rtol * F.abs(b)
        return same | F.coalesce(~F.isnan(a) & ~F.isnan(b) & near, F.lit(False))
    return same


def kind_of(dtype: str) -> str:
    return _KINDS.get(dtype, dtype.partition("(")[0])


def compare_frames(reference: DataFrame, other: DataFrame, key: Sequence[str] = (), rtol: float = 0.0, atol: float = 0.0) -> Comparison:
    """Whether two frames hold the same rows; the order of columns and rows does not matter.

    Missing and extra columns, kinds of types, row counts, keys that are absent or repeat in the
    reference, and the differing values by column with a few samples. Without a key, rows pair off one to
    one by a largest matching (see matching), and what is left alone is counted and sampled by side.
    """
    why = [f"missing column {c}" for c in sorted(set(reference.columns) - set(other.columns))]
    why += [f"extra column {c}" for c in sorted(set(other.columns) - set(reference.columns))]
    kinds, theirs = dict(reference.dtypes), dict(other.dtypes)
    shared = [c for c in reference.columns if c in theirs]
    why += [f"{c} is {kind_of(theirs[c])}, not {kind_of(kinds[c])}" for c in shared if kind_of(kinds[c]) != kind_of(theirs[c])]
    n, m = reference.count(), other.count()
    if n != m:
        return Comparison(False, [*why, f"{m} rows, not {n}"])
    if absent := [k for k in key if k not in shared]:
        return Comparison(False, [*why, f"no key column {absent[0]}"])
    if not key:
        alone = stored(unmatched(reference.select(*shared), other.select(*shared), rtol, atol), "alone")
        counts = {r["side"]: r["n"] for r in alone.groupBy("side").agg(F.sum("n").alias("n")).collect()}
        samples = {side: [tuple(r) for r in alone.filter(F.col("side") == side).select(*shared).limit(SAMPLES).collect()] for side in counts}
        if counts:
            why.append(f"{sum(counts.values())} rows have no partner")
        return Comparison(not why, why, {}, samples)
    if repeated := reference.groupBy(*key).count().filter("count > 1").limit(1).count():
        return Comparison(False, [*why, f"the key repeats ({repeated} or more)"])
    a = reference.select(*[F.col(c).alias(f"a_{c}") for c in shared], F.lit(True).alias("a_there"))
    b = other.select(*[F.col(c).alias(f"b_{c}") for c in shared], F.lit(True).alias("b_there"))
    on = [F.col(f"a_{k}").eqNullSafe(F.col(f"b_{k}")) for k in key]
    both = a.join(b, on, "full_outer")
    values = [c for c in shared if c not in key]
    broken = {c: ~close(F.col(f"a_{c}"), F.col(f"b_{c}"), kinds[c], rtol, atol) for c in values}
    there = F.col("a_there").isNotNull() & F.col("b_there").isNotNull()
    row = both.agg(F.count_if(~F.coalesce(there, F.lit(False))).alias("unmatched"), *[F.count_if(there & x).alias(c) for c, x in broken.items()]).first().asDict()
    differing = {c: row[c] for c in values if row[c]}
    samples = {c: [tuple(r) for r in both.filter(there & broken[c]).orderBy(*[f"a_{k}" for k in key]).select(*[f"a_{k}" for k in key], f"a_{c}", f"b_{c}").limit(SAMPLES).collect()] for c in differing}
    if row["unmatched"]:
        why.append(f"{row['unmatched']} rows have no partner")
    return Comparison(not why and not differing, why, differing, samples)


def cell_differences(base: DataFrame, other: DataFrame, ordinal: str = "_ordinal") -> DataFrame:
    """(column, cells) by position: cells that differ, for every column of base that other has in
    the same type; nulls are equal."""
    theirs = dict(other.dtypes)
    columns = [c for c, t in base.dtypes if c != ordinal and theirs.get(c) == t]
    a = base.select(ordinal, *[F.col(c).alias(f"a_{c}") for c in columns])
    b = other.select(ordinal, *[F.col(c).alias(f"b_{c}") for c in columns])
    counts = [F.struct(F.lit(c).alias("column"), F.count_if(~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))).alias("cells")) for c in columns]
    return a.join(b, ordinal).agg(F.array(*counts).alias("all")).select(F.inline("all"))


def same_result(a: DataFrame, b: DataFrame, key: Sequence[str], rtol: float = 1e-9) -> bool:
    """Same columns, whole numbers and text exactly, doubles within rtol, NaN at the same places."""
    return list(a.columns) == list(b.columns) and compare_frames(a, b, key, rtol).equal


def content_digest(df: DataFrame) -> DataFrame:
    """(rows, digest): a digest of a frame's rows whatever their order and partitioning.

    Each row becomes the SHA-256 of its canonical JSON; eight slices of 28 bits of it are summed up
    exactly, so the digest is one aggregation and repeated rows count.
    """
    columns = sorted(df.columns)
    row = F.sha2(F.to_json(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("\0null")).alias(c) for c in columns])), 256)
    sums = [F.sum(F.conv(F.substring(row, 1 + 7 * i, 7), 16, 10).cast("decimal(38,0)")).cast("string") for i in range(8)]
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sha2(F.concat_ws(",", F.lit(",".join(columns)), F.count(F.lit(1)).cast("string"), *sums), 256).alias("digest"))


def observed_class(completed: Column, equivalent: Column, warned: Column) -> Column:
    """reject, accept_equiv or accept_nonequiv, with _warn behind an accept that warned."""
    accepted = F.concat(F.when(equivalent, "accept_equiv").otherwise("accept_nonequiv"), F.when(warned, "_warn").otherwise(""))
    return F.when(completed, accepted).otherwise("reject")


def verdict(kind: Column, observed: Column) -> Column:
    """Of a mutation that preserves (P) or breaks (B) the meaning, given what was observed."""
    preserving = F.when(observed == "reject", "false_reject").when(F.startswith(observed, F.lit("accept_equiv")), "correct_accept").otherwise("silent_corruption")
    breaking = F.when(observed == "reject", "correct_reject").when(F.endswith(observed, F.lit("_warn")), "warned").otherwise("false_accept")
    return F.when(kind == "P", preserving).otherwise(breaking)
