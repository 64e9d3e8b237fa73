"""Contracts: a declarative description of a source that compiles to one Spark plan.

The rules run in a fixed order: read_as, null_tokens, column_null_tokens, coalesce, rename, zfill,
casts, derived, required. Rules about columns are checked against the schema when the contract is
compiled; rules about values are counted by one aggregation, and any count above zero refuses the
source. Nothing is ever skipped silently.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from terrace.functions import text as fn
from terrace.functions.json_types import json_text, type_bit

#: What read_as can read a value as, and the rules of a quality policy.
READ_AS = {"str"}
RULES = {"range", "max_null_ratio", "max_duplicate_rate", "min_rows", "compare_columns"}
KEYS = {"read_as", "null_tokens", "column_null_tokens", "coalesce", "rename", "zfill", "casts", "derived", "required", "quality"}


class ContractError(ValueError):
    """A source that a contract refuses: the stage, the column and how many values."""

    def __init__(self, stage: str, column: str, count: int = 0, why: str = "") -> None:
        self.stage, self.column, self.count = stage, column, count
        super().__init__(f"{stage}: {column}: {why or 'refused'}" + (f" ({count} values)" if count else ""))


@dataclass(frozen=True)
class Contract:
    read_as: Mapping[str, str] = field(default_factory=dict)
    null_tokens: Sequence[str] = ()
    column_null_tokens: Mapping[str, Mapping] = field(default_factory=dict)
    coalesce: Mapping[str, Sequence[str]] = field(default_factory=dict)
    rename: Mapping[str, str] = field(default_factory=dict)
    zfill: Mapping[str, int] = field(default_factory=dict)
    casts: Mapping[str, str] = field(default_factory=dict)
    derived: Mapping[str, Mapping] = field(default_factory=dict)
    required: Sequence[str] = ()
    quality: Mapping[str, Mapping] = field(default_factory=dict)

    @staticmethod
    def of(spec: Mapping) -> Contract:
        """A contract from plain data; keys that it does not know are refused."""
        unknown = sorted(set(spec) - KEYS)
        if unknown:
            raise ContractError("contract", ", ".join(unknown), why="unsupported key")
        for kind in dict(spec.get("read_as", {})).values():
            if kind not in READ_AS:
                raise ContractError("contract", str(kind), why="unsupported read_as")
        for name, rule in dict(spec.get("quality", {})).items():
            if rule.get("rule") not in RULES:
                raise ContractError("quality", name, why=f"unsupported rule {rule.get('rule')}")
        for kind in dict(spec.get("casts", {})).values():
            if kind not in fn.CASTS:
                raise ContractError("contract", str(kind), why="unsupported cast")
        for rule in dict(spec.get("derived", {})).values():
            if rule.get("kind") != "date_parts":
                raise ContractError("contract", str(rule.get("kind")), why="unsupported derivation")
        return Contract(**spec)


@dataclass
class Compiled:
    """silver: the standardised frame. guards: (stage, column) -> an aggregate that counts what
    breaks a rule (for mixed JSON types: the types beyond one), over `staged`, the frame with every
    step's values side by side. broken: those of the rules that a single row can break, told row by
    row. quality: the policy that silver must keep; warnings: what it only warned of."""

    silver: DataFrame
    staged: DataFrame
    guards: dict[tuple[str, str], Column]
    broken: dict[tuple[str, str], Column] = field(default_factory=dict)
    quality: Mapping[str, Mapping] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)

    def counts(self) -> DataFrame:
        """One row: for each guard the number of values that break it, in one pass."""
        return self.staged.agg(*[g.alias("__".join(k)) for k, g in self.guards.items()]) if self.guards else self.staged.agg(F.lit(0).alias("none"))

    def checked(self) -> DataFrame:
        """silver, after one aggregation has found no broken rule and another, if there is a policy, no
        violation of it; the first broken one raises."""
        row = self.counts().first().asDict()
        for stage, column in self.guards:
            if n := row[f"{stage}__{column}"]:
                raise ContractError(stage, column, n)
        if self.quality:
            self._within_policy(self.silver)
        return self.silver

    def enforced(self) -> DataFrame:
        """silver with the rules in its own plan: the first row that breaks one ends the query, so that
        refusing a source costs no second pass over it. Rules over all rows (mixed JSON types, a
        quality policy) are checked beforehand, as checked() does.

        The rules stand above the projection that reads the texts and cannot sink below it, so every
        cast is evaluated once for its value and its rule.
        """
        if set(self.guards) - set(self.broken) or self.quality:
            self.checked()
        if not self.broken:
            return self.silver
        rule = F.lit(None).cast("string")
        for (stage, column), breaks in reversed(self.broken.items()):
            rule = F.when(breaks, f"{stage}: {column}: refused").otherwise(rule)
        # A projection with a value that is not deterministic is one that no filter passes.
        read = self.staged.withColumn("__at", F.spark_partition_id())
        # raise_error gives no value: the filter keeps every row that it lets pass.
        kept = F.when(rule.isNotNull(), F.raise_error(F.concat(rule, F.lit(" in partition "), F.col("__at").cast("string"))).cast("boolean")).otherwise(F.col("__at") >= 0)
        return read.filter(kept).select(*self.silver.columns)

    def land(self, path: str, compression: str = "zstd") -> DataFrame:
        """Writes silver as a layer, fail-closed: one pass over the source writes the rows beside the
        layer's place and counts what breaks each rule; the layer takes its place by a rename, and
        only where every count is 0. A refused source leaves no layer and no files. The written rows,
        read again, come back; a quality policy is measured over them before the rename."""
        spark = self.staged.sparkSession
        fs = _files(spark, path)
        place, beside = (spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path.rstrip('/')}.{uuid.uuid4().hex}.part"))
        if fs.exists(place):
            raise FileExistsError(path)
        counted, source = Observation("contract"), self.staged
        if self.guards:
            source = source.observe(counted, *[g.cast("bigint").alias("__".join(k)) for k, g in self.guards.items()])
        try:
            source.select(*self.silver.columns).write.option("compression", compression).parquet(beside.toString())
            found = counted.get if self.guards else {}
            for stage, column in self.guards:
                # Without a row there is nothing counted.
                if n := found.get(f"{stage}__{column}") or 0:
                    raise ContractError(stage, column, n)
            if self.quality:
                self._within_policy(spark.read.schema(self.silver.schema).parquet(beside.toString()))
            if not fs.rename(beside, place):
                raise FileExistsError(path)
        finally:
            fs.delete(beside, True)
        return spark.read.schema(self.silver.schema).parquet(path)

    def _within_policy(self, silver: DataFrame) -> None:
        for r in quality_flags(silver, self.quality).filter("violations > 0").collect():
            if not r["warned"]:
                raise ContractError("quality", r["rule"], r["violations"])
            self.warnings.append(f"{r['rule']}: {r['violations']}")


def _files(spark: SparkSession, path: str):
    """The file system that a path lies in."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _present(columns: Sequence[str], wanted: str, stage: str) -> None:
    if wanted not in columns:
        raise ContractError(stage, wanted, why="no such column")


def compile_contract(contract: Contract, bronze: DataFrame) -> Compiled:
    """The plan that standardises bronze. Columns that no rule names pass through.

    Variant columns are read as text where read_as names them, else by their own type; a column that
    holds several JSON types and is not read as text breaks the heterogeneity guard.
    """
    guards: dict[tuple[str, str], Column] = {}
    broken: dict[tuple[str, str], Column] = {}
    df, columns = bronze, list(bronze.columns)
    kinds = dict(bronze.dtypes)

    typed = {}
    for c in columns:
        if kinds[c] == "variant":
            if c in contract.read_as:
                typed[c] = json_text(c)
            else:
                guards["heterogeneous", c] = F.greatest(F.bit_count(F.bit_or(f"__kind_{c}")) - 1, F.lit(0))
                df = df.withColumn(f"__kind_{c}", type_bit(c))
                typed[c] = F.try_variant_get(c, "$", "string")
        elif c in contract.read_as:
            typed[c] = F.col(c).cast("string")
    for c in contract.read_as:
        _present(columns, c, "read_as")
    df = df.withColumns(typed) if typed else df
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType) and f.name in columns]

    tokens = {c: list(contract.null_tokens) for c in texts}
    for c, rule in contract.column_null_tokens.items():
        if c not in columns:
            if rule.get("on_absent", "error") != "ignore":
                raise ContractError("column_null_tokens", c, why="no such column")
            continue
        tokens[c] = tokens.get(c, []) + list(rule["tokens"])
    df = df.withColumns({c: F.when(~F.col(c).isin(t), F.col(c)) for c, t in tokens.items() if t}) if any(tokens.values()) else df

    added = {}
    for target, candidates in contract.coalesce.items():
        there = [c for c in candidates if c in columns]
        if not there:
            raise ContractError("coalesce", target, why=f"none of {', '.join(candidates)} is there")
        values = F.array_distinct(F.array_compact(F.array(*there)))
        added[target] = F.coalesce(*there)
        broken["coalesce", target] = F.size(f"__all_{target}") > 1
        df = df.withColumn(f"__all_{target}", values)
    df = df.withColumns(added) if added else df
    consumed = {c for cs in contract.coalesce.values() for c in cs} - set(added)
    columns = [c for c in columns if c not in consumed and c not in added]

    for source in contract.rename:
        _present(columns, source, "rename")
    out = [contract.rename.get(c, c) for c in columns] + list(added)
    if len(set(out)) < len(out):
        raise ContractError("rename", ", ".join(sorted({c for c in out if out.count(c) > 1})), why="two columns of one name")
    marks = [c for c in df.columns if c.startswith("__")]
    df = df.select(*[F.col(c).alias(contract.rename.get(c, c)) for c in columns], *added, *marks)

    kinds = dict(df.dtypes)
    for c, width in contract.zfill.items():
        _present(out, c, "zfill")
        if kinds[c] != "string":
            raise ContractError("zfill", c, why=f"it is {kinds[c]}, not text")
        df = df.withColumn(c, fn.zfill(c, width))

    for c in contract.casts:
        _present(out, c, "casts")
    df = df.withColumns({f"__raw_{c}": F.col(c) for c in contract.casts} | {c: fn.CASTS[kind](c) for c, kind in contract.casts.items()}) if contract.casts else df
    broken |= {("casts", c): F.col(f"__raw_{c}").isNotNull() & F.col(c).isNull() for c in contract.casts}
    broken |= {("precision", c): _rounded(F.col(f"__raw_{c}"), F.col(c)) for c, kind in contract.casts.items() if kind.startswith("float")}

    for c, rule in contract.derived.items():
        parts = [rule["year"], rule["month"], rule["day"]]
        for p in parts:
            _present(out, p, "derived")
        df = df.withColumn(c, fn.date_of_parts(*parts))
        broken["derived", c] = reduce(lambda a, b: a & b, [F.col(p).isNotNull() for p in parts]) & F.col(c).isNull()
        out.append(c)

    for c in contract.required:
        _present(out, c, "required")
    return Compiled(df.select(*out), df, guards | {k: F.count_if(c) for k, c in broken.items()}, broken, contract.quality)


def _rounded(raw: Column, number: Column) -> Column:
    """Whether a whole number stands for another one as a double: from 2^53 on not all fit."""
    whole = F.regexp_replace(raw.cast("string"), r"[,\s]", "").try_cast("decimal(38,0)")
    return (F.abs(number) >= F.lit(float(1 << 53))) & (whole != number.try_cast("decimal(38,0)"))


def quality_flags(df: DataFrame, policy: Mapping[str, Mapping]) -> DataFrame:
    """(rule, violations, warned) for a quality policy, in one aggregation.

    Rules: range (min, max; both inclusive), max_null_ratio, max_duplicate_rate (over key),
    min_rows and compare_columns (left, op, right). A rule with severity warn only warns.
    """
    measures = {"rows": F.count(F.lit(1))}
    for name, rule in policy.items():
        kind = rule["rule"]
        if kind == "range":
            c = F.col(rule["column"])
            measures[name] = F.count_if((c < rule.get("min", float("-inf"))) | (c > rule.get("max", float("inf"))))
        elif kind == "max_null_ratio":
            measures[name] = F.count_if(F.col(rule["column"]).isNull())
        elif kind == "max_duplicate_rate":
            measures[name] = F.count(F.lit(1)) - F.count_distinct(F.struct(*rule["key"]))
        elif kind == "compare_columns":
            a, b = F.col(rule["left"]), F.col(rule["right"])
            holds = {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b, "==": a == b, "!=": a != b}[rule["op"]]
            measures[name] = F.count_if(~holds)
        elif kind == "min_rows":
            measures[name] = F.count(F.lit(1))
        else:
            raise ContractError("quality", name, why=f"unsupported rule {kind}")
    row = df.agg(*[m.alias(k) for k, m in measures.items()])
    verdicts = []
    for name, rule in policy.items():
        n, rows = F.col(name), F.col("rows")
        kind = rule["rule"]
        if kind in ("max_null_ratio", "max_duplicate_rate"):
            broken = F.when(n > rows * rule["ratio"], n).otherwise(0)
        elif kind == "min_rows":
            broken = F.when(n < rule["rows"], rule["rows"] - n).otherwise(0)
        else:
            broken = n
        verdicts.append(F.struct(F.lit(name).alias("rule"), broken.cast("bigint").alias("violations"), F.lit(rule.get("severity", "error") == "warn").alias("warned")))
    return row.select(F.inline(F.array(*verdicts)))


def drift(old: Mapping[str, str], new: Mapping[str, str], old_rows: int, new_rows: int, jump: float = 0.5) -> list[str]:
    """Warnings about a build against the one before it: columns that came or went, and row counts
    that moved by more than `jump` of the old."""
    out = [f"new column {c}" for c in sorted(set(new) - set(old))] + [f"removed column {c}" for c in sorted(set(old) - set(new))]
    if old_rows and abs(new_rows - old_rows) > jump * old_rows:
        out.append(f"rows {old_rows} -> {new_rows}")
    return out
