"""Controlled perturbation: mutations of a source that keep or break its meaning, and the verdict on
what a contract makes of each.

A mutation maps a bronze frame of variant or text columns to another one. Cells count as mutated
when their value or type changed.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.functions import text as fn
from terrace.operators import compare
from terrace.operators.contract import Contract, ContractError, compile_contract
from terrace.operators.pairing import token
from terrace.sources.records import ORDINAL

Change = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Mutation:
    """kind: P preserves the meaning, B breaks it. moved: pairs of columns whose cells it renames."""

    name: str
    kind: str
    apply: Change


def to_variant(c: Column) -> Column:
    """A scalar column as a JSON value of its type; null is absent."""
    return F.try_variant_get(F.parse_json(F.to_json(F.struct(c.alias("v")))), "$.v", "variant")


def text_of(c: str) -> Column:
    return F.try_variant_get(c, "$", "string")


def json_text(c: Column) -> Column:
    """A text column as JSON strings."""
    return to_variant(c.cast("string"))


def mapped(columns: Sequence[str], change: Callable[[Column], Column], when: Callable[[Column], Column] | None = None) -> Change:
    """Replaces the text of columns by change(text), a variant; where `when` is not true cells stay."""

    def run(df: DataFrame) -> DataFrame:
        new = {}
        for c in columns:
            if c in df.columns:
                t = text_of(c)
                condition = t.isNotNull() if when is None else F.coalesce(when(t), F.lit(False))
                new[c] = F.when(condition, change(t)).otherwise(F.col(c))
        return df.withColumns(new)

    return run


def alternate(column: str, change: Callable[[Column], Column]) -> Change:
    """Changes every second row."""
    return lambda df: df.withColumn(column, F.when((F.col(ORDINAL) % 2 == 0) & text_of(column).isNotNull(), change(text_of(column))).otherwise(F.col(column)))


def renamed(*pairs: tuple[str, str]) -> Change:
    def run(df: DataFrame) -> DataFrame:
        for old, new in pairs:
            df = df.withColumnRenamed(old, new)
        return df

    return run


def dropped(*columns: str) -> Change:
    return lambda df: df.drop(*columns)


def swapped(a: str, b: str) -> Change:
    return lambda df: df.withColumns({a: F.col(b), b: F.col(a)})


def nth_null(column: str, value: str | None, step: int = 10) -> Change:
    new = F.parse_json(F.lit("null")) if value is None else json_text(F.lit(value))
    return lambda df: df.withColumn(column, F.when(F.col(ORDINAL) % step == 0, new).otherwise(F.col(column)))


def reversed_keys(df: DataFrame) -> DataFrame:
    return df.select(*reversed(df.columns))


def with_row_number(df: DataFrame) -> DataFrame:
    return df.withColumn("RNUM", json_text((F.col(ORDINAL) + 1).cast("string")))


def added(column: str, value: Callable[[DataFrame], Column]) -> Change:
    return lambda df: df.withColumn(column, value(df))


def chained(*changes: Change) -> Change:
    def run(df: DataFrame) -> DataFrame:
        for c in changes:
            df = c(df)
        return df

    return run


def as_number(t: Column) -> Column:
    return F.parse_json(fn.to_int_comma(t).cast("string"))


def as_float(t: Column) -> Column:
    return F.parse_json(fn.to_float_comma(t).cast("string"))


def same(df: DataFrame) -> DataFrame:
    return df


def scaled(factor: int) -> Callable[[Column], Column]:
    return lambda t: json_text(F.format_number(fn.to_int_comma(t) * factor, 0))


def next_month(t: Column) -> Column:
    return json_text(F.date_format(F.add_months(F.concat(t, F.lit("-01")).try_cast("date"), 1), "yyyy-MM"))


def plain(t: Column) -> Column:
    return F.regexp_replace(t, "[,-]", "")


def area_in_pyeong(t: Column) -> Column:
    return json_text(F.format_string("%.2f", fn.to_float(t) / 3.305785))


def trades_mutations() -> list[Mutation]:
    a, area, day = "dealAmount", "excluUseAr", ("dealYear", "dealMonth", "dealDay")
    text_nullable = ("aptDong", "cdealType", "cdealDay", "dealingGbn", "estateAgentSggNm", "rgstDate", "slerGbn", "buyerGbn")
    return [
        Mutation("T-P00", "P", same),
        Mutation("T-P01", "P", mapped([a], as_number)),
        Mutation("T-P02", "P", mapped([a], lambda t: json_text(plain(t)))),
        Mutation("T-P03", "P", alternate(a, as_number)),
        Mutation("T-P04", "P", mapped(["floor"], json_text)),
        Mutation("T-P05", "P", alternate("floor", json_text)),
        Mutation("T-P06", "P", mapped(day, json_text)),
        Mutation("T-P07", "P", mapped([area], as_float)),
        Mutation("T-P08", "P", mapped(["sggCd", "umdCd"], json_text)),
        Mutation("T-P09", "P", mapped(["jibun"], as_number, lambda t: t.rlike("^[0-9]+$"))),
        Mutation("T-P10", "P", lambda df: df.withColumns({c: F.when(text_of(c).isNull(), json_text(F.lit(""))).otherwise(F.col(c)) for c in text_nullable if c in df.columns})),
        Mutation("T-P11", "P", reversed_keys),
        Mutation("T-P12", "P", with_row_number),
        Mutation("T-B01", "B", dropped(a)),
        Mutation("T-B02", "B", dropped("dealDay")),
        Mutation("T-B03", "B", dropped("sggCd")),
        Mutation("T-B04", "B", mapped([a], scaled(10))),
        Mutation("T-B05", "B", mapped([a], scaled(10_000))),
        Mutation("T-B06", "B", mapped([area], area_in_pyeong)),
        Mutation("T-B07", "B", swapped(a, area)),
        Mutation("T-B08", "B", renamed((a, "deposit"))),
        Mutation("T-B09", "B", swapped("dealMonth", "dealDay")),
        Mutation("T-B10", "B", nth_null(a, None)),
    ]


def bike_mutations() -> list[Mutation]:
    month, station, use, far, long = "대여일자", "대여소번호", "이용건수", "이동거리", "이용시간"
    none, empty = "\\N", ""
    return [
        Mutation("B-P00", "P", same),
        Mutation("B-P01", "P", mapped(["성별"], lambda t: json_text(F.lit(empty)), lambda t: t == none)),
        Mutation("B-P02", "P", mapped(["성별"], lambda t: json_text(F.lit(none)), lambda t: t == empty)),
        Mutation("B-P03", "P", mapped(["성별", "운동량", "탄소량"], lambda t: F.parse_json(F.lit("null")), lambda t: t.isin(none, empty))),
        Mutation("B-P04", "P", mapped(["운동량", "탄소량"], lambda t: json_text(F.lit(empty)), lambda t: t == none)),
        Mutation("B-P05", "P", mapped([station], lambda t: json_text(fn.zfill(t, 5)))),
        Mutation("B-P06", "P", mapped([station], lambda t: json_text(F.regexp_replace(t, "^0+(?=.)", "")))),
        Mutation("B-P07", "P", mapped([station], as_number)),
        Mutation("B-P08", "P", mapped([month], lambda t: json_text(plain(t)))),
        Mutation("B-P09", "P", mapped([month], lambda t: F.parse_json(plain(t)))),
        Mutation("B-P10", "P", alternate(month, lambda t: json_text(plain(t)))),
        Mutation("B-P11", "P", renamed((month, "대여년월"))),
        Mutation("B-P12", "P", renamed((far, "이동거리(M)"), (long, "이용시간(분)"))),
        Mutation("B-P13", "P", renamed((far, "이용거리(M)"), (long, "이용시간(본)"))),
        Mutation("B-P14", "P", reversed_keys),
        Mutation("B-P15", "P", with_row_number),
        Mutation("B-P16", "P", mapped([use], as_number)),
        Mutation("B-P17", "P", mapped([far, long], as_float, lambda t: ~t.isin(none, empty))),
        Mutation("B-B01", "B", dropped(use)),
        Mutation("B-B02", "B", dropped(station)),
        Mutation("B-B03", "B", dropped("성별", "연령대코드")),
        Mutation("B-B04", "B", chained(added("반납건수", lambda df: F.col(use)), renamed((use, "대여건수")))),
        Mutation("B-B05", "B", mapped([far], lambda t: json_text((fn.to_float(t) / 1000).cast("string")))),
        Mutation("B-B06", "B", swapped(far, long)),
        Mutation("B-B07", "B", chained(dropped(far), added("이동거리(M)", lambda df: F.col("운동량")))),
        Mutation("B-B08", "B", mapped([month], lambda t: json_text(F.concat(t, F.lit("-15"))))),
        Mutation("B-B09", "B", added("대여년월", lambda df: next_month(text_of(month)))),
        Mutation("B-B10", "B", nth_null(use, none)),
    ]


def mutated_cells(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: cells whose value or type changed, by position, over the columns that both have."""
    shared = [c for c in before.columns if c in after.columns and c != ORDINAL]
    a = before.select(ORDINAL, *[token(before, c).alias(f"a{i}") for i, c in enumerate(shared)])
    b = after.select(ORDINAL, *[token(after, c).alias(f"b{i}") for i, c in enumerate(shared)])
    changed = sum((F.count_if(~F.col(f"a{i}").eqNullSafe(F.col(f"b{i}"))) for i in range(len(shared))), F.lit(0))
    return a.join(b, ORDINAL).agg(changed.cast("bigint").alias("cells"))


@dataclass(frozen=True)
class Outcome:
    mutation: str
    kind: str
    observed: str
    verdict: str
    stage: str | None


def outcome(mutation: Mutation, contract: Contract, bronze: DataFrame, baseline: DataFrame) -> Outcome:
    """What the contract makes of a mutated source: two aggregations, one for the guards and one for
    the cells that differ from the baseline's silver. New columns warn."""
    stage, observed = None, "reject"
    try:
        source = mutation.apply(bronze)
        silver = compile_contract(contract, source).checked()
        n = {r["column"]: r["cells"] for r in compare.cell_differences(baseline, silver).collect()}
        same_columns = set(n) == set(baseline.columns) - {ORDINAL}
        warned = bool(set(silver.columns) - set(baseline.columns))
        observed = ("accept_equiv" if same_columns and not any(n.values()) else "accept_nonequiv") + ("_warn" if warned else "")
    except ContractError as refused:
        stage = refused.stage
    return Outcome(mutation.name, mutation.kind, observed, verdict(mutation.kind, observed), stage)


def verdict(kind: str, observed: str) -> str:
    if kind == "P":
        return "false_reject" if observed == "reject" else "correct_accept" if observed.startswith("accept_equiv") else "silent_corruption"
    return "correct_reject" if observed == "reject" else "warned" if observed.endswith("_warn") else "false_accept"


def outcomes(mutations: Sequence[Mutation], contract: Contract, bronze: DataFrame) -> list[Outcome]:
    baseline = compile_contract(contract, bronze).checked()
    return [outcome(m, contract, bronze, baseline) for m in mutations]


def policy_counts(mutations: Sequence[Mutation], contract: Contract, bronze: DataFrame, policy: Mapping[str, Mapping]) -> dict[str, dict[str, int]]:
    """What a quality policy would flag after each mutation that the contract accepts."""
    from terrace.operators.contract import quality_flags

    found = {}
    for m in mutations:
        try:
            silver = compile_contract(contract, m.apply(bronze)).checked()
        except ContractError:
            continue
        found[m.name] = {r["rule"]: r["violations"] for r in quality_flags(silver, policy).collect()}
    return found
