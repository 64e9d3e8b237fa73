"""Report tables: summaries of timings, pivots and totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONDITIONS = ("bronze", "silver", "gold", "monolithic")


def timing_summary(runs: DataFrame, by: Sequence[str], seconds: str = "seconds", warmup: str = "warmup") -> DataFrame:
    """n, median, q1, q3 (exact, linear), min, max and iqr by group; warm-up runs are left out."""
    q = lambda p: F.percentile(seconds, F.lit(p))
    return runs.filter(~F.col(warmup)).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.median(seconds).alias("median"), q(0.25).alias("q1"), q(0.75).alias("q3"), F.min(seconds).alias("min"), F.max(seconds).alias("max"), (q(0.75) - q(0.25)).alias("iqr"))


def timing_comparison(runs: DataFrame, by: Sequence[str], round_: str = "round", seconds: str = "seconds", warmup: str = "warmup") -> DataFrame:
    """Monolithic against materialized, paired by round: medians of ratio and difference, and the
    ratio of medians. Rounds that lack a side are left out."""
    sides = runs.filter(~F.col(warmup)).groupBy(*by, round_).pivot("strategy", ["materialized", "monolithic"]).agg(F.first(seconds)).dropna(subset=["materialized", "monolithic"])
    return sides.groupBy(*by).agg(
        F.count(F.lit(1)).alias("pairs"),
        F.median(F.try_divide("monolithic", "materialized")).alias("ratio"),
        F.median(F.col("monolithic") - F.col("materialized")).alias("delta"),
        F.try_divide(F.median("monolithic"), F.median("materialized")).alias("ratio_of_medians"),
    )


def schedule_mismatches(a: DataFrame, b: DataFrame) -> DataFrame:
    """(left_only, right_only): rows of either schedule that the other lacks, on all shared columns."""
    shared = [c for c in a.columns if c in b.columns]
    marks = a.select(*shared, F.lit(1).alias("s")).distinct().unionByName(b.select(*shared, F.lit(2).alias("s")).distinct()).groupBy(*shared).agg(F.sum("s").alias("s"))
    return marks.agg(F.count_if(F.col("s") == 1).alias("left_only"), F.count_if(F.col("s") == 2).alias("right_only"))


def by_condition(results: DataFrame, metric: str, conditions: Sequence[str] = CONDITIONS) -> DataFrame:
    """Mean of a metric by task, one column a condition in the layers' order."""
    return results.groupBy("task").pivot("condition", list(conditions)).agg(F.avg(metric))


def cause_table(cells: DataFrame, by: str, causes: Sequence[str], cause: str = "cause", n: str = "n") -> DataFrame:
    """Cells by cause (0 where none), total, changed (all but the first cause) and its rate."""
    wide = cells.groupBy(by).pivot(cause, list(causes)).agg(F.sum(n)).na.fill(0, list(causes))
    total = sum((F.col(f"`{c}`") for c in causes), F.lit(0))
    return wide.withColumn("total", total).withColumn("changed", F.col("total") - F.col(f"`{causes[0]}`")).withColumn("rate", F.try_divide("changed", "total"))


def storage_table(sizes: DataFrame, by: str = "dataset") -> DataFrame:
    """Bytes by layer and their ratio to bronze."""
    wide = sizes.groupBy(by).pivot("layer", ["bronze", "silver"]).agg(F.sum("bytes"))
    return wide.withColumn("ratio", F.try_divide("silver", "bronze"))


def verdict_totals(verdicts: DataFrame) -> DataFrame:
    """Mutations by kind with counts of rejects and accepts, and a total row (kind null)."""
    return verdicts.rollup("kind").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("observed") == "reject").alias("rejected"), F.count_if(F.startswith("observed", F.lit("accept"))).alias("accepted"), F.count_if(F.startswith("verdict", F.lit("correct"))).alias("correct"))


def determinism(builds: DataFrame) -> DataFrame:
    """By dataset: builds, successes, different digests among them, and whether all are equal (null
    below two successes)."""
    ok = F.col("status") == "ok"
    different = F.count_distinct(F.when(ok, F.col("digest")))
    return builds.groupBy("dataset").agg(F.count(F.lit(1)).alias("builds"), F.count_if(ok).alias("ok"), different.alias("digests"), F.when(F.count_if(ok) >= 2, different == 1).alias("equal"))


def cell(value: object) -> str:
    """A report's cell: floats to four digits below 1000 and whole beyond, counts with separators,
    a dash for what is missing."""
    if value is None or value != value:
        return "—"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return f"{value:,.4g}" if abs(value) < 1000 else f"{value:,.0f}"
    return f"{value:,d}" if isinstance(value, int) else str(value)


def markdown(df: DataFrame, most: int = 10_000) -> str:
    """A report table as Markdown; reports are small, larger frames are refused."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows are no report")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(cell, r)) + " |" for r in rows]) + "\n"
