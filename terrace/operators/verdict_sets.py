"""Report queries over the verdicts of mutations: classes of breaking ones, sets by class, appendices.

Sets of mutations are bitmaps over dense numbers of their ids, so that sets of many runs merge by a
bitwise or and their sizes, unions, overlaps and differences come from counting bits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The classes of breaking mutations, in the order of the report.
CLASSES = ("declared_or_covered", "undeclared_but_expressible", "not_expressible")
REJECTED, MISSING = "correct_reject", "—"


def silent(verdict: Column) -> Column:
    """Whether a breaking mutation passed: anything but its rejection."""
    return ~verdict.eqNullSafe(F.lit(REJECTED))


def classified(verdicts: DataFrame, classes: DataFrame) -> DataFrame:
    """The breaking mutations with contract_class: that of `classes` (mutation, contract_class) for those that
    passed, declared_or_covered for the rejected ones.

    `classes` must name exactly the mutations that passed. One that it lacks, or names in vain, or
    names twice, ends the query where its row is read.
    """
    breaks = verdicts.filter(F.col("kind") == "B")
    known = classes.groupBy("mutation").agg(F.min("contract_class").alias("__class"), F.count(F.lit(1)).alias("__named"))
    both = breaks.withColumn("__there", F.lit(True)).join(known, "mutation", "full_outer")
    passed = F.col("__there").isNotNull() & silent(F.col("verdict"))
    wrong = (F.coalesce(passed, F.lit(False)) != F.col("__named").isNotNull()) | (F.col("__named") > 1)
    sound = F.when(F.coalesce(wrong, F.lit(False)), F.raise_error(F.concat(F.lit("classes and silent mutations differ: "), F.col("mutation"))).cast("boolean")).otherwise(True)
    return both.filter(sound).withColumn("contract_class", F.coalesce("__class", F.lit(CLASSES[0]))).select(*verdicts.columns, "contract_class")


def by_class(breaks: DataFrame) -> DataFrame:
    """(contract_class, mutations, rejected, silent_pass) in the report's order, all classes, and a total."""
    passed = silent(F.col("verdict"))
    counts = breaks.rollup("contract_class").agg(F.count(F.lit(1)).alias("mutations"), F.count_if(~passed).alias("rejected"), F.count_if(passed).alias("silent_pass"), F.grouping("contract_class").alias("__all"))
    named = counts.select(F.when(F.col("__all") == 1, "total").otherwise(F.col("contract_class")).alias("contract_class"), "mutations", "rejected", "silent_pass")
    rows = named.sparkSession.createDataFrame([(i, c) for i, c in enumerate((*CLASSES, "total"))], "place int, contract_class string")
    return rows.join(named, "contract_class", "left").select("place", "contract_class", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("mutations", "rejected", "silent_pass")])


def appendix(verdicts: DataFrame, breaks: DataFrame) -> DataFrame:
    """Every mutation with what was observed, and the class of breaking ones; what is missing is a dash."""
    classes = breaks.select("mutation", "contract_class")
    columns = ["mutation", "dataset", "kind", "n_cells_mutated", "observed", "verdict", "failure_stage", "contract_class"]
    return verdicts.join(classes, "mutation", "left").select(*columns).fillna(MISSING, ["failure_stage", "contract_class"])


# ---- sets ---------------------------------------------------------------------------------------


def numbered(ids: DataFrame, column: str = "mutation") -> DataFrame:
    """(column, number): dense numbers of the different ids in their order, counted up behind each
    range's predecessors, so that no task holds them all."""
    different = ids.select(column).distinct().repartitionByRange(column).sortWithinPartitions(column)
    marked = different.select(column, F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("__at"))
    # One row a partition.
    sizes = marked.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("__part", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("__before"))
    return marked.join(before, "__part").select(column, (F.col("__before") + F.col("__at")).alias("number"))


def bitmaps(rows: DataFrame, by: Sequence[str], number: str = "number") -> DataFrame:
    """(by, bucket, bits): the set of numbers of each group, 32,768 to a bucket."""
    # Spark counts positions from 1.
    one = F.col(number) + 1
    return rows.groupBy(*by, F.bitmap_bucket_number(one).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(one)).alias("bits"))


def merged(sets: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sets of several runs, or of finer groups, as one for each group."""
    return sets.groupBy(*by, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def sizes(sets: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, n): how many numbers each group's set holds."""
    return sets.groupBy(*by).agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("n"))


def overlaps(sets: DataFrame, by: str) -> DataFrame:
    """(a, b, n_a, n_b, both, only_a, only_b) for each two of a few groups, a before b."""
    groups = sorted(r[0] for r in sets.select(by).distinct().limit(65).collect())
    if len(groups) > 64:
        raise ValueError(f"more than 64 groups of {by} cannot be set side by side")
    pairs = [(a, b) for i, a in enumerate(groups) for b in groups[i + 1 :]]
    sided = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs]) if pairs else F.array().cast("array<struct<a:string,b:string>>")
    both = sets.select(F.col(by).alias("__of"), "bucket", "bits", F.explode(F.filter(sided, lambda p: (p["a"] == F.col(by)) | (p["b"] == F.col(by)))).alias("pair"))
    by_bucket = both.groupBy("pair", "bucket").agg(F.bitmap_count(F.bitmap_or_agg("bits")).alias("union"), *[F.coalesce(F.sum(F.when(F.col("__of") == F.col(f"pair.{s}"), F.bitmap_count("bits"))), F.lit(0)).alias(f"n_{s}") for s in "ab"])
    told = by_bucket.groupBy("pair").agg(F.sum("n_a").alias("n_a"), F.sum("n_b").alias("n_b"), F.sum("union").alias("union"))
    return told.select("pair.a", "pair.b", "n_a", "n_b", (F.col("n_a") + F.col("n_b") - F.col("union")).alias("both"), (F.col("union") - F.col("n_b")).alias("only_a"), (F.col("union") - F.col("n_a")).alias("only_b"))


# ---- reports of runs ------------------------------------------------------------------------------


def preparation(results: DataFrame) -> DataFrame:
    """Runs by task and condition; whether each gave what the silver condition gave (PASS or FAIL)."""
    silver = results.filter(F.col("condition") == "silver").groupBy("task").agg(F.max("output_hash").alias("__silver"))
    verdict = F.when(F.col("output_hash") == F.col("__silver"), "PASS").otherwise("FAIL")
    return results.join(silver, "task", "left").select("task", "condition", F.col("rows").alias("prepared_rows"), F.substring("output_hash", 1, 12).alias("output_hash"), verdict.alias("equivalence"))


def source_evolution(runs: DataFrame) -> DataFrame:
    """Generations of a source and whether the contract took them."""
    result = F.when(F.col("status") == "ok", "accepted").when(F.col("status") == "failed", "rejected")
    return runs.select("generation", "rows_in", result.alias("result"), F.coalesce("failed_stage", F.lit(MISSING)).alias("failed_stage"), "rows_out", F.substring("config_hash", 1, 12).alias("config_hash"))
