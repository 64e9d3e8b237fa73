"""Task T1: prices by district and month, their change on the year before, and a rank.

The four conditions start from different layers and must agree: bronze (text), silver (typed),
gold (aggregated) and monolithic (bronze to result in one plan without a stored layer).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrace.functions import text as fn
from terrace.operators.dictionary import Group, evaluated


def prepared_from_bronze(bronze: DataFrame) -> DataFrame:
    """district_code, year_month, price_per_m2 from source text: cleaned, then read, then combined, a
    projection each, so that no text is cleaned or read twice."""
    clean = bronze.select(*[fn.trimmed(c).alias(c) for c in ("sggCd", "dealYear", "dealMonth", "excluUseAr")], fn.without_commas("dealAmount").alias("amount"))
    numbers = clean.select("sggCd", fn.to_int("dealYear").alias("year"), fn.to_int("dealMonth").alias("month"), fn.to_float("excluUseAr").alias("area"), fn.to_float("amount").alias("amount"))
    return numbers.select(
        fn.padded_code("sggCd").alias("district_code"),
        fn.month_text("year", "month").alias("year_month"),
        fn.price_per_m2("amount", "area").alias("price_per_m2"),
    )


def prepared_by_value(bronze: DataFrame, **road) -> DataFrame:
    """As prepared_from_bronze, with districts, months and areas read once a value where they are few."""
    groups = [
        Group(["sggCd"], {"district_code": fn.district_code("sggCd")}),
        Group(["dealYear", "dealMonth"], {"year_month": fn.year_month_of("dealYear", "dealMonth")}),
        Group(["excluUseAr"], {"area": fn.to_float(fn.trimmed("excluUseAr"))}),
        Group(["dealAmount"], {"amount": fn.amount("dealAmount")}),
    ]
    read = evaluated(bronze.select(*[c for g in groups for c in g.inputs]), groups, **road)
    return read.select("district_code", "year_month", fn.price_per_m2("amount", "area").alias("price_per_m2"))


def prepared_from_silver(silver: DataFrame) -> DataFrame:
    """As from bronze, out of typed columns; what is used several times comes from a projection of its own."""
    parts = silver.select(fn.trimmed("district_code").alias("code"), F.year("deal_date").alias("year"), F.month("deal_date").alias("month"), "price_10k_krw", "area_m2")
    return parts.select(
        fn.padded_code("code").alias("district_code"),
        fn.month_text("year", "month").alias("year_month"),
        fn.price_per_m2("price_10k_krw", "area_m2").alias("price_per_m2"),
    )


#: Steps that an octave of prices is cut into.
STEPS = 32


def gold(prepared: DataFrame) -> DataFrame:
    """Count, mean and exact median of the prices by district and month; rows without a price or
    a key are left out.

    Prices are counted by value on the map side and spread by district, month and price. Counts by
    step (a range of prices of about 2 percent) tell which steps hold the middle, and only these
    steps' prices are put in order. So a district with a third of all deals is no hot group: its
    steps are few, and a step's different prices are all that one task sees at once. Usable rows are
    counted, not filtered, which keeps the optimizer from reading the texts once more for a filter.
    """
    keys = ["district_code", "year_month"]
    price = F.col("price_per_m2")
    usable = price.isNotNull() & ~F.isnan(price) & F.col("district_code").isNotNull() & F.col("year_month").isNotNull()
    counted = prepared.groupBy(*keys, price.alias("price")).agg(F.count_if(usable).alias("n")).filter("n > 0")
    # Nothing is null any more. Said in this way it holds for the optimizer too, which would otherwise
    # push a filter for the join below both of its sides, and there read the texts once more.
    counted = counted.select(*[F.coalesce(k, F.lit("")).alias(k) for k in keys], F.coalesce("price", F.lit(0.0)).alias("price"), "n")
    counted = counted.withColumn("step", F.coalesce(step_of("price"), F.lit(0))).repartition(*keys, "step")
    steps = counted.groupBy(*keys, "step").agg(F.sum("n").alias("held"), F.sum(F.col("price") * F.col("n")).alias("sum"))
    group = Window.partitionBy(*keys)
    running = steps.withColumns({"until": F.sum("held").over(group.orderBy("step")), "total": F.sum("held").over(group), "whole": F.sum("sum").over(group)})
    low, high = F.floor((F.col("total") + 1) / 2), F.floor(F.col("total") / 2) + 1
    before = F.col("until") - F.col("held")
    middle = running.filter((before < high) & (F.col("until") >= low)).select(*keys, "step", before.alias("before"), "total", "whole", low.alias("low"), high.alias("high"))
    seen = F.col("before") + F.sum("n").over(Window.partitionBy(*keys, "step").orderBy("price"))
    placed = counted.join(middle, [*keys, "step"]).withColumn("seen", seen)
    first = lambda place: F.min(F.when(F.col("seen") >= F.col(place), F.col("price")))
    return placed.groupBy(*keys).agg(
        F.first("total").alias("n_deals"),
        (F.first("whole") / F.first("total")).alias("mean_price_per_m2"),
        ((first("low") + first("high")) / 2).alias("median_price_per_m2"),
    )


def step_of(price: str) -> Column:
    """The step that a price lies in; higher prices never lie in a lower step. It is a whole number:
    as a key, a floating one would be normalized in every plan that compares partitionings."""
    size = F.floor(F.log2(1 + F.abs(price)) * STEPS)
    return F.when(F.col(price) < 0, -size).otherwise(size)


def change_on_year(table: DataFrame, value: str, out: str, how: Column | None = None) -> DataFrame:
    """Adds the change of `value` on the same month a year before: relative, or `how` over columns
    `now` and `before`.

    The month before is found by its key and not by its place: the frame holds just the rows whose
    year and month, as a number, lie 100 below. So one shuffle by district does, without a self-join.
    """
    ratio = how if how is not None else F.when(F.col("before") != 0, F.col("now") / F.col("before") - 1)
    month = F.substring("year_month", 1, 4).try_cast("int") * 100 + F.substring("year_month", 6, 2).try_cast("int")
    earlier = Window.partitionBy("district_code").orderBy("__month").rangeBetween(-100, -100)
    framed = table.withColumns({"__month": month, "now": F.col(value)}).withColumn("before", F.first("now").over(earlier))
    return framed.withColumn(out, ratio).drop("__month", "now", "before")


def analyze(table: DataFrame) -> DataFrame:
    """Gold with mean_price_yoy_change and price_rank: 1 to n by descending mean in the latest
    month, attached to all months of a district; ties go by district. Districts without a row in
    the latest month have no rank."""
    last = table.groupBy("district_code").agg(F.max(F.struct("year_month", "mean_price_per_m2")).alias("last"))
    everywhere = Window.partitionBy()  # one row a district
    latest = last.withColumn("__latest", F.max("last.year_month").over(everywhere)).filter(F.col("last.year_month") == F.col("__latest"))
    ranked = latest.select("district_code", F.row_number().over(Window.orderBy(F.desc("last.mean_price_per_m2"), "district_code")).cast("bigint").alias("price_rank"))
    return change_on_year(table, "mean_price_per_m2", "mean_price_yoy_change").join(ranked, "district_code", "left")
