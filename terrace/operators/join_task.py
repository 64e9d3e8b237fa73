"""Task T3: sales and deposits joined by district, building name, month and area bucket.

Both sides are folded to one row a key before the join, so that it cannot multiply rows; the fold
is part of the meaning and not left to an optimizer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.functions import text as fn
from terrace.operators.dictionary import Group, evaluated
from terrace.operators.price_task import change_on_year

KEYS = ["district_code", "apt_name", "year_month", "area_bucket"]


def prepared_from_bronze(bronze: DataFrame, amount: str, edges: tuple[float, ...] = fn.AREA_EDGES) -> DataFrame:
    """The four keys and value, the price of a square metre, from source text: cleaned, then read, then
    combined, a projection each, so that no text is cleaned or read twice."""
    clean = bronze.select(
        *[fn.trimmed(c).alias(c) for c in ("sggCd", "dealYear", "dealMonth", "excluUseAr")], fn.nfc("aptNm").alias("name"), fn.without_commas(amount).alias("amount")
    )
    numbers = clean.select(
        "sggCd", F.regexp_replace("name", fn.NO_NAME, "").alias("name"), fn.to_int("dealYear").alias("year"), fn.to_int("dealMonth").alias("month"), fn.to_float("excluUseAr").alias("area"), fn.to_float("amount").alias("amount")
    )
    return numbers.select(
        fn.padded_code("sggCd").alias("district_code"),
        F.when(F.col("name") != "", F.col("name")).alias("apt_name"),
        fn.month_text("year", "month").alias("year_month"),
        fn.area_bucket("area", edges).alias("area_bucket"),
        fn.price_per_m2("amount", "area").alias("value"),
    )


def prepared_by_value(bronze: DataFrame, amount: str, edges: tuple[float, ...] = fn.AREA_EDGES, **road) -> DataFrame:
    """As prepared_from_bronze, with columns of few values read once a value: names above all, whose
    normal form is the dearest of the text functions."""
    groups = [
        Group(["sggCd"], {"district_code": fn.district_code("sggCd")}),
        Group(["aptNm"], {"apt_name": fn.normal_name("aptNm")}),
        Group(["dealYear", "dealMonth"], {"year_month": fn.year_month_of("dealYear", "dealMonth")}),
        Group(["excluUseAr"], {"area": fn.to_float(fn.trimmed("excluUseAr"))}),
        Group([amount], {"amount": fn.amount(amount)}),
    ]
    read = evaluated(bronze.select(*[c for g in groups for c in g.inputs]), groups, **road)
    return read.select("district_code", "apt_name", "year_month", fn.area_bucket("area", edges).alias("area_bucket"), fn.price_per_m2("amount", "area").alias("value"))


def prepared_from_silver(silver: DataFrame, amount: str, date: str, edges: tuple[float, ...] = fn.AREA_EDGES) -> DataFrame:
    parts = silver.select(
        fn.trimmed("district_code").alias("code"), F.regexp_replace(fn.nfc("apt_name"), fn.NO_NAME, "").alias("name"), F.year(date).alias("year"), F.month(date).alias("month"), "area_m2", F.col(amount).alias("amount")
    )
    return parts.select(
        fn.padded_code("code").alias("district_code"),
        F.when(F.col("name") != "", F.col("name")).alias("apt_name"),
        fn.month_text("year", "month").alias("year_month"),
        fn.area_bucket("area_m2", edges).alias("area_bucket"),
        fn.price_per_m2("amount", "area_m2").alias("value"),
    )


def jeonse_only(rents: DataFrame, monthly: str = "monthlyRent") -> DataFrame:
    """Rents without a monthly part; an unknown monthly rent does not count as none."""
    return rents.filter(fn.to_float_comma(monthly) == 0)


def invalid_key_rate(prepared: DataFrame) -> DataFrame:
    """The share of rows that lack a join key; 0 for an empty table."""
    lacks = F.greatest(*[F.col(k).isNull().cast("int") for k in KEYS])
    return prepared.agg(F.coalesce(F.avg(lacks), F.lit(0.0)).alias("invalid_key_rate"))


def fold(prepared: DataFrame) -> DataFrame:
    """One row a key with the mean value; rows that lack a key or the value are left out.

    They are left out by counting: a filter below the aggregation would read the texts once more.
    NaN counts as no value.
    """
    known = F.col("value").isNotNull() & ~F.isnan("value")
    for k in KEYS:
        known = known & F.col(k).isNotNull()
    grouped = prepared.groupBy(*KEYS).agg(F.avg(F.when(known, F.col("value"))).alias("value"), F.count_if(known).alias("__n"))
    # Nothing is null any more. Said in this way it holds for the optimizer too, which would otherwise
    # push a join's filters below both of its sides, and there read the texts once more.
    return grouped.filter("__n > 0").select(*[F.coalesce(k, F.lit("")).alias(k) for k in KEYS], "value")


def joined(sales: DataFrame, jeonse: DataFrame) -> DataFrame:
    """Inner join of two folded sides."""
    return sales.withColumnRenamed("value", "sale").join(jeonse.withColumnRenamed("value", "jeonse"), KEYS)


def diagnostics(sales: DataFrame, jeonse: DataFrame) -> DataFrame:
    """join_matching_rate (matched keys of the sales side; 0 without any) and the unmatched keys of
    either side, from one full join of the folded keys."""
    marked = sales.select(*KEYS, F.lit(1).alias("s")).unionByName(jeonse.select(*KEYS, F.lit(2).alias("s"))).groupBy(*KEYS).agg(F.sum("s").alias("s"))
    sale, both, other = F.count_if(F.col("s") != 2), F.count_if(F.col("s") == 3), F.count_if(F.col("s") == 2)
    return marked.agg(F.coalesce(F.try_divide(both, sale), F.lit(0.0)).alias("join_matching_rate"), (sale - both).alias("unmatched_sale_keys"), other.alias("unmatched_jeonse_keys"))


def gold(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("district_code", "year_month").agg(F.count(F.lit(1)).alias("n_matched"), F.avg("sale").alias("mean_sale_price_per_m2"), F.avg("jeonse").alias("mean_jeonse_deposit_per_m2"))


def analyze(table: DataFrame) -> DataFrame:
    """Gold with jeonse_ratio (null where the sale mean is 0) and its difference to a year before."""
    sale = F.col("mean_sale_price_per_m2")
    with_ratio = table.withColumn("jeonse_ratio", F.when(sale != 0, F.col("mean_jeonse_deposit_per_m2") / sale))
    return change_on_year(with_ratio, "jeonse_ratio", "jeonse_ratio_yoy_change", F.col("now") - F.col("before"))
