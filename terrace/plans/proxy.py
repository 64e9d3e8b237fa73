"""Messy source tables derived from the clean ones, for queries and tests.

Sales are the line items of status F, rents those of status O; their text is what a source would
hold: unpadded district numbers, amounts with separators, names with punctuation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EDGES = (10.0, 25.0, 40.0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lines(spark: SparkSession, sf_dir: str, status: str, names: bool = True) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").filter(F.col("l_linestatus") == status)
    # Joined by equality; the optimizer broadcasts a side where its size allows.
    lines = lines.join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    if names:
        named = F.concat(F.replace("p_name", F.lit(" "), F.lit("-(")), F.lit(") "))
        lines = lines.join(table(spark, sf_dir, "part").select("p_partkey", named.alias("aptNm")), F.col("l_partkey") == F.col("p_partkey"))
    return lines


def _texts(lines: DataFrame, names: bool) -> dict:
    made = {
        "sggCd": F.col("s_nationkey").cast("string"),
        "excluUseAr": F.col("l_quantity").cast("string"),
        "dealYear": F.year("l_shipdate").cast("string"),
        "dealMonth": F.month("l_shipdate").cast("string"),
        "dealDay": F.day("l_shipdate").cast("string"),
    }
    if names:
        made["aptNm"] = F.col("aptNm")
    return made


def _money(column: str):
    """Whole amounts below a million, as nearly all are, with their one separator; others formatted."""
    n = F.floor(column)
    small = F.when(n < 1000, n.cast("string")).otherwise(F.concat(F.floor(n / 1000).cast("string"), F.lit(","), F.lpad((n % 1000).cast("string"), 3, "0")))
    return F.when(n.between(0, 999_999), small).otherwise(F.format_number(n, 0))


def trades(spark: SparkSession, sf_dir: str, names: bool = True) -> DataFrame:
    """Bronze sales: sggCd, aptNm, excluUseAr, dealAmount, dealYear, dealMonth, dealDay, all text."""
    lines = _lines(spark, sf_dir, "F", names)
    return lines.select(*[c.alias(k) for k, c in _texts(lines, names).items()], _money("l_extendedprice").alias("dealAmount"))


def rents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bronze rents: as sales, with deposit and monthlyRent."""
    lines = _lines(spark, sf_dir, "O")
    return lines.select(*[c.alias(k) for k, c in _texts(lines, True).items()], _money("l_extendedprice").alias("deposit"), F.round(F.col("l_discount") * 100).cast("int").cast("string").alias("monthlyRent"))


#: Names of the source's fields and of the contracts' columns.
TRADES = {
    "read_as": {"sggCd": "str"},
    "null_tokens": ["", "-"],
    "rename": {"sggCd": "district_code", "excluUseAr": "area_m2", "dealAmount": "price_10k_krw", "dealYear": "deal_year", "dealMonth": "deal_month", "dealDay": "deal_day"},
    "zfill": {"district_code": 5},
    "casts": {"price_10k_krw": "int_comma", "area_m2": "float", "deal_year": "int", "deal_month": "int", "deal_day": "int"},
    "derived": {"deal_date": {"kind": "date_parts", "year": "deal_year", "month": "deal_month", "day": "deal_day"}},
    "required": ["district_code", "deal_date", "area_m2", "price_10k_krw"],
}
#: Sales and rents with their buildings' names, for the task that joins them.
SALES = TRADES | {"rename": TRADES["rename"] | {"aptNm": "apt_name"}}
RENTS = {
    "read_as": {"sggCd": "str"},
    "null_tokens": ["", "-"],
    "rename": {"sggCd": "district_code", "aptNm": "apt_name", "excluUseAr": "area_m2", "deposit": "deposit_10k_krw", "monthlyRent": "monthly_rent_10k_krw", "dealYear": "deal_year", "dealMonth": "deal_month", "dealDay": "deal_day"},
    "zfill": {"district_code": 5},
    "casts": {"deposit_10k_krw": "int_comma", "monthly_rent_10k_krw": "int_comma", "area_m2": "float", "deal_year": "int", "deal_month": "int", "deal_day": "int"},
    "derived": {"deal_date": {"kind": "date_parts", "year": "deal_year", "month": "deal_month", "day": "deal_day"}},
    "required": ["district_code", "apt_name", "deal_date", "area_m2", "deposit_10k_krw", "monthly_rent_10k_krw"],
}
