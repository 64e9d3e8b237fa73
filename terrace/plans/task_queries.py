"""Queries of the two analytical tasks and of the contract language, with the SQL that computes the
same rows straight from the clean columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.functions import text as fn
from terrace.operators import contract as ct
from terrace.operators import dictionary, hash_tree, join_task, price_task
from terrace.plans import proxy
from terrace.sources import incremental, scratch


def _rounded(df: DataFrame, places: dict[str, int]) -> DataFrame:
    """Means come out of sums whose order varies, so results are rounded far above that noise."""
    return df.withColumns({c: F.round(c, n) for c, n in places.items()})


T1_ROUND = {"mean_price_per_m2": 2, "median_price_per_m2": 2}


def _silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ct.compile_contract(ct.Contract.of(proxy.TRADES), proxy.trades(spark, sf_dir, names=False)).enforced()


def t1_bronze(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(price_task.gold(price_task.prepared_from_bronze(proxy.trades(spark, sf_dir, names=False))), T1_ROUND)


def t1_by_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1 with districts, months and areas parsed once a value."""
    return _rounded(price_task.gold(price_task.prepared_by_value(proxy.trades(spark, sf_dir, names=False))), T1_ROUND)


def t1_silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(price_task.gold(price_task.prepared_from_silver(_silver(spark, sf_dir))), T1_ROUND)


def t1_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = price_task.analyze(price_task.gold(price_task.prepared_from_bronze(proxy.trades(spark, sf_dir, names=False))))
    return _rounded(found, T1_ROUND | {"mean_price_yoy_change": 9})


def t1_analysis_silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = price_task.analyze(price_task.gold(price_task.prepared_from_silver(_silver(spark, sf_dir))))
    return _rounded(found, T1_ROUND | {"mean_price_yoy_change": 9})


def _sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_task.prepared_from_bronze(proxy.trades(spark, sf_dir), "dealAmount", proxy.EDGES)


def _jeonse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_task.prepared_from_bronze(join_task.jeonse_only(proxy.rents(spark, sf_dir)), "deposit", proxy.EDGES)


def t3_fold_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(join_task.fold(_sales(spark, sf_dir)), {"value": 2})


def t3_fold_by_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The folded sales with names brought into normal form once a value."""
    return _rounded(join_task.fold(join_task.prepared_by_value(proxy.trades(spark, sf_dir), "dealAmount", proxy.EDGES)), {"value": 2})


def encoded_districts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales with their district and month split off as dictionaries: by code, what is read out of the
    values beside the codes. Codes count the values in their order."""
    sales = proxy.trades(spark, sf_dir, names=False).select("sggCd", "dealYear", "dealMonth")
    by = dictionary.encoded(dictionary.encoded(sales, ["sggCd"], "district").rows, ["dealYear", "dealMonth"], "month")
    return by.read({"year_month": fn.year_month_of("dealYear", "dealMonth")}).groupBy("district", "year_month").agg(F.count(F.lit(1)).alias("n"))


def _t3_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_task.gold(join_task.joined(join_task.fold(_sales(spark, sf_dir)), join_task.fold(_jeonse(spark, sf_dir))))


T3_ROUND = {"mean_sale_price_per_m2": 2, "mean_jeonse_deposit_per_m2": 2}


def t3_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_t3_gold(spark, sf_dir), T3_ROUND)


def t3_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(join_task.analyze(_t3_gold(spark, sf_dir)), T3_ROUND | {"jeonse_ratio": 9, "jeonse_ratio_yoy_change": 9})


def _t3_gold_silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    sales = ct.compile_contract(ct.Contract.of(proxy.SALES), proxy.trades(spark, sf_dir)).enforced()
    rents = ct.compile_contract(ct.Contract.of(proxy.RENTS), proxy.rents(spark, sf_dir)).enforced()
    return _t3_from_silver(sales, join_task.jeonse_only(rents, "monthly_rent_10k_krw"))


def _t3_from_silver(sales: DataFrame, jeonse: DataFrame) -> DataFrame:
    sides = [join_task.prepared_from_silver(df, amount, "deal_date", proxy.EDGES) for df, amount in ((sales, "price_10k_krw"), (jeonse, "deposit_10k_krw"))]
    return join_task.gold(join_task.joined(*map(join_task.fold, sides)))


def t3_gold_silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T3 from the silver layer: both sources through their contracts."""
    return _rounded(_t3_gold_silver(spark, sf_dir), T3_ROUND)


def t3_analysis_silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(join_task.analyze(_t3_gold_silver(spark, sf_dir)), T3_ROUND | {"jeonse_ratio": 9, "jeonse_ratio_yoy_change": 9})


def t3_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(join_task.diagnostics(join_task.fold(_sales(spark, sf_dir)), join_task.fold(_jeonse(spark, sf_dir))), {"join_matching_rate": 12})


def t3_invalid_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With every seventh name unreadable."""
    rows = proxy.trades(spark, sf_dir).withColumn("aptNm", F.when(F.col("excluUseAr").cast("double") % 7 == 0, " -- ").otherwise(F.col("aptNm")))
    return _rounded(join_task.invalid_key_rate(join_task.prepared_from_bronze(rows, "dealAmount", proxy.EDGES)), {"invalid_key_rate": 12})


# ---- the four routes ---------------------------------------------------------------------------


def _landed(spark: SparkSession, spec: dict, bronze: DataFrame, name: str) -> DataFrame:
    """A silver layer, written fail-closed and read again."""
    return ct.compile_contract(ct.Contract.of(spec), bronze).land(scratch.place(spark, name))


def _t1_gold_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return price_task.gold(price_task.prepared_from_silver(_landed(spark, proxy.TRADES, proxy.trades(spark, sf_dir, names=False), "t1_silver")))


def t1_route_silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1 from a stored silver layer."""
    return _rounded(price_task.analyze(_t1_gold_layer(spark, sf_dir)), T1_ROUND | {"mean_price_yoy_change": 9})


def t1_route_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1 from a stored gold layer."""
    return _rounded(price_task.analyze(scratch.stored(_t1_gold_layer(spark, sf_dir), "t1_gold")), T1_ROUND | {"mean_price_yoy_change": 9})


def t1_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the four routes of T1 give the same rows."""
    ways = {"bronze": t1_analysis, "silver": t1_route_silver, "gold": t1_route_gold, "monolithic": t1_analysis_silver}
    return hash_tree.equivalence([hash_tree.Route("t1", name, way(spark, sf_dir)) for name, way in ways.items()], ["district_code", "year_month"])


def _t3_gold_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    sales = _landed(spark, proxy.SALES, proxy.trades(spark, sf_dir), "t3_sales")
    rents = join_task.jeonse_only(_landed(spark, proxy.RENTS, proxy.rents(spark, sf_dir), "t3_rents"), "monthly_rent_10k_krw")
    return _t3_from_silver(sales, rents)


def t3_route_silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T3 from stored silver layers."""
    return _rounded(join_task.analyze(_t3_gold_layer(spark, sf_dir)), T3_ROUND | {"jeonse_ratio": 9, "jeonse_ratio_yoy_change": 9})


def t3_route_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T3 from a stored gold layer."""
    return _rounded(join_task.analyze(scratch.stored(_t3_gold_layer(spark, sf_dir), "t3_gold")), T3_ROUND | {"jeonse_ratio": 9, "jeonse_ratio_yoy_change": 9})


def t3_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the four routes of T3 give the same rows."""
    ways = {"bronze": t3_analysis, "silver": t3_route_silver, "gold": t3_route_gold, "monolithic": t3_analysis_silver}
    return hash_tree.equivalence([hash_tree.Route("t3", name, way(spark, sf_dir)) for name, way in ways.items()], ["district_code", "year_month"])


def t1_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A changed mean in every district's May months, found between two routes of T1."""
    bronze, silver = t1_bronze(spark, sf_dir), t1_silver(spark, sf_dir)
    planted = silver.withColumn("mean_price_per_m2", F.when(F.col("year_month").endswith("-05"), F.col("mean_price_per_m2") + 1).otherwise(F.col("mean_price_per_m2")))
    return hash_tree.differences(bronze, planted, ["district_code", "year_month"], rtol=1e-9).select("district_code", "year_month", "column")


# ---- rebuilt by month --------------------------------------------------------------------------


def _by_month(spark: SparkSession, sf_dir: str) -> tuple[incremental.Refreshed, incremental.Refreshed]:
    """T1's prepared and gold layers, built from a source of which the first month was wrong, then brought
    up to date with the right one: what the second refresh of either did."""
    sales = proxy.trades(spark, sf_dir, names=False).withColumn("year_month", fn.year_month_of("dealYear", "dealMonth"))
    sales = scratch.stored(sales, "sales")  # read five times, so its texts are made once
    month = sales.agg(F.min("year_month")).first()[0]
    wrong = sales.withColumn("dealAmount", F.when(F.col("year_month") == month, F.lit("1")).otherwise(F.col("dealAmount")))
    prepared, gold = scratch.place(spark, "prepared"), scratch.place(spark, "gold")
    done = []
    for source in (wrong, sales):
        first = incremental.refresh(source, prepared, ["year_month"], price_task.prepared_from_bronze)
        # A month's prices are all in its own partition, so its aggregates are too.
        done = [first, incremental.refresh(first.rows, gold, ["year_month"], price_task.gold)]
    return done[0], done[1]


def t1_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1 over a gold layer of which one month was rebuilt."""
    return _rounded(price_task.analyze(_by_month(spark, sf_dir)[1].rows), T1_ROUND | {"mean_price_yoy_change": 9})


def t1_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(layer, year_month, change): what the second refresh rebuilt."""
    prepared, gold = _by_month(spark, sf_dir)
    return prepared.rebuilt.withColumn("layer", F.lit("prepared")).unionByName(gold.rebuilt.withColumn("layer", F.lit("gold")))


_LINES = """
l AS (SELECT lpad(CAST(s_nationkey AS VARCHAR), 5, '0') AS district_code, strftime(l_shipdate, '%Y-%m') AS year_month, {name} AS apt_name,
        l_quantity AS area, floor(l_extendedprice) * 10000 / l_quantity AS price, l_linestatus, round(l_discount * 100) AS rent, l_shipdate, l_extendedprice
      FROM lineitem JOIN supplier ON l_suppkey = s_suppkey {part})
"""
LINES = _LINES.format(name="NULL", part="")
NAMED = _LINES.format(name="replace(p_name, ' ', '')", part="JOIN part ON l_partkey = p_partkey")
T1_GOLD = f"""WITH {LINES},
g AS (SELECT district_code, year_month, count(*) AS n_deals, avg(price) AS mean, median(price) AS med FROM l WHERE l_linestatus = 'F' GROUP BY ALL)"""
T1_SQL = T1_GOLD + " SELECT district_code, year_month, n_deals, round(mean, 2) AS mean_price_per_m2, round(med, 2) AS median_price_per_m2 FROM g"
T1_ANALYSIS_SQL = T1_GOLD + """,
r AS (SELECT district_code, row_number() OVER (ORDER BY mean DESC, district_code) AS price_rank FROM g WHERE year_month = (SELECT max(year_month) FROM g))
SELECT g.district_code, g.year_month, g.n_deals, round(g.mean, 2) AS mean_price_per_m2, round(g.med, 2) AS median_price_per_m2,
       round(g.mean / p.mean - 1, 9) AS mean_price_yoy_change, price_rank
FROM g LEFT JOIN g p ON p.district_code = g.district_code AND p.year_month = (CAST(left(g.year_month, 4) AS INT) - 1) || right(g.year_month, 3)
LEFT JOIN r ON r.district_code = g.district_code
"""
T3_FOLDED = f"""WITH {NAMED},
k AS (SELECT *, CASE WHEN area < 10 THEN '0-10' WHEN area < 25 THEN '10-25' WHEN area < 40 THEN '25-40' ELSE '40+' END AS area_bucket FROM l),
s AS (SELECT district_code, apt_name, year_month, area_bucket, avg(price) AS value FROM k WHERE l_linestatus = 'F' GROUP BY ALL),
j AS (SELECT district_code, apt_name, year_month, area_bucket, avg(price) AS value FROM k WHERE l_linestatus = 'O' AND rent = 0 GROUP BY ALL),
g AS (SELECT district_code, year_month, count(*) AS n_matched, avg(s.value) AS sale, avg(j.value) AS jeonse
      FROM s JOIN j USING (district_code, apt_name, year_month, area_bucket) GROUP BY ALL)"""
SQL = {
    "t1_bronze": T1_SQL,
    "t1_silver": T1_SQL,
    "t1_analysis": T1_ANALYSIS_SQL,
    "t1_analysis_silver": T1_ANALYSIS_SQL,
    "t3_fold_sales": T3_FOLDED + " SELECT district_code, apt_name, year_month, area_bucket, round(value, 2) AS value FROM s",
    "t3_gold": T3_FOLDED + " SELECT district_code, year_month, n_matched, round(sale, 2) AS mean_sale_price_per_m2, round(jeonse, 2) AS mean_jeonse_deposit_per_m2 FROM g",
    "t3_analysis": T3_FOLDED + """
SELECT g.district_code, g.year_month, g.n_matched, round(g.sale, 2) AS mean_sale_price_per_m2, round(g.jeonse, 2) AS mean_jeonse_deposit_per_m2,
       round(g.jeonse / g.sale, 9) AS jeonse_ratio, round(g.jeonse / g.sale - p.jeonse / p.sale, 9) AS jeonse_ratio_yoy_change
FROM g LEFT JOIN g p ON p.district_code = g.district_code AND p.year_month = (CAST(left(g.year_month, 4) AS INT) - 1) || right(g.year_month, 3)""",
    "t3_diagnostics": T3_FOLDED + """,
m AS (SELECT count(*) AS n FROM s JOIN j USING (district_code, apt_name, year_month, area_bucket))
SELECT round(n / (SELECT count(*) FROM s), 12) AS join_matching_rate, (SELECT count(*) FROM s) - n AS unmatched_sale_keys, (SELECT count(*) FROM j) - n AS unmatched_jeonse_keys FROM m""",
    "t3_invalid_keys": f"WITH {NAMED} SELECT round(avg(CASE WHEN area % 7 = 0 THEN 1 ELSE 0 END), 12) AS invalid_key_rate FROM l WHERE l_linestatus = 'F'",
}

SQL |= {
    "t1_by_value": T1_SQL,
    "t3_fold_by_value": SQL["t3_fold_sales"],
    "encoded_districts": """WITH l AS (SELECT CAST(s_nationkey AS VARCHAR) AS d, strftime(l_shipdate, '%Y-%m') AS year_month FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_linestatus = 'F')
SELECT CAST(c.code AS INT) AS district, year_month, count(*) AS n FROM l JOIN (SELECT d, row_number() OVER (ORDER BY d) - 1 AS code FROM (SELECT DISTINCT d FROM l)) c USING (d) GROUP BY 1, 2""",
}
SQL |= {f"{task}_route_{way}": SQL[f"{task}_analysis"] for task in ("t1", "t3") for way in ("silver", "gold")}
_ROUTES = " SELECT route, (SELECT count(*) FROM g) AS rows, true AS equal, CAST(0 AS BIGINT) AS ranges FROM (SELECT unnest(['bronze', 'silver', 'gold', 'monolithic']) AS route)"
SQL |= {
    "t1_routes": T1_GOLD + _ROUTES,
    "t3_routes": T3_FOLDED + _ROUTES,
    "t1_incremental": T1_ANALYSIS_SQL,
    "t1_rebuilt": T1_GOLD + " SELECT min(year_month) AS year_month, 'moved' AS change, layer FROM g, (SELECT unnest(['prepared', 'gold']) AS layer) GROUP BY layer",
    "t1_difference": T1_GOLD + " SELECT district_code, year_month, 'mean_price_per_m2' AS \"column\" FROM g WHERE year_month LIKE '%-05'",
}
SQL |= {"t3_gold_silver": SQL["t3_gold"], "t3_analysis_silver": SQL["t3_analysis"]}


# ---- contract language -------------------------------------------------------------------------


def contract_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole trades contract: typed rows, summed up by district."""
    silver = _silver(spark, sf_dir)
    return silver.groupBy("district_code").agg(F.count(F.lit(1)).alias("n"), F.sum("price_10k_krw").alias("price"), F.sum("area_m2").alias("area"), F.min("deal_date").alias("first_deal"), F.max("deal_date").alias("last_deal"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as messy text: month in two spellings in two columns, tokens for missing values."""
    e = proxy.table(spark, sf_dir, "events")
    even = F.col("event_id") % 2 == 0
    return e.select(
        F.col("event_id").cast("string").alias("id"),
        F.when(even, F.date_format("ts", "yyyy-MM")).alias("대여일자"),
        F.when(~even, F.date_format("ts", "yyyyMM")).alias("대여년월"),
        F.when(F.col("event_id") % 5 == 0, r"\N").when(F.col("event_id") % 7 == 0, "").otherwise(F.col("event_type")).alias("성별"),
        (F.col("user_id") % 3000).cast("string").alias("대여소번호"),
    )


EVENTS = {
    "column_null_tokens": {"성별": {"tokens": [""], "on_absent": "error"}, "미사용": {"tokens": ["-"], "on_absent": "ignore"}},
    "null_tokens": [r"\N"],
    "coalesce": {"ym_raw": ["대여일자", "대여년월"]},
    "rename": {"id": "event_id", "성별": "gender", "대여소번호": "station_code"},
    "zfill": {"station_code": 5},
    "casts": {"event_id": "int", "ym_raw": "year_month"},
    "required": ["station_code", "ym_raw", "event_id"],
}


def contract_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """coalesce, null tokens, zfill and year_month together, row by row."""
    return ct.compile_contract(ct.Contract.of(EVENTS), _events(spark, sf_dir)).enforced().select("event_id", "gender", "station_code", "ym_raw")


def contract_guard_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the guards count on a source with planted defects: lost casts, candidates that
    disagree, days that do not exist, and mixed JSON types."""
    o = proxy.table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    bronze = o.select(
        F.when(k % 11 == 0, "12만").otherwise(k.cast("string")).alias("amount"),
        F.date_format("o_orderdate", "yyyy-MM").alias("a"),
        F.when(k % 13 == 0, "1999-01").otherwise(F.date_format("o_orderdate", "yyyy-MM")).alias("b"),
        F.when(k % 17 == 0, "32").otherwise(F.day("o_orderdate").cast("string")).alias("day"),
        F.month("o_orderdate").cast("string").alias("month"),
        F.year("o_orderdate").cast("string").alias("year"),
        F.parse_json(F.when(k % 19 == 0, F.lit('"7"')).otherwise(F.lit("7"))).alias("mixed"),
        F.parse_json(F.when(k % 23 == 0, F.lit("1.0")).otherwise(F.lit("1"))).alias("halves"),
        F.parse_json(F.when(k % 2 == 0, F.lit("1" * 30)).when(k % 3 == 0, F.lit("null")).otherwise(F.lit("1"))).alias("wide"),
    )
    spec = {"coalesce": {"ym": ["a", "b"]}, "casts": {"amount": "int", "year": "int", "month": "int", "day": "int"}, "derived": {"on": {"kind": "date_parts", "year": "year", "month": "month", "day": "day"}}}
    found = ct.compile_contract(ct.Contract.of(spec), bronze).counts()
    return found.select(*[F.col(c).cast("bigint").alias(c) for c in found.columns])


def counterfactual_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality policy over line items."""
    return ct.quality_flags(
        proxy.table(spark, sf_dir, "lineitem").withColumn("tax", F.when(F.col("l_tax") > 0, F.col("l_tax"))),
        {
            "quantity": {"rule": "range", "column": "l_quantity", "min": 5, "max": 45},
            "tax_known": {"rule": "max_null_ratio", "column": "tax", "ratio": 0.05},
            "rows": {"rule": "min_rows", "rows": 100},
            "once": {"rule": "max_duplicate_rate", "key": ["l_orderkey", "l_linenumber"], "ratio": 0.01, "severity": "warn"},
            "discounted": {"rule": "compare_columns", "left": "l_discount", "op": ">=", "right": "l_tax"},
        },
    )


SQL |= {
    "contract_trades": f"WITH {LINES} SELECT district_code, count(*) AS n, CAST(sum(CAST(floor(l_extendedprice) AS BIGINT)) AS BIGINT) AS price, sum(area) AS area, CAST(min(l_shipdate) AS DATE) AS first_deal, CAST(max(l_shipdate) AS DATE) AS last_deal FROM l WHERE l_linestatus = 'F' GROUP BY 1",
    "contract_events": "SELECT event_id, CASE WHEN event_id % 5 = 0 OR event_id % 7 = 0 THEN NULL ELSE event_type END AS gender, lpad(CAST(user_id % 3000 AS VARCHAR), 5, '0') AS station_code, strftime(ts, '%Y-%m') AS ym_raw FROM events",
    "contract_guard_counts": """SELECT CASE WHEN count(*) FILTER (WHERE o_orderkey % 19 = 0) > 0 THEN 1 ELSE 0 END AS heterogeneous__mixed,
 CASE WHEN count(*) FILTER (WHERE o_orderkey % 23 = 0) > 0 THEN 1 ELSE 0 END AS heterogeneous__halves, CAST(0 AS BIGINT) AS heterogeneous__wide,
 count(*) FILTER (WHERE o_orderkey % 13 = 0 AND strftime(o_orderdate, '%Y-%m') <> '1999-01') AS coalesce__ym, count(*) FILTER (WHERE o_orderkey % 11 = 0) AS casts__amount,
 CAST(0 AS BIGINT) AS casts__year, CAST(0 AS BIGINT) AS casts__month, CAST(0 AS BIGINT) AS casts__day, count(*) FILTER (WHERE o_orderkey % 17 = 0) AS derived__on FROM orders""",
    "counterfactual_policy": """WITH n AS (SELECT count(*) AS rows, count(*) FILTER (WHERE l_quantity < 5 OR l_quantity > 45) AS q, count(*) FILTER (WHERE l_tax <= 0) AS t,
 count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) AS d, count(*) FILTER (WHERE l_discount < l_tax) AS c FROM lineitem)
SELECT 'quantity' AS rule, q AS violations, false AS warned FROM n UNION ALL SELECT 'tax_known', CASE WHEN t > rows * 0.05 THEN t ELSE 0 END, false FROM n
UNION ALL SELECT 'rows', CASE WHEN rows < 100 THEN 100 - rows ELSE 0 END, false FROM n UNION ALL SELECT 'once', CASE WHEN d > rows * 0.01 THEN d ELSE 0 END, true FROM n
UNION ALL SELECT 'discounted', c, false FROM n""",
}
QUERIES = {f.__name__: f for f in (t1_incremental, t1_rebuilt, t1_route_silver, t1_route_gold, t1_routes, t3_route_silver, t3_route_gold, t3_routes, t1_difference, t1_bronze, t1_by_value, t3_fold_by_value, encoded_districts, t1_silver, t1_analysis, t1_analysis_silver, t3_fold_sales, t3_gold, t3_analysis, t3_gold_silver, t3_analysis_silver, t3_diagnostics, t3_invalid_keys, contract_trades, contract_events, contract_guard_counts, counterfactual_policy)}
