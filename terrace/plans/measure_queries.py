"""Queries of the measurement operators: quality, roles, pairing, comparison, reports, sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.functions import json_types
from terrace.functions import text as fn
from terrace.operators import compare, pairing, quality, reports, verdict_sets
from terrace.operators import roles as ro
from terrace.operators.contract import Contract, compile_contract
from terrace.plans.proxy import table
from terrace.sources import layout, records, scratch

# ---- quality -----------------------------------------------------------------------------------


def _defective(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as text with planted defects: unreadable and missing prices, unknown status codes,
    prices that are not positive."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    price = F.when(k % 11 == 0, "not a price").when(k % 13 == 0, F.lit(None)).when(k % 17 == 0, "-3").otherwise(F.format_number(F.floor("o_totalprice"), 0))
    status = F.when(k % 19 == 0, "X9").when(k % 23 == 0, r"\N").otherwise(F.col("o_orderstatus"))
    return o.select(k.alias("key"), price.alias("price"), status.alias("status"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


def _spec(semantic: bool) -> quality.QualitySpec:
    return quality.QualitySpec(
        (
            quality.ColumnSpec("price", "numeric", interpret=fn.to_int_comma if semantic else None, minimum=0),
            quality.ColumnSpec("status", "code", null_tokens=(r"\N",), valid=("F", "O", "P")),
            quality.ColumnSpec("day", "date", required=False),
        ),
        key=("status", "day"),
    )


_MEASURES = ("missing_rate", "parsing_failure_rate", "type_consistency", "code_validity", "schema_conformance", "duplicate_rate", "missing_price", "missing_status")


def _measured(spark: SparkSession, sf_dir: str, semantic: bool) -> DataFrame:
    found = quality.measure_quality(_defective(spark, sf_dir), _spec(semantic))
    return found.withColumns({c: F.round(c, 12) for c in _MEASURES})


def quality_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _measured(spark, sf_dir, True)


def quality_naive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _measured(spark, sf_dir, False)


def quality_per_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.per_column(_defective(spark, sf_dir), _spec(True))
    return found.withColumns({c: F.round(c, 12) for c in ("missing_rate", "parsing_failure_rate", "schema_conformance")})


def duplicate_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.duplicate_rate(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"]).select(F.round("duplicate_rate", 12).alias("duplicate_rate"))


def schema_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.schema_report(_defective(spark, sf_dir), "key")
    return found.withColumn("present_share", F.round("present_share", 12))


_DEFECTS = r"""
WITH d AS (SELECT o_orderkey AS key, CASE WHEN o_orderkey % 11 = 0 THEN 'bad' WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 17 = 0 THEN '-3' ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) END AS price,
  CASE WHEN o_orderkey % 19 = 0 THEN 'X9' WHEN o_orderkey % 23 = 0 THEN NULL ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 19 <> 0 AND o_orderkey % 23 = 0 THEN '\N' WHEN o_orderkey % 19 = 0 THEN 'X9' ELSE o_orderstatus END AS stored,
  strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders),
v AS (SELECT *, price IS NULL AS mp, status IS NULL AS ms, {unreadable} AS up, coalesce(TRY_CAST(price AS BIGINT) > 0, false) AND NOT ({unreadable}) AS okp, coalesce(status IN ('F', 'O', 'P'), false) AS oks FROM d)
"""
_READS, _NAIVE = "price = 'bad'", "price = 'bad' OR (price IS NOT NULL AND TRY_CAST(price AS BIGINT) >= 1000)"
_QUALITY = """SELECT count(*) AS rows, round((count(*) FILTER (WHERE mp) + count(*) FILTER (WHERE ms)) / (2 * count(*)), 12) AS missing_rate,
 round(count(*) FILTER (WHERE coalesce(up, false)) / count(*), 12) AS parsing_failure_rate,
 round((count(*) FILTER (WHERE NOT mp) + count(*) FILTER (WHERE NOT ms) + count(*) - count(*) FILTER (WHERE coalesce(up, false))) / (count(*) FILTER (WHERE NOT mp) + count(*) FILTER (WHERE NOT ms) + count(*)), 12) AS type_consistency,
 round(count(*) FILTER (WHERE oks) / count(*) FILTER (WHERE NOT ms), 12) AS code_validity, round(count(*) FILTER (WHERE okp AND oks) / count(*), 12) AS schema_conformance,
 round((count(*) - (SELECT count(*) FROM (SELECT DISTINCT stored, day FROM d))) / count(*), 12) AS duplicate_rate,
 round(count(*) FILTER (WHERE mp) / count(*), 12) AS missing_price, round(count(*) FILTER (WHERE ms) / count(*), 12) AS missing_status FROM v"""
SQL = {
    "quality_semantic": _DEFECTS.format(unreadable=_READS) + _QUALITY,
    "quality_naive": _DEFECTS.format(unreadable=_NAIVE) + _QUALITY,
    "quality_per_column": _DEFECTS.format(unreadable=_READS) + """
SELECT 'price' AS "column", round(avg(CAST(mp AS INT)), 12) AS missing_rate, round(avg(CAST(coalesce(up, false) AS INT)), 12) AS parsing_failure_rate, round(avg(CAST(okp AS INT)), 12) AS schema_conformance FROM v
UNION ALL SELECT 'status', round(avg(CAST(ms AS INT)), 12), 0.0, round(avg(CAST(oks AS INT)), 12) FROM v UNION ALL SELECT 'day', 0.0, 0.0, 1.0""",
    "duplicate_rate": "SELECT round((count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem))) / count(*), 12) AS duplicate_rate FROM lineitem",
    "schema_report": _DEFECTS.format(unreadable=_READS) + r"""
SELECT 'price' AS "column", 'string' AS type, round(count(price) / count(*), 12) AS present_share,
 (SELECT CASE WHEN key % 11 = 0 THEN 'not a price' WHEN key % 17 = 0 THEN '-3' ELSE format('{:,}', CAST(price AS BIGINT)) END FROM d WHERE price IS NOT NULL ORDER BY key LIMIT 1) AS example FROM d
UNION ALL SELECT 'status', 'string', 1.0, (SELECT stored FROM d ORDER BY key LIMIT 1) UNION ALL SELECT 'day', 'string', 1.0, (SELECT day FROM d ORDER BY key LIMIT 1)""",
}

# ---- roles and pairing -------------------------------------------------------------------------

RENTALS = {
    "read_as": {"sggCd": "str"},
    "null_tokens": ["-"],
    "coalesce": {"ym_raw": ["month_a", "month_b"]},
    "rename": {"sggCd": "district_code", "fee": "fee_krw", "unit": "unit"},
    "zfill": {"district_code": 5},
    "casts": {"fee_krw": "int_comma", "ym_raw": "year_month", "y": "int", "m": "int", "d": "int"},
    "derived": {"on_date": {"kind": "date_parts", "year": "y", "month": "m", "day": "d"}},
    "required": ["district_code", "fee_krw", "ym_raw"],
}


def _bronze(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a messy source; _ordinal is the order key, which is unique."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(
        k.alias("_ordinal"),
        (F.col("o_custkey") % 700).alias("sggCd"),
        F.when(k % 10 == 0, "-").otherwise(F.format_number(F.floor("o_totalprice"), 0)).alias("fee"),
        F.when(k % 3 == 0, F.date_format("o_orderdate", "yyyyMM")).alias("month_a"),
        F.when(k % 3 != 0, F.date_format("o_orderdate", "yyyy-MM")).when(k % 6 == 0, "-").alias("month_b"),
        F.col("o_orderstatus").alias("unit"),
        F.year("o_orderdate").cast("string").alias("y"),
        F.month("o_orderdate").cast("string").alias("m"),
        F.day("o_orderdate").cast("string").alias("d"),
    )


def _layers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, list[ro.Role]]:
    contract, bronze = Contract.of(RENTALS), _bronze(spark, sf_dir)
    return bronze, compile_contract(contract, bronze).silver, ro.plan_roles(contract)


def role_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By role: rows, changed, comparable and preserved cells, with their rates."""
    found = pairing.rates(pairing.pair_and_classify(*_layers(spark, sf_dir)))
    return found.select("role", "rows", "changed", "comparable", "preserved", *[F.round(c, 12).alias(c) for c in ("change_rate", "coverage", "preservation")])


def role_pairs_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """role_pairs over layers landed in buckets by ordinal: paired where they lie."""
    bronze, silver, roles = _layers(spark, sf_dir)
    # The contract keeps each row of bronze, so one number fits both.
    landed, buckets = [], layout.buckets_for(bronze)
    for name, df in (("bronze", bronze), ("silver", silver)):
        place = scratch.place(spark, name)
        landed.append(layout.land_bucketed(df, place.rsplit("/", 1)[-1].replace("-", "_"), place, buckets))
    found = pairing.rates(pairing.pair_and_classify(*landed, roles))
    return found.select("role", "rows", "changed", "comparable", "preserved", *[F.round(c, 12).alias(c) for c in ("change_rate", "coverage", "preservation")])


def role_transitions(spark: SparkSession, sf_dir: str, by_value: bool = True) -> DataFrame:
    """(role, cause, n), without the causes that do not occur."""
    wide = pairing.pair_and_classify(*_layers(spark, sf_dir), by_value=by_value)
    return wide.select("role", F.inline(F.array(*[F.struct(F.lit(c).alias("cause"), F.col(f"`{c}`").alias("n")) for c in pairing.CAUSES]))).filter("n > 0")


def role_transitions_by_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """role_transitions with each different text of a role read once."""
    return role_transitions(spark, sf_dir, by_value=True)


def pair_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pairing.aggregate(pairing.pair_and_classify(*_layers(spark, sf_dir)), required_only=True)
    return found.withColumns({c: F.round(c, 12) for c in ("change_rate", "coverage", "preservation")})


def coalesce_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ro.coalesce_sources(_bronze(spark, sf_dir), ["month_a", "month_b"], ["-"])


def role_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each layer stores under the roles, side by side in one table, by layer and role."""
    bronze, silver, roles = _layers(spark, sf_dir)
    sides = [ro.project(df, roles, layer).select(F.lit(layer).alias("layer"), *[F.col(r.name).cast("string").alias(r.name) for r in roles]) for df, layer in ((bronze, "bronze"), (silver, "silver"))]
    counts = [F.struct(F.lit(r.name).alias("role"), F.count(r.name).alias("present"), F.min(r.name).alias("least")) for r in roles]
    return sides[0].unionByName(sides[1]).groupBy("layer").agg(F.array(*counts).alias("all")).select("layer", F.inline("all"))


def row_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose required roles differ between the layers when every 50th silver district is wrong."""
    bronze, silver, roles = _layers(spark, sf_dir)
    wrong = silver.withColumn("district_code", F.when(F.col("_ordinal") % 50 == 1, "99999").otherwise(F.col("district_code")))
    return pairing.row_identity_violations(bronze, wrong, [r for r in roles if r.name != "fee_krw"])


_ROLES = """
WITH o AS (SELECT o_orderkey AS k, o_custkey % 700 AS c, strftime(o_orderdate, '%Y-%m') AS ym, o_orderdate, o_totalprice FROM orders),
cell AS (SELECT 'district_code' AS role, CASE WHEN c >= 0 THEN 'identity' END AS x, k, c, true AS req FROM o),
t AS (
 SELECT 'district_code' AS role, true AS req, 'primitive_type_normalization' AS cause, count(*) AS n FROM o
 UNION ALL SELECT 'fee_krw', true, CASE WHEN k % 10 = 0 THEN 'null_canonicalization' WHEN floor(o_totalprice) >= 1000 THEN 'numeric_formatting' ELSE 'primitive_type_normalization' END, count(*) FROM o GROUP BY 3
 UNION ALL SELECT 'ym_raw', true, CASE WHEN k % 3 = 0 THEN 'date_year_month_normalization' ELSE 'unchanged' END, count(*) FROM o GROUP BY 3
 UNION ALL SELECT 'unit', false, 'unchanged', count(*) FROM o
 UNION ALL SELECT unnest(['y', 'm', 'd']), false, 'primitive_type_normalization', (SELECT count(*) FROM o)
 UNION ALL SELECT 'on_date', false, 'derived_field', count(*) FROM o)
"""
SQL |= {
    "role_transitions": _ROLES + "SELECT role, cause, CAST(sum(n) AS BIGINT) AS n FROM t GROUP BY 1, 2",
    "role_pairs_bucketed": _ROLES + """SELECT role, CAST(sum(n) AS BIGINT) AS rows, CAST(coalesce(sum(n) FILTER (WHERE cause <> 'unchanged'), 0) AS BIGINT) AS changed, CAST(sum(n) AS BIGINT) AS comparable, CAST(sum(n) AS BIGINT) AS preserved,
 round(coalesce(sum(n) FILTER (WHERE cause <> 'unchanged'), 0) / sum(n), 12) AS change_rate, CAST(1 AS DOUBLE) AS coverage, CAST(1 AS DOUBLE) AS preservation FROM t GROUP BY 1""",
    "role_transitions_by_value": _ROLES + "SELECT role, cause, CAST(sum(n) AS BIGINT) AS n FROM t GROUP BY 1, 2",
    "role_pairs": _ROLES + """SELECT role, CAST(sum(n) AS BIGINT) AS rows, CAST(coalesce(sum(n) FILTER (WHERE cause <> 'unchanged'), 0) AS BIGINT) AS changed, CAST(sum(n) AS BIGINT) AS comparable, CAST(sum(n) AS BIGINT) AS preserved,
 round(coalesce(sum(n) FILTER (WHERE cause <> 'unchanged'), 0) / sum(n), 12) AS change_rate, CAST(1 AS DOUBLE) AS coverage, CAST(1 AS DOUBLE) AS preservation FROM t GROUP BY 1""",
    "pair_aggregate": _ROLES + """SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(sum(n) FILTER (WHERE cause <> 'unchanged') AS BIGINT) AS changed, CAST(sum(n) AS BIGINT) AS comparable, CAST(sum(n) AS BIGINT) AS preserved,
 round(sum(n) FILTER (WHERE cause <> 'unchanged') / sum(n), 12) AS change_rate, CAST(1 AS DOUBLE) AS coverage, CAST(1 AS DOUBLE) AS preservation FROM t WHERE req""",
    "coalesce_sources": "SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'month_a' ELSE 'month_b' END AS source, count(*) AS rows FROM orders GROUP BY 1",
    "role_projection": """WITH o AS (SELECT *, o_orderkey AS k, strftime(o_orderdate, '%Y-%m') AS ym FROM orders),
b AS (SELECT 'bronze' AS layer, CAST(o_custkey % 700 AS VARCHAR) AS district_code, CASE WHEN k % 10 = 0 THEN '-' ELSE format('{:,}', CAST(floor(o_totalprice) AS BIGINT)) END AS fee_krw, CASE WHEN k % 3 = 0 THEN replace(ym, '-', '') ELSE ym END AS ym_raw,
  o_orderstatus AS unit, CAST(year(o_orderdate) AS VARCHAR) AS y, CAST(month(o_orderdate) AS VARCHAR) AS m, CAST(day(o_orderdate) AS VARCHAR) AS d, strftime(o_orderdate, '%Y-%m-%d') AS on_date FROM o
 UNION ALL SELECT 'silver', lpad(CAST(o_custkey % 700 AS VARCHAR), 5, '0'), CASE WHEN k % 10 <> 0 THEN CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) END, ym, o_orderstatus, CAST(year(o_orderdate) AS VARCHAR), CAST(month(o_orderdate) AS VARCHAR), CAST(day(o_orderdate) AS VARCHAR), strftime(o_orderdate, '%Y-%m-%d') FROM o)
SELECT layer, role, count(value) AS present, min(value) AS least FROM (UNPIVOT b ON district_code, fee_krw, ym_raw, unit, y, m, d, on_date INTO NAME role VALUE value) GROUP BY 1, 2""",
    "row_identity": "SELECT o_orderkey AS _ordinal FROM orders WHERE o_orderkey % 50 = 1",
}

# ---- comparison and digests --------------------------------------------------------------------


def cell_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders against a copy with planted changes in two columns."""
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "_ordinal")
    k = F.col("_ordinal")
    changed = o.withColumns({"o_totalprice": F.when(k % 29 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")), "o_orderpriority": F.when(k % 31 == 0, F.lit(None)).otherwise(F.col("o_orderpriority"))})
    return compare.cell_differences(o, changed)


def mutation_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict classes over all combinations of what can be observed, one an order."""
    k = F.col("o_orderkey")
    seen = table(spark, sf_dir, "orders").select(F.when(k % 2 == 0, "P").otherwise("B").alias("kind"), compare.observed_class(k % 3 != 0, k % 5 != 0, k % 7 == 0).alias("observed"))
    return seen.withColumn("verdict", compare.verdict(F.col("kind"), F.col("observed"))).groupBy("kind", "observed", "verdict").agg(F.count(F.lit(1)).alias("n"))


def verdict_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    seen = table(spark, sf_dir, "orders").select(F.when(k % 2 == 0, "P").otherwise("B").alias("kind"), compare.observed_class(k % 3 != 0, k % 5 != 0, k % 7 == 0).alias("observed"))
    return reports.verdict_totals(seen.withColumn("verdict", compare.verdict(F.col("kind"), F.col("observed"))))


def _mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mutation an order: its kind, what was observed, its verdict and the stage that failed."""
    k = F.col("o_orderkey")
    seen = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("M"), F.lpad(k.cast("string"), 9, "0")).alias("mutation"),
        F.col("o_orderstatus").alias("dataset"),
        F.when(k % 2 == 0, "P").otherwise("B").alias("kind"),
        (k % 50).alias("n_cells_mutated"),
        compare.observed_class(k % 3 != 0, k % 5 != 0, k % 7 == 0).alias("observed"),
        F.when(k % 3 == 0, "casts").alias("failure_stage"),
    )
    return seen.withColumn("verdict", compare.verdict(F.col("kind"), F.col("observed")))


def _silent_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The breaking mutations that are known to pass, with their class."""
    k = F.col("o_orderkey")
    passing = table(spark, sf_dir, "orders").filter((k % 2 == 1) & (k % 3 != 0))
    return passing.select(F.concat(F.lit("M"), F.lpad(k.cast("string"), 9, "0")).alias("mutation"), F.when(k % 4 == 1, verdict_sets.CLASSES[1]).otherwise(verdict_sets.CLASSES[2]).alias("contract_class"))


def classify_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breaking mutations by class, in the order of the report, with a total."""
    return verdict_sets.by_class(verdict_sets.classified(_mutations(spark, sf_dir), _silent_classes(spark, sf_dir)))


def appendix_perturbation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every mutation with its observation and, for breaking ones, its class."""
    mutations = _mutations(spark, sf_dir)
    return verdict_sets.appendix(mutations, verdict_sets.classified(mutations, _silent_classes(spark, sf_dir)))


def break_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets of mutations as bitmaps: rejected ones, those with a warning, those of many cells, side by side."""
    mutations = _mutations(spark, sf_dir)
    named = mutations.join(verdict_sets.numbered(mutations), "mutation")
    groups = [("rejected", F.col("observed") == "reject"), ("warned", F.endswith("observed", F.lit("_warn"))), ("many", F.col("n_cells_mutated") >= 40)]
    rows = named.select("number", F.explode(F.array_compact(F.array(*[F.when(of, g) for g, of in groups]))).alias("group"))
    return verdict_sets.overlaps(verdict_sets.bitmaps(rows, ["group"]), "group")


def preparation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of tasks, one an order priority and condition, and whether they agree with silver."""
    k = F.col("o_orderkey")
    runs = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("task"), F.element_at(F.array(*map(F.lit, reports.CONDITIONS)), (k % 4 + 1).cast("int")).alias("condition"))
    counted = runs.groupBy("task", "condition").agg(F.count(F.lit(1)).alias("rows"))
    digest = F.sha2(F.concat("task", F.when(F.col("condition") == "gold", "x").otherwise("")), 256)
    return verdict_sets.preparation(counted.withColumn("output_hash", digest))


def source_evolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer as a source that a contract took or refused."""
    k = F.col("c_custkey")
    runs = table(spark, sf_dir, "customer").select(F.concat(F.lit("G"), (k % 5 + 1).cast("string"), F.lit("-"), k.cast("string")).alias("generation"), (k * 7).alias("rows_in"), F.when(k % 3 == 0, "failed").otherwise("ok").alias("status"), F.when(k % 3 == 0, "casts").alias("failed_stage"), F.when(k % 3 != 0, k * 7).alias("rows_out"), F.sha2(k.cast("string"), 256).alias("config_hash"))
    return verdict_sets.source_evolution(runs)


def content_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table's digest equals that of the same rows dealt out anew: true, with the row count."""
    o = table(spark, sf_dir, "orders")
    a, b = compare.content_digest(o), compare.content_digest(o.repartition(7, "o_custkey")).withColumnsRenamed({"rows": "rows_b", "digest": "digest_b"})
    return a.join(b, F.col("rows") == F.col("rows_b")).select("rows", (F.col("digest") == F.col("digest_b")).alias("same"))


_MUTATIONS = """WITH s AS (SELECT 'M' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS mutation, o_orderstatus AS dataset, o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN 'P' ELSE 'B' END AS kind, o_orderkey % 50 AS n_cells_mutated,
 CASE WHEN o_orderkey % 3 = 0 THEN 'reject' ELSE (CASE WHEN o_orderkey % 5 <> 0 THEN 'accept_equiv' ELSE 'accept_nonequiv' END) || (CASE WHEN o_orderkey % 7 = 0 THEN '_warn' ELSE '' END) END AS observed FROM orders),
c AS (SELECT *, CASE WHEN kind = 'B' THEN CASE WHEN k % 3 = 0 THEN 'declared_or_covered' WHEN k % 4 = 1 THEN 'undeclared_but_expressible' ELSE 'not_expressible' END END AS class FROM s),
f AS (SELECT unnest(['rejected', 'warned', 'many']) AS g),
m AS (SELECT g, mutation FROM s, f WHERE CASE g WHEN 'rejected' THEN observed = 'reject' WHEN 'warned' THEN observed LIKE '%!_warn' ESCAPE '!' ELSE n_cells_mutated >= 40 END)
"""
_SEEN = """WITH s AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'P' ELSE 'B' END AS kind, CASE WHEN o_orderkey % 3 = 0 THEN 'reject' ELSE
 (CASE WHEN o_orderkey % 5 <> 0 THEN 'accept_equiv' ELSE 'accept_nonequiv' END) || (CASE WHEN o_orderkey % 7 = 0 THEN '_warn' ELSE '' END) END AS observed FROM orders),
v AS (SELECT *, CASE WHEN kind = 'P' THEN CASE WHEN observed = 'reject' THEN 'false_reject' WHEN observed LIKE 'accept!_equiv%' ESCAPE '!' THEN 'correct_accept' ELSE 'silent_corruption' END
 ELSE CASE WHEN observed = 'reject' THEN 'correct_reject' WHEN observed LIKE '%!_warn' ESCAPE '!' THEN 'warned' ELSE 'false_accept' END END AS verdict FROM s)
"""
SQL |= {
    "cell_differences": """SELECT 'o_totalprice' AS "column", count(*) FILTER (WHERE o_orderkey % 29 = 0) AS cells FROM orders UNION ALL SELECT 'o_orderpriority', count(*) FILTER (WHERE o_orderkey % 31 = 0) FROM orders
UNION ALL SELECT unnest(['o_custkey', 'o_orderstatus', 'o_orderdate']), 0""",
    "mutation_verdicts": _SEEN + "SELECT kind, observed, verdict, count(*) AS n FROM v GROUP BY ALL",
    "classify_breaks": _MUTATIONS + """SELECT CAST(place AS INT) AS place, contract_class, count(class) AS mutations, count(*) FILTER (WHERE k % 3 = 0) AS rejected, count(*) FILTER (WHERE k % 3 <> 0) AS silent_pass
FROM (VALUES (0, 'declared_or_covered'), (1, 'undeclared_but_expressible'), (2, 'not_expressible'), (3, 'total')) AS r(place, contract_class) LEFT JOIN c ON class = contract_class OR (contract_class = 'total' AND class IS NOT NULL) GROUP BY 1, 2""",
    "appendix_perturbation": _MUTATIONS + """SELECT mutation, dataset, kind, n_cells_mutated, observed, CASE WHEN kind = 'P' THEN CASE WHEN observed = 'reject' THEN 'false_reject' WHEN observed LIKE 'accept!_equiv%' ESCAPE '!' THEN 'correct_accept' ELSE 'silent_corruption' END
 ELSE CASE WHEN observed = 'reject' THEN 'correct_reject' WHEN observed LIKE '%!_warn' ESCAPE '!' THEN 'warned' ELSE 'false_accept' END END AS verdict, CASE WHEN k % 3 = 0 THEN 'casts' ELSE '—' END AS failure_stage, coalesce(class, '—') AS contract_class FROM c""",
    "break_sets": _MUTATIONS + """, p AS (SELECT x.g AS a, y.g AS b FROM f x JOIN f y ON x.g < y.g)
SELECT a, b, (SELECT count(*) FROM m WHERE g = a) AS n_a, (SELECT count(*) FROM m WHERE g = b) AS n_b, (SELECT count(*) FROM m x JOIN m y USING (mutation) WHERE x.g = a AND y.g = b) AS both,
 (SELECT count(*) FROM m x WHERE x.g = a AND mutation NOT IN (SELECT mutation FROM m y WHERE y.g = b)) AS only_a, (SELECT count(*) FROM m x WHERE x.g = b AND mutation NOT IN (SELECT mutation FROM m y WHERE y.g = a)) AS only_b FROM p""",
    "preparation_report": """WITH r AS (SELECT o_orderpriority AS task, ['bronze', 'silver', 'gold', 'monolithic'][o_orderkey % 4 + 1] AS condition, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT task, condition, n AS prepared_rows, left(sha256(task || CASE WHEN condition = 'gold' THEN 'x' ELSE '' END), 12) AS output_hash, CASE WHEN condition = 'gold' OR NOT EXISTS (SELECT 1 FROM r s WHERE s.task = r.task AND s.condition = 'silver') THEN 'FAIL' ELSE 'PASS' END AS equivalence FROM r""",
    "source_evolution": "SELECT 'G' || (c_custkey % 5 + 1) || '-' || c_custkey AS generation, c_custkey * 7 AS rows_in, CASE WHEN c_custkey % 3 = 0 THEN 'rejected' ELSE 'accepted' END AS result, CASE WHEN c_custkey % 3 = 0 THEN 'casts' ELSE '—' END AS failed_stage, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey * 7 END AS rows_out, left(sha256(CAST(c_custkey AS VARCHAR)), 12) AS config_hash FROM customer",
    "verdict_totals": _SEEN + "SELECT kind, count(*) AS n, count(*) FILTER (WHERE observed = 'reject') AS rejected, count(*) FILTER (WHERE observed LIKE 'accept%') AS accepted, count(*) FILTER (WHERE verdict LIKE 'correct%') AS correct FROM v GROUP BY ROLLUP (kind)",
    "content_digest": "SELECT count(*) AS rows, true AS same FROM orders",
}

# ---- reports over events as timings ------------------------------------------------------------


def _timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.col("event_id")
    return e.select(
        F.col("event_type").alias("task"),
        (k % 3 == 0).alias("warmup"),
        F.when(k % 2 == 0, "materialized").otherwise("monolithic").alias("strategy"),
        F.floor(k / 2).alias("round"),
        (F.col("value") + 1).alias("seconds"),
        F.element_at(F.array(*map(F.lit, reports.CONDITIONS)), (k % 4 + 1).cast("int")).alias("condition"),
    )


def _places(df: DataFrame, n: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(f"`{c}`"), n) for c, t in df.dtypes if t == "double"})


def timing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _places(reports.timing_summary(_timings(spark, sf_dir), ["task"]))


def timing_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _timings(spark, sf_dir).withColumns({"warmup": F.lit(False), "task": F.concat(F.lit("task"), (F.col("round") % 3).cast("string"))})
    return _places(reports.timing_comparison(t, ["task"]))


def pivot_by_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _places(reports.by_condition(_timings(spark, sf_dir), "seconds"))


def rq1_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Causes by the orders' status, from synthetic cells."""
    causes = ("unchanged", "identifier_padding", "numeric_formatting")
    o = table(spark, sf_dir, "orders")
    cells = o.select(F.col("o_orderstatus").alias("role"), F.element_at(F.array(*map(F.lit, causes)), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("cause"), F.lit(1).alias("n")).groupBy("role", "cause").agg(F.sum("n").alias("n"))
    return _places(reports.cause_table(cells, "role", causes), 12)


def storage_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    sizes = o.select(F.col("o_orderstatus").alias("dataset"), F.when(F.col("o_orderkey") % 2 == 0, "bronze").otherwise("silver").alias("layer"), F.col("o_custkey").alias("bytes"))
    return _places(reports.storage_table(sizes), 12)


def sorted_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timings landed in total order (task, condition along the layers, round, time) and read again with their positions."""
    t = _timings(spark, sf_dir).select("task", "condition", "round", F.col("seconds").alias("seconds"))
    place = scratch.place(spark, "sorted")
    layout.land_sorted(t, place, ["task", "condition", "round", "seconds"], layout.ORDERS)
    return layout.positioned(spark, place, "position").withColumn("seconds", F.round("seconds", 9))


def sorted_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that break the order: of a layer landed in order none, of the same rows landed as they come many."""
    t = _timings(spark, sf_dir).select("task", "condition", "round")
    keys, found = ["task", "condition", "round"], []
    for name in ("ordered", "as_it_comes"):
        place = scratch.place(spark, name)
        if name == "ordered":
            layout.land_sorted(t, place, keys, layout.ORDERS)
        else:
            t.repartition(3).write.parquet(place)
        found.append(layout.order_breaks(spark, place, keys, layout.ORDERS).agg(F.lit(name).alias("layer"), (F.count(F.lit(1)) > 0).alias("broken")))
    return found[0].unionByName(found[1])


def determinism_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    builds = o.select((F.col("o_custkey") % 100).cast("string").alias("dataset"), F.when(k % 4 == 0, "failed").otherwise("ok").alias("status"), F.when(k % 50 == 1, "b").otherwise("a").alias("digest"))
    return reports.determinism(builds)


def schedule_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _timings(spark, sf_dir).select("task", "round", "strategy")
    return reports.schedule_mismatches(t.filter("round % 7 != 0"), t.filter("round % 5 != 0"))


_T = """WITH t AS (SELECT event_type AS task, event_id % 3 = 0 AS warmup, CASE WHEN event_id % 2 = 0 THEN 'materialized' ELSE 'monolithic' END AS strategy, event_id // 2 AS round, value + 1 AS seconds,
 ['bronze', 'silver', 'gold', 'monolithic'][event_id % 4 + 1] AS condition FROM events)
"""
SQL |= {
    "timing_summary": _T + "SELECT task, count(*) AS n, round(median(seconds), 6) AS median, round(quantile_cont(seconds, 0.25), 6) AS q1, round(quantile_cont(seconds, 0.75), 6) AS q3, round(min(seconds), 6) AS min, round(max(seconds), 6) AS max, round(quantile_cont(seconds, 0.75) - quantile_cont(seconds, 0.25), 6) AS iqr FROM t WHERE NOT warmup GROUP BY 1",
    "sorted_results": _T + """SELECT row_number() OVER (ORDER BY task, list_position(['bronze', 'silver', 'gold', 'monolithic'], condition), round, seconds) - 1 AS position, task, condition, round, round(seconds, 9) AS seconds FROM t""",
    "sorted_breaks": "SELECT 'ordered' AS layer, count(*) < 0 AS broken FROM events UNION ALL SELECT 'as_it_comes', count(*) > 3 FROM events",
    "timing_comparison": _T + """SELECT 'task' || (a.round % 3) AS task, count(*) AS pairs, round(median(b.seconds / a.seconds), 6) AS ratio, round(median(b.seconds - a.seconds), 6) AS delta, round(median(b.seconds) / median(a.seconds), 6) AS ratio_of_medians
FROM t a JOIN t b ON a.round = b.round AND a.strategy = 'materialized' AND b.strategy = 'monolithic' GROUP BY 1""",
    "pivot_by_condition": _T + "SELECT task, " + ", ".join(f"round(avg(seconds) FILTER (WHERE condition = '{c}'), 6) AS {c}" for c in reports.CONDITIONS) + " FROM t GROUP BY 1",
    "rq1_pivot": """WITH c AS (SELECT o_orderstatus AS role, count(*) FILTER (WHERE o_orderkey % 3 = 0) AS unchanged, count(*) FILTER (WHERE o_orderkey % 3 = 1) AS identifier_padding, count(*) FILTER (WHERE o_orderkey % 3 = 2) AS numeric_formatting, count(*) AS total FROM orders GROUP BY 1)
SELECT *, total - unchanged AS changed, round((total - unchanged) / total, 12) AS rate FROM c""",
    "storage_pivot": "WITH s AS (SELECT o_orderstatus AS dataset, CAST(sum(o_custkey) FILTER (WHERE o_orderkey % 2 = 0) AS BIGINT) AS bronze, CAST(sum(o_custkey) FILTER (WHERE o_orderkey % 2 <> 0) AS BIGINT) AS silver FROM orders GROUP BY 1) SELECT *, round(silver / bronze, 12) AS ratio FROM s",
    "determinism_report": """WITH b AS (SELECT CAST(o_custkey % 100 AS VARCHAR) AS dataset, o_orderkey % 4 <> 0 AS ok, CASE WHEN o_orderkey % 50 = 1 THEN 'b' ELSE 'a' END AS digest FROM orders),
g AS (SELECT dataset, count(*) AS builds, count(*) FILTER (WHERE ok) AS ok, count(DISTINCT digest) FILTER (WHERE ok) AS digests FROM b GROUP BY 1) SELECT *, CASE WHEN ok >= 2 THEN digests = 1 END AS equal FROM g""",
    "schedule_mismatches": _T + """, d AS (SELECT DISTINCT task, round, strategy FROM t)
SELECT count(*) FILTER (WHERE round % 7 <> 0 AND round % 5 = 0) AS left_only, count(*) FILTER (WHERE round % 7 = 0 AND round % 5 <> 0) AS right_only FROM d""",
}

# ---- sources -----------------------------------------------------------------------------------


def systematic_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every k-th event, about 500 in all."""
    e = table(spark, sf_dir, "events").withColumnRenamed("event_id", "_ordinal")
    return records.systematic_sample(e, e.count(), 500).select("_ordinal", "event_type")


def last_wins_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return records.last_wins(e, ["user_id"], "event_id")


def _csv_files(spark: SparkSession, sf_dir: str) -> str:
    """Events as CSV files of the fourth generation, two in UTF-8 and two in the old code page; their folder."""
    k = F.col("event_id")
    cells = [F.concat(F.lit("구"), (k % 25).cast("string")), F.when(k % 3 == 0, F.lit('"역 ""가"", 나"')).otherwise("역"), F.date_format("ts", "yyyy-MM"), F.when(k % 5 == 0, "").when(k % 7 == 0, r"\N").otherwise((k % 100).cast("string")), (k % 9).cast("string")]
    rows = table(spark, sf_dir, "events").select((k % 4).alias("file"), F.lit(1).alias("at"), F.concat_ws(",", *cells).alias("line"))
    heads = spark.range(4).select(F.col("id").alias("file"), F.lit(0).alias("at"), F.lit(",".join(records.HEADERS["G4"])).alias("line"))
    dealt = heads.unionByName(rows).repartition("file").sortWithinPartitions("file", "at")
    place = scratch.place(spark, "csv")
    with records.code_pages(spark):
        old = F.encode("line", records.CODE_PAGE)
        dealt.select("file", F.when(F.col("file") < 2, F.col("line").cast("binary")).otherwise(old).cast("string").alias("value")).write.partitionBy("file").text(place)
    return place


def csv_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What comes out of files of two encodings: counts by district, empty fields apart from tokens."""
    rows = records.read_csv(spark, _csv_files(spark, sf_dir), "G4", "*.txt")
    return rows.groupBy("자치구", "대여소명").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("대여건수") == "").alias("empty"), F.count_if(F.col("대여건수") == r"\N").alias("tokens"), F.sum(F.col("반납건수").cast("int")).alias("returned"))


def csv_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, files, and the range of the ordinals and lines that they got."""
    rows = records.read_csv(spark, _csv_files(spark, sf_dir), "G4", "*.txt")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("file").alias("files"), F.count_distinct("_ordinal").alias("ordinals"), F.min("_ordinal").alias("first"), F.max("_ordinal").alias("last"), F.min("line").alias("line"))


def controlled_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items re-encoded into row groups of 4,096 rows: by files' footers the rows, the row groups that
    are neither full nor a file's last, and the codecs; value-equality is proven on the way."""
    place = scratch.place(spark, "controlled")
    records.reencode(spark, f"{sf_dir}/lineitem.parquet", place, rows=4096)
    told = records.footers(spark, place)
    total = F.aggregate("row_groups", F.lit(0).cast("bigint"), lambda a, n: a + n)
    odd = F.size(F.filter(F.slice("row_groups", 1, F.greatest(F.size("row_groups") - 1, F.lit(0))), lambda n: n != 4096))
    return told.agg(F.sum(total).alias("rows"), F.sum(odd).cast("bigint").alias("odd"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("codecs")))), ",").alias("codecs"))


def month_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The months from the first event to the last, those without an event too."""
    first, last = table(spark, sf_dir, "events").agg(F.date_format(F.min("ts"), "yyyyMM"), F.date_format(F.max("ts"), "yyyyMM")).first()
    return records.months(spark, first, last)


#: JSON literals that one column may hold, by the order key: number, text, float, null and others.
_LITERALS = {"mixed": ('"7"', "7.5", "null", "7", "7"), "whole": ("1", "1.0", "null", "1", "1"), "exponent": ("1e0", "2.50", "-0.0", "1E5", "null"), "wide": ("123456789012345678901234567890", "7", "null", "-8", "0"), "wider": ("1" * 40, "null", "1", "1", "1"), "never": ("null",) * 5}


def _json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as JSON lines; a key is absent where the order key ends in 9."""
    k = F.col("o_orderkey")
    pairs = [F.when(k % 10 != 9, F.concat(F.lit(f'"{f}": '), F.element_at(F.array(*map(F.lit, arms)), (k % 5 + 1).cast("int")))) for f, arms in _LITERALS.items()]
    flag = F.concat(F.lit('"flag": '), (k % 2 == 0).cast("string"))
    return table(spark, sf_dir, "orders").select(F.concat(F.lit("{"), F.concat_ws(", ", *pairs, flag), F.lit("}")).alias("value"))


def json_field_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON types inside one column, as their literals spell them, in one pass over the lines."""
    states = json_types.type_states(_json_lines(spark, sf_dir))
    mask, digits = F.col("mask"), F.col("digits")
    return states.select("field", F.array_join(json_types.types_in(mask), ",").alias("types"), "digits", "present", json_types.native_type(mask, digits).alias("native"))


_JSON = "WITH v AS (SELECT 'flag' AS field, CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'false' END AS t FROM orders" + "".join(
    f" UNION ALL SELECT '{f}', [{', '.join(repr(x) for x in arms)}][o_orderkey % 5 + 1] FROM orders WHERE o_orderkey % 10 <> 9" for f, arms in _LITERALS.items()
) + r"""),
k AS (SELECT field, t, CASE WHEN t = 'null' THEN NULL WHEN t IN ('true', 'false') THEN 'bool' WHEN t LIKE '"%' THEN 'str' WHEN regexp_full_match(t, '-?[0-9]+') THEN 'int' ELSE 'float' END AS kind FROM v),
g AS (SELECT field, coalesce(string_agg(DISTINCT kind, ',' ORDER BY kind), '') AS types, coalesce(max(CASE WHEN kind = 'int' THEN length(ltrim(t, '-')) END), 0) AS digits, count(kind) AS present FROM k GROUP BY 1)
SELECT *, CASE types WHEN 'int' THEN CASE WHEN digits <= 18 THEN 'bigint' WHEN digits <= 38 THEN 'decimal(38,0)' ELSE 'string' END WHEN 'float' THEN 'double' WHEN 'bool' THEN 'boolean' WHEN '' THEN 'string' WHEN 'str' THEN 'string' ELSE 'json' END AS native FROM g"""

SQL |= {
    "systematic_sample": "WITH n AS (SELECT count(*) AS n FROM events) SELECT event_id AS _ordinal, event_type FROM events, n WHERE event_id % CAST(greatest(1, ceil(n / 500)) AS BIGINT) = 0",
    "last_wins_dedupe": "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1",
    "month_sequence": "SELECT strftime(d, '%Y%m') AS month FROM (SELECT unnest(generate_series(date_trunc('month', min(ts)), date_trunc('month', max(ts)), INTERVAL 1 MONTH)) AS d FROM events)",
    "json_field_types": _JSON,
    "csv_ingest": """SELECT '구' || event_id % 25 AS "자치구", CASE WHEN event_id % 3 = 0 THEN '역 "가", 나' ELSE '역' END AS "대여소명", count(*) AS n, count(*) FILTER (WHERE event_id % 5 = 0) AS empty,
 count(*) FILTER (WHERE event_id % 5 <> 0 AND event_id % 7 = 0) AS tokens, CAST(sum(event_id % 9) AS BIGINT) AS returned FROM events GROUP BY 1, 2""",
    "csv_ordinals": "SELECT count(*) AS n, CAST(4 AS BIGINT) AS files, count(*) AS ordinals, CAST(0 AS BIGINT) AS first, count(*) - 1 AS last, CAST(0 AS BIGINT) AS line FROM events",
    "controlled_layer": "SELECT count(*) AS rows, CAST(0 AS BIGINT) AS odd, 'ZSTD' AS codecs FROM lineitem",
}
QUERIES = {
    f.__name__: f
    for f in (
        quality_semantic, quality_naive, quality_per_column, duplicate_rate, schema_report, role_pairs, role_transitions, role_transitions_by_value, pair_aggregate, coalesce_sources, role_projection, row_identity,
        cell_differences, classify_breaks, appendix_perturbation, break_sets, preparation_report, source_evolution, mutation_verdicts, verdict_totals, content_digest, timing_summary, timing_comparison, pivot_by_condition, rq1_pivot, storage_pivot, determinism_report, schedule_mismatches,
        systematic_sample, last_wins_dedupe, month_sequence, json_field_types, csv_ingest, csv_ordinals, sorted_results, sorted_breaks, role_pairs_bucketed, controlled_layer,
    )
}
