import pytest
from pyspark.sql import functions as F

from terrace.functions import text as fn
from terrace.operators import compare, pairing, perturb, quality, reports
from terrace.operators import roles as ro
from terrace.operators.contract import Contract, compile_contract


def spec(parser):
    return quality.QualitySpec(
        (
            quality.ColumnSpec("price", "numeric", interpret=fn.to_int_comma if parser else None),
            quality.ColumnSpec("area", "numeric", minimum=0),
            quality.ColumnSpec("code", "code", valid=("11110", "11140", "11170")),
        )
    )


def bronze(spark):
    return spark.createDataFrame([("120,000", "84.97", "11110"), ("95,500", "59.5", "11140"), ("not a price", "-3", "99999"), (None, "72.0", "11170")], "price string, area string, code string")


def test_quality_metrics(spark):
    row = quality.measure_quality(bronze(spark), spec(True)).first()
    assert row.parsing_failure_rate == 0.25 and row.missing_rate == pytest.approx(1 / 12)
    assert row.code_validity == 0.75 and row.schema_conformance == 0.5 and row.duplicate_rate == 0.0
    assert quality.measure_quality(bronze(spark), spec(False)).first().parsing_failure_rate == 0.75


def test_quality_guards(spark):
    with pytest.raises(ValueError, match="twice"):
        quality.QualitySpec((quality.ColumnSpec("a"), quality.ColumnSpec("a")))
    with pytest.raises(ValueError, match="no column"):
        quality.measure_quality(bronze(spark).drop("code"), spec(True))
    with pytest.raises(ValueError, match="unknown metric"):
        quality.measure_quality(bronze(spark), spec(True), ["beauty"])
    assert quality.measure_quality(bronze(spark).limit(0), spec(True)).first().rows == 0


def test_duplicates_and_schema_report(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "x"), (3, "y")], "k int, v string")
    assert quality.duplicate_rate(df, ["k", "v"]).first()[0] == 0.25 and quality.duplicate_rate(df.limit(0)).first()[0] == 0.0
    assert {r.column: (r.type, r.present_share, r.example) for r in quality.schema_report(df, "k").collect()} == {"v": ("string", 0.5, "x")}


CONTRACT = Contract.of({
    "null_tokens": ["-"],
    "rename": {"p": "price", "s": "station", "plain": "plain"},
    "coalesce": {"ym": ["a", "b"]},
    "zfill": {"station": 5},
    "casts": {"price": "int_comma", "ym": "year_month"},
    "required": ["price", "station", "ym"],
})


def layers(spark):
    raw = spark.createDataFrame([(0, "120,000", "3", "2020-01", None, "x"), (1, "-", "00003", None, "202002", None), (2, "7", "12", "2020-03", "-", "y")], "_ordinal bigint, p string, s string, a string, b string, plain string")
    return raw, compile_contract(CONTRACT, raw).checked()


def test_roles_and_sources(spark):
    raw, _ = layers(spark)
    roles = ro.plan_roles(CONTRACT)
    assert [(r.name, r.kind, r.required) for r in roles] == [("plain", "direct", False), ("price", "direct", True), ("station", "direct", True), ("ym", "coalesce", True)]
    assert [r.ym for r in ro.project(raw, roles, "bronze", ["_ordinal"]).orderBy("_ordinal").collect()] == ["2020-01", "202002", "2020-03"]
    assert {r.source: r.rows for r in ro.coalesce_sources(raw, ["a", "b"], ["-"]).collect()} == {"a": 2, "b": 1}
    tokens = spark.createDataFrame([(r"\N", "2230"), (r"\N", None)], "a string, b string")
    assert {r.source: r.rows for r in ro.coalesce_sources(tokens, ["a", "b"], [r"\N"]).collect()} == {"b": 1, None: 1}
    with pytest.raises(ValueError, match="no source"):
        ro.plan_roles(Contract.of({"required": ["q"]}))


def test_causes_partition_the_rows(spark):
    raw, silver = layers(spark)
    pairs = {r.role: r.asDict() for r in pairing.rates(pairing.pair_and_classify(raw, silver, ro.plan_roles(CONTRACT))).collect()}
    for r in pairs.values():
        assert sum(r[c] for c in pairing.CAUSES) == r["rows"] == 3
        assert r["rows"] - r["unchanged"] == r["changed"]
    price, station, ym = pairs["price"], pairs["station"], pairs["ym"]
    assert (price["numeric_formatting"], price["null_canonicalization"], price["primitive_type_normalization"]) == (1, 1, 1)
    assert (station["identifier_padding"], station["unchanged"]) == (2, 1)
    assert (ym["date_year_month_normalization"], ym["unchanged"]) == (1, 2)
    assert price["preservation"] == 1.0 and pairs["plain"]["changed"] == 0


def test_semantic_difference_and_row_identity(spark):
    raw, silver = layers(spark)
    roles = ro.plan_roles(CONTRACT)
    wrong = silver.withColumn("station", F.when(F.col("_ordinal") == 2, "99999").otherwise(F.col("station")))
    assert {r.role: r["other:semantic_difference"] for r in pairing.pair_and_classify(raw, wrong, roles).collect()}["station"] == 1
    only = [r for r in roles if r.name == "station"]
    assert [r[0] for r in pairing.row_identity_violations(raw, wrong, only).collect()] == [2]
    pairing.assert_row_identity(raw, silver, only)
    with pytest.raises(ValueError, match="differ"):
        pairing.assert_row_identity(raw, wrong, only)
    with pytest.raises(ValueError, match="no role is required"):
        pairing.assert_row_identity(raw, silver, [r for r in roles if not r.required])


def test_pairs_of_texts_are_read_once(spark):
    raw, silver = layers(spark)
    roles = ro.plan_roles(CONTRACT)
    odd = raw.unionByName(spark.createDataFrame([(3, "x", None, "2020-13", None, "-"), (3, " 7 ", "+12", None, None, ""), (4, None, "00012", "202001", "2020-01", "-")], raw.schema))
    odd = odd.withColumn("p", F.when(F.col("_ordinal") % 2 == 0, perturb.to_variant(F.col("p"))).otherwise(F.parse_json(F.lit("7"))))
    wrong = silver.unionByName(spark.createDataFrame([(3, None, 9, None, None), (4, "y", None, "99999", "2020-02")], "_ordinal bigint, plain string, price bigint, station string, ym string"))
    often = lambda df: df.crossJoin(spark.range(50)).withColumn("_ordinal", F.col("_ordinal") * 50 + F.col("id")).drop("id")
    for b, s in ((odd, wrong), (often(odd), often(wrong)), (raw.limit(0), silver)):
        by_value = pairing.pair_and_classify(b, s, roles, by_value=True)
        assert sorted(map(tuple, by_value.collect())) == sorted(map(tuple, pairing.pair_and_classify(b, s, roles, by_value=False).collect()))
        # The layers are paired once, and no dictionary is joined to them.
        joins = [line for line in by_value._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in line]
        assert len(joins) <= 1 and "broadcast" not in "".join(joins)


def test_tokens_keep_types_apart(spark):
    df = spark.createDataFrame([("1",), ('"1"',), ("1.0",), ("null",), ("true",), (None,)], "j string").select(F.parse_json("j").alias("v"))
    assert [r[0].kind for r in df.select(pairing.token(df, "v")).collect()] == ["int", "str", "float", "null", "bool", "null"]


def test_compare_frames(spark):
    a = spark.createDataFrame([(1, 1.0, "x"), (2, float("nan"), None)], "k int, v double, s string")
    assert compare.compare_frames(a, a.select("s", "k", "v"), ["k"]).equal
    assert compare.compare_frames(a, a).equal
    b = spark.createDataFrame([(1, 1.0 + 1e-12, "x"), (2, float("nan"), None)], "k int, v double, s string")
    assert compare.compare_frames(a, b, ["k"], rtol=1e-9).equal and compare.compare_frames(a, b, ["k"]).differing == {"v": 1}
    assert not compare.compare_frames(a, a.drop("s"), ["k"]).equal
    assert compare.compare_frames(a, a.limit(1), ["k"]).why == ["1 rows, not 2"]
    assert "repeats" in compare.compare_frames(a.withColumn("k", F.lit(1)), a, ["k"]).why[-1]
    assert compare.same_result(a, b, ["k"]) and not compare.same_result(a, a.withColumn("k", F.col("k") + 1), ["k"])


def test_content_digest_ignores_order(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (2, None)], "k int, s string")
    d = lambda df: tuple(compare.content_digest(df).first())
    assert d(a) == d(a.orderBy(F.desc("k")).select("s", "k")) != d(a.distinct())


def test_mutations_get_their_verdicts(spark):
    rows = [(i, str(11110 + i % 3), f"{100 + i},000", "84.9", "2020", str(1 + i % 12), str(13 + i % 15), 5 + i) for i in range(40)]
    text = spark.createDataFrame(rows, "_ordinal bigint, sggCd string, dealAmount string, excluUseAr string, dealYear string, dealMonth string, dealDay string, floor bigint")
    raw = text.select("_ordinal", *[perturb.to_variant(F.col(c)).alias(c) for c in text.columns[1:]])
    contract = Contract.of({
        "read_as": {c: "str" for c in ("sggCd", "dealAmount", "excluUseAr", "dealYear", "dealMonth", "dealDay")},
        "rename": {"sggCd": "district_code", "dealAmount": "price", "excluUseAr": "area", "floor": "floor"},
        "casts": {"price": "int_comma", "area": "float", "dealYear": "int", "dealMonth": "int", "dealDay": "int", "floor": "int"},
        "derived": {"deal_date": {"kind": "date_parts", "year": "dealYear", "month": "dealMonth", "day": "dealDay"}},
    })
    wanted = {"T-P00": "correct_accept", "T-P02": "correct_accept", "T-P05": "false_reject", "T-P07": "correct_accept", "T-P12": "correct_accept", "T-B01": "correct_reject", "T-B04": "false_accept", "T-B06": "false_accept", "T-B07": "correct_reject", "T-B08": "correct_reject", "T-B09": "correct_reject", "T-B10": "false_accept"}
    chosen = [m for m in perturb.trades_mutations() if m.name in wanted]
    got = {o.mutation: o for o in perturb.outcomes(chosen, contract, raw)}
    assert {n: o.verdict for n, o in got.items()} == wanted
    assert got["T-B09"].stage == "derived" and got["T-P05"].stage == "heterogeneous" and got["T-P12"].observed == "accept_equiv_warn"
    assert perturb.mutated_cells(raw, chosen[1].apply(raw)).first()[0] == 40
    assert len(perturb.trades_mutations()) + len(perturb.bike_mutations()) == 51


def test_report_cells():
    assert [reports.cell(x) for x in (None, 0.12345, 1234.5, 12345, "x", float("nan"))] == ["—", "0.1235", "1,234", "12,345", "x", "—"]


def test_timing_reports(spark):
    rows = [(r, False, "materialized", float(r + 1)) for r in range(5)] + [(r, False, "monolithic", 2.0 * (r + 1)) for r in range(5)] + [(9, True, "monolithic", 9.0)]
    df = spark.createDataFrame(rows, "round int, warmup boolean, strategy string, seconds double").withColumn("task", F.lit("t"))
    assert tuple(reports.timing_comparison(df, ["task"]).select("pairs", "ratio", "delta").first()) == (5, 2.0, 3.0)
    row = reports.timing_summary(df.filter("strategy = 'materialized'"), ["task"]).first()
    assert (row["median"], row["iqr"], row["n"]) == (3.0, 2.0, 5)
