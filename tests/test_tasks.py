import pytest

from terrace.operators import join_task, price_task
from terrace.operators.contract import Contract, compile_contract
from terrace.plans.proxy import TRADES

BRONZE = "sggCd string, aptNm string, excluUseAr string, dealAmount string, dealYear string, dealMonth string, dealDay string"


def bronze(spark):
    return spark.createDataFrame(
        [
            ("11110", "a", "54.7", "31,000", "2020", "1", "3"),
            ("11110", "a", "84.93", "53,000", "2020", "1", "13"),
            ("11110", "a", "54.7", "40,000", "2020", "2", "5"),
            ("11140", "b", "163.33", "120,000", "2020", "1", "2"),
        ],
        BRONZE,
    )


def rows(df):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())


def test_bronze_and_silver_agree(spark):
    silver = compile_contract(Contract.of(TRADES), bronze(spark)).checked()
    a, b = (rows(price_task.gold(p)) for p in (price_task.prepared_from_bronze(bronze(spark)), price_task.prepared_from_silver(silver)))
    assert a == b and len(a) == 3


def test_only_usable_rows_count(spark):
    df = spark.createDataFrame([("11110", "2020-01", 100.0), ("11110", "2020-01", None), ("11140", "2020-02", None), (None, "2020-02", 1.0)], "district_code string, year_month string, price_per_m2 double")
    assert rows(price_task.gold(df)) == [("11110", "2020-01", 1, 100.0, 100.0)]


def test_the_year_before_is_found_by_key(spark):
    table = spark.createDataFrame([("11110", f"2020-{m:02d}", 1, 100.0, 100.0) for m in range(1, 13)] + [("11110", "2021-02", 1, 110.0, 110.0)], "district_code string, year_month string, n_deals bigint, mean_price_per_m2 double, median_price_per_m2 double")
    got = {r.year_month: r.mean_price_yoy_change for r in price_task.analyze(table).collect()}
    assert got.pop("2021-02") == pytest.approx(0.1) and set(got.values()) == {None}


def test_rank_is_of_the_latest_month(spark):
    table = spark.createDataFrame([("a", "2020-01", 1, 9.0, 9.0), ("b", "2020-02", 1, 5.0, 5.0), ("c", "2020-02", 1, 7.0, 7.0)], "district_code string, year_month string, n_deals bigint, mean_price_per_m2 double, median_price_per_m2 double")
    assert {r.district_code: r.price_rank for r in price_task.analyze(table).collect()} == {"a": None, "b": 2, "c": 1}


KEYED = "district_code string, apt_name string, year_month string, area_bucket string, value double"


def test_fold_join_and_diagnostics(spark):
    sales = spark.createDataFrame([("d", "n", "2020-01", "b", 100.0), ("d", "n", "2020-01", "b", 200.0), ("d", "m", "2020-01", "b", 1.0), (None, "m", "2020-01", "b", 1.0)], KEYED)
    jeonse = spark.createDataFrame([("d", "n", "2020-01", "b", 60.0), ("e", "n", "2020-01", "b", 1.0)], KEYED)
    s, j = join_task.fold(sales), join_task.fold(jeonse)
    assert {r.value for r in s.collect()} == {150.0, 1.0}
    assert rows(join_task.gold(join_task.joined(s, j))) == [("d", "2020-01", 1, 150.0, 60.0)]
    assert tuple(join_task.diagnostics(s, j).first()) == (0.5, 1, 1)
    assert tuple(join_task.diagnostics(s.limit(0), j).first()) == (0.0, 0, 2)
    assert join_task.invalid_key_rate(sales).first()[0] == 0.25
    assert join_task.invalid_key_rate(sales.limit(0)).first()[0] == 0.0


def test_ratio_and_its_change(spark):
    table = spark.createDataFrame([("d", "2020-03", 1, 10.0, 5.0), ("d", "2021-03", 1, 10.0, 6.0), ("e", "2021-03", 1, 0.0, 6.0)], "district_code string, year_month string, n_matched bigint, mean_sale_price_per_m2 double, mean_jeonse_deposit_per_m2 double")
    got = {(r.district_code, r.year_month): (r.jeonse_ratio, r.jeonse_ratio_yoy_change) for r in join_task.analyze(table).collect()}
    assert got["d", "2020-03"] == (0.5, None) and got["e", "2021-03"] == (None, None)
    assert got["d", "2021-03"] == (0.6, pytest.approx(0.1))


def test_unknown_monthly_rent_is_no_jeonse(spark):
    df = spark.createDataFrame([("0",), ("150",), (None,), ("x",)], "monthlyRent string")
    assert join_task.jeonse_only(df).count() == 1


def test_names_meet_after_normalisation(spark):
    df = spark.createDataFrame([("1110", "래미안 강남 힐즈(1단지)", "84.97", "120,000", "2021", "3", "1"), ("1110", "래미안강남힐즈 1단지", "84.9", "90,000", "2021", "3", "1"), ("1110", " -- ", "84.9", "1", "2021", "3", "1")], BRONZE)
    got = join_task.prepared_from_bronze(df, "dealAmount").collect()
    assert sorted(str(r.apt_name) for r in got) == ["None", "래미안강남힐즈1단지", "래미안강남힐즈1단지"]
    assert {r.district_code for r in got} == {"01110"} and {r.area_bucket for r in got} == {"60-85"}
