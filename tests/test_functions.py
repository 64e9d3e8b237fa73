import pytest

from terrace.functions import text as fn


def values(spark, column, rows, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(column("x")).collect()]


@pytest.mark.parametrize(
    ("function", "rows", "expected"),
    [
        (lambda c: fn.zfill(c, 5), ["3", "00003", "1234567", "-3", "+12", None], ["00003", "00003", "1234567", "-0003", "+0012", None]),
        (fn.to_int, ["12", "+7", "-7", " 7 ", "12.0", "１２", "", None, "1d"], [12, 7, -7, None, None, None, None, None, None]),
        (fn.to_float, ["1.5", ".5", "1e3", "NaN", "Infinity", "1d", "-2."], [1.5, 0.5, 1000.0, None, None, None, -2.0]),
        (fn.to_int_comma, [" 120,000", "9,500", "12만", "\t7\n"], [120000, 9500, None, 7]),
        (fn.to_year_month, ["2020-01", "202012", "2020-13", " 202207 ", "2020-1"], ["2020-01", "2020-12", None, "2022-07", None]),
        (fn.amount, ["72,000", "해당없음", "", None], [72000.0, None, None, None]),
        (fn.district_code, ["1110", " 1111", "", None, "11110"], ["01110", "01111", None, None, "11110"]),
        (fn.previous_year, ["2021-03", "1999-12"], ["2020-03", "1998-12"]),
        (fn.plain_name, [" -- ", "래미안 강남(1단지)", "A-b 2"], [None, "래미안강남1단지", "Ab2"]),
    ],
)
def test_text_functions(spark, function, rows, expected):
    assert values(spark, function, rows) == expected


def test_area_and_price(spark):
    buckets = values(spark, fn.area_bucket, [0.0, -1.0, 39.9, 40.0, 59.8, 84.97, 84.9, 135.0, None], "double")
    assert buckets == [None, None, "0-40", "40-60", "40-60", "60-85", "60-85", "135+", None]
    rows = spark.createDataFrame([(100.0, 50.0), (100.0, 0.0), (None, 5.0)], "a double, m double")
    assert [r[0] for r in rows.select(fn.price_per_m2("a", "m")).collect()] == [20000.0, None, None]


def test_dates_of_parts(spark):
    rows = spark.createDataFrame([(2023, 1, 5), (2023, 2, 30), (2023, None, 1), (2024, 2, 29)], "y int, m int, d int")
    got = [str(r[0]) if r[0] else None for r in rows.select(fn.date_of_parts("y", "m", "d")).collect()]
    assert got == ["2023-01-05", None, None, "2024-02-29"]


def test_normal_form(spark):
    rows = spark.createDataFrame([("가",), ("가",), (None,)], "n string")
    got = [r[0] for r in rows.select(fn.plain_name(fn.nfc("n"))).collect()]
    assert got == ["가", "가", None]


def test_year_month_of_checks_no_range(spark):
    rows = spark.createDataFrame([("2020", "1"), ("2020", "13"), ("x", "1"), (None, "1")], "y string, m string")
    assert [r[0] for r in rows.select(fn.year_month_of("y", "m")).collect()] == ["2020-01", "2020-13", None, None]
