"""Reading by value and by row give the same rows."""

import random

import pytest
from pyspark.sql import functions as F

from terrace.functions import text as fn
from terrace.operators import dictionary as dic
from terrace.operators import join_task, price_task
from terrace.sources import records

SALES = "sggCd string, aptNm string, excluUseAr string, dealAmount string, dealYear string, dealMonth string"


def sales(spark, n=600):
    draw = random.Random(2)
    of = lambda *values: draw.choice(values)
    rows = [(of("11110", "1110", " 11140 ", "", None), of("래미안 (1)", "래미안1", "한 2", " -- ", None), of("84.9", "0", "x", None, "59"), of(f"{draw.randrange(99)},000", "12만", None, f"{draw.randrange(10**6)}"), of("2020", " 2021", "", None), of("1", "12", "13")) for _ in range(n)]
    return spark.createDataFrame(rows, SALES)


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("road", [{}, {"roads": [True] * 5}, {"roads": [False] * 5}, {"most": 3}, {"shrink": 1.5}])
def test_both_roads_agree(spark, road):
    df = sales(spark)
    assert rows(join_task.prepared_by_value(df, "dealAmount", **road)) == rows(join_task.prepared_from_bronze(df, "dealAmount"))
    road = {k: v[:4] if k == "roads" else v for k, v in road.items()}
    assert rows(price_task.prepared_by_value(df, **road)) == rows(price_task.prepared_from_bronze(df))


def test_the_size_decides(spark):
    df = sales(spark)
    groups = [dic.Group(["sggCd"]), dic.Group(["dealYear", "dealMonth"]), dic.Group(["dealAmount"])]
    assert dic.shrinking(df, groups) == [True, True, False]
    assert dic.shrinking(df, groups, most=4) == [False, False, False]
    assert dic.shrinking(df.limit(0), groups) == [True, True, True]
    plan = price_task.prepared_by_value(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 3 and "rightHint=(strategy=broadcast)" in plan


def test_too_large_to_broadcast_is_joined_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(dic, "MOST_BYTES", 4)
    df = sales(spark)
    got = price_task.prepared_by_value(df, roads=[True] * 4)
    assert rows(got) == rows(price_task.prepared_from_bronze(df))
    assert "strategy=broadcast" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert dic.encoded(df, ["sggCd"]).values is None


def test_texts_are_grouped_without_a_sort(spark):
    df = sales(spark)
    values = dic.values_of(df, [dic.Group(["sggCd"]), dic.Group(["dealYear", "dealMonth"])])
    assert "Sort" not in values._jdf.queryExecution().executedPlan().toString()
    wanted = [(0, r[0], None, None) for r in df.select("sggCd").distinct().collect()] + [(1, None, *r) for r in df.select("dealYear", "dealMonth").distinct().collect()]
    assert rows(values.select("__group", "sggCd", "dealYear", "dealMonth")) == sorted(f"Row(__group={g}, sggCd={a!r}, dealYear={y!r}, dealMonth={m!r})" for g, a, y, m in wanted)


def test_values_of_several_types_stay_apart(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("\n".join('{"x": %s}' % draw for draw in ["1", "1.0", '"1"', "null", "true"] * 20))
    df = records.read_jsonl(spark, str(tmp_path))
    group = dic.Group(["x"], {"kind": dic.json_kind("x"), "text": dic.json_text("x")})
    assert dic.values_of(df, [group]).count() == 5
    got = dic.evaluated(df, [group], roads=[True])
    assert rows(got.select("_ordinal", "kind", "text")) == rows(df.select("_ordinal", *[c.alias(n) for n, c in group.outputs.items()]))


def test_codes_are_dense_and_rows_come_back(spark):
    df = sales(spark).withColumn("at", F.monotonically_increasing_id())
    got = dic.encoded(df, ["dealYear", "dealMonth"])
    codes = sorted(r.code for r in got.values.collect())
    assert codes == list(range(len(codes))) and got.rows.filter("code is null").count() == 0
    assert {"dealYear", "dealMonth"}.isdisjoint(got.rows.columns)
    assert rows(got.decoded().select(*df.columns)) == rows(df)
    read = got.read({"ym": fn.year_month_of("dealYear", "dealMonth")})
    assert rows(read.select("at", "ym")) == rows(df.select("at", fn.year_month_of("dealYear", "dealMonth").alias("ym")))
    kept = dic.encoded(df, ["dealAmount"])
    assert kept.values is None and rows(kept.decoded().select(*df.columns)) == rows(df)


def test_an_empty_frame(spark):
    assert price_task.prepared_by_value(sales(spark).limit(0)).collect() == []
