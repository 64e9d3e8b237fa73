"""Layers brought up to date by partition equal layers built anew, and keep the files of what did not move."""

import random

from pyspark.sql import functions as F

from terrace.sources import incremental as inc

SCHEMA = "m string, k int, v double"


def rows(n=300):
    draw = random.Random(8)
    return [(draw.choice(["2020-01", "2020-02", "a/b=c", None]), i, draw.choice([0.1, None, 2.5])) for i in range(n)]


def build(df):
    return df.groupBy("m").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("v")).filter("n > 1")


def files(path):
    return {str(f.relative_to(path)) for f in (path / "rows").rglob("*.parquet")}


def told(refreshed):
    return {(r.m, r.change) for r in refreshed.rebuilt.collect()}


def same(refreshed, source):
    assert sorted(map(str, refreshed.rows.collect())) == sorted(map(str, build(source).select(*refreshed.rows.columns).collect()))


def test_only_what_moved_is_rebuilt(spark, tmp_path):
    some, path = rows(), tmp_path / "layer"
    run = lambda df, recipe="": inc.refresh(df, str(path), ["m"], build, recipe)
    source = spark.createDataFrame(some, SCHEMA)
    first = run(source)
    same(first, source)
    assert told(first) == {(m, "new") for m in ("2020-01", "2020-02", "a/b=c", None)}
    before = files(path)

    again = run(source.repartition(5).orderBy("v"))
    assert told(again) == set() and files(path) == before
    same(again, source)

    changed = spark.createDataFrame([(m, k, 9.0 if (m, k) == next((m, k) for m, k, _ in some if m == "2020-02") else v) for m, k, v in some], SCHEMA)
    moved = run(changed)
    assert told(moved) == {("2020-02", "moved")}
    assert {f for f in before ^ files(path)} == {f for f in before | files(path) if "2020-02" in f}
    same(moved, changed)

    odd = changed.filter("m is null or m <> 'a/b=c'").unionByName(spark.createDataFrame([("2021-01", 1, 1.0), ("2021-01", 2, 1.0), ("2021-02", 1, 1.0)], SCHEMA))
    other = run(odd)
    assert told(other) == {("a/b=c", "gone"), ("2021-01", "new"), ("2021-02", "new")}
    same(other, odd)  # of 2021-02 no row comes out

    alone = odd.filter("m is null or m <> '2021-01' or k = 1")
    emptied = run(alone)
    assert told(emptied) == {("2021-01", "moved")}
    same(emptied, alone)
    assert not any("2021-01" in f for f in files(path))

    assert told(run(alone, "another recipe")) == {(m, "moved") for m in ("2020-01", "2020-02", "2021-01", "2021-02", None)}


def test_a_refresh_cut_off_is_done_again(spark, tmp_path, monkeypatch):
    some, path = rows(), str(tmp_path / "layer")
    source = spark.createDataFrame(some, SCHEMA)
    inc.refresh(source, path, ["m"], build)
    changed = source.withColumn("v", F.when(F.col("m") == "2020-01", 7.0).otherwise(F.col("v")))
    with monkeypatch.context() as cut:
        cut.setattr(inc, "_move", lambda *a: (_ for _ in ()).throw(OSError("cut off")))
        try:
            inc.refresh(changed, path, ["m"], build)
        except OSError:
            pass
    again = inc.refresh(changed, path, ["m"], build)
    assert told(again) == {("2020-01", "moved")}
    same(again, changed)


def test_an_empty_source(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    got = inc.refresh(empty, str(tmp_path / "layer"), ["m"], build)
    assert got.rows.collect() == [] and told(got) == set()


def test_a_refresh_builds_its_rows_once(spark, tmp_path):
    built = spark.sparkContext.accumulator(0)

    def seen(m):
        built.add(1)
        return m

    path, source = str(tmp_path / "layer"), spark.createDataFrame([("2020-01", 1, 0.5)] * 40 + [("2020-02", 2, 0.5)] * 60, SCHEMA)
    through = lambda df: df.filter(F.udf(seen, "string")("m").isNotNull())
    inc.refresh(source, path, ["m"], through)
    assert built.value == 100
    inc.refresh(source.filter("m = '2020-01' or k < 2").unionByName(source.filter("m = '2020-02'").limit(7)), path, ["m"], through)
    assert built.value <= 147  # no row of the source twice
