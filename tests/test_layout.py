"""Ordered files, positions and buckets."""

import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from terrace.operators import pairing
from terrace.operators.contract import Contract, compile_contract
from terrace.operators.roles import plan_roles
from terrace.sources import layout

ORDER = {"condition": ("bronze", "silver", "gold", "monolithic"), "generation": ("G1", "G2", "I1", "G3", "G4")}


def rows(n=800):
    draw = random.Random(6)
    return [(draw.choice(["silver", "gold", "bronze", "monolithic", "other", None, "another"]), draw.choice(["G4", "I1", "G1", "G3", "G2"]), draw.choice([None, *range(40)])) for _ in range(n)]


def key(r):
    place = lambda order, x: (order.index(x), "") if x in order else (len(order), x is None, x or "")
    return (place(ORDER["condition"], r[0]), place(ORDER["generation"], r[1]), r[2] is None, r[2] or 0)


def test_fixed_orders():
    assert layout.ORDERS == ORDER


def test_files_read_in_order_are_sorted(spark, tmp_path):
    some, keys = rows(), ["condition", "generation", "n"]
    df = spark.createDataFrame(some, "condition string, generation string, n int").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        layout.land_sorted(df, str(tmp_path / "a"), keys, layout.ORDERS)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = sorted((tmp_path / "a").glob("part-*.parquet"))
    read = [tuple(r.values()) for f in files for r in pq.ParquetFile(f).read().to_pylist()]
    assert len(files) > 2 and read == sorted(some, key=key)
    assert layout.order_breaks(spark, str(tmp_path / "a"), keys, layout.ORDERS).collect() == []
    got = layout.positioned(spark, str(tmp_path / "a")).orderBy("_ordinal").collect()
    assert [r[0] for r in got] == list(range(len(some))) and [tuple(r[1:]) for r in got] == read
    with pytest.raises(Exception, match="exists"):
        layout.land_sorted(df, str(tmp_path / "a"), keys)


def test_breaks_are_told(spark, tmp_path):
    pieces = [[1, 2, 3], [2, 5], [6, 5, 7], [7, None]]
    for i, piece in enumerate(pieces):
        spark.createDataFrame([(x,) for x in piece], "n int").coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
    (tmp_path / "layer").mkdir()
    for i in range(len(pieces)):
        (file,) = (tmp_path / "in" / f"{i}").glob("*.parquet")
        file.rename(tmp_path / "layer" / f"part-0000{i}.parquet")
    got = layout.order_breaks(spark, str(tmp_path / "layer"), ["n"]).collect()
    assert sorted((r.file[9], r.within, r.overlaps) for r in got) == [("1", 0, True), ("2", 1, False)]
    assert [r.n for r in layout.positioned(spark, str(tmp_path / "layer")).orderBy("_ordinal").collect()] == [x for p in pieces for x in p]


def test_an_empty_layer(spark, tmp_path):
    layout.land_sorted(spark.createDataFrame([], "n int"), str(tmp_path / "a"), ["n"])
    assert layout.order_breaks(spark, str(tmp_path / "a"), ["n"]).collect() == [] and layout.positioned(spark, str(tmp_path / "a")).collect() == []


def test_bucketed_layers_pair_without_a_shuffle(spark, tmp_path):
    contract = Contract.of({"rename": {"fee": "fee_krw"}, "casts": {"fee_krw": "int_comma"}, "required": ["fee_krw"]})
    bronze = spark.range(500).select(F.col("id").alias("_ordinal"), F.format_number(F.col("id") * 100, 0).alias("fee"))
    silver, roles = compile_contract(contract, bronze).silver, plan_roles(contract)
    names = ("paired_bronze", "paired_silver")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        landed = [layout.land_bucketed(df, n, f"file://{tmp_path}/{n}", 4) for n, df in zip(names, (bronze, silver), strict=True)]
        found = pairing.pair_and_classify(*landed, roles)
        plan = found._jdf.queryExecution().executedPlan().toString()
        join = plan[plan.index("SortMergeJoin") :]
        assert "Exchange" not in join and join.count("Bucketed: true") == 2
        assert [r.asDict() for r in found.collect()] == [r.asDict() for r in pairing.pair_and_classify(bronze, silver, roles).collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for n in names:
            spark.sql(f"drop table if exists {n}")


def test_buckets_grow_in_number_and_not_in_size(spark):
    assert [layout.buckets_for(spark.range(n)) for n in (0, 150_000, 9_000_000)] == [8, 8, 69]
    assert [layout.buckets_for(spark.range(n), least=1, rows=100) for n in (100, 101, 10**9)] == [1, 2, 100_000]


def test_role_pairs_are_bucketed_by_their_rows(spark, monkeypatch):
    from terrace.plans import measure_queries

    monkeypatch.setattr(layout.buckets_for, "__defaults__", (8, 50))
    asked, land = [], layout.land_bucketed
    monkeypatch.setattr(layout, "land_bucketed", lambda df, name, path, buckets: asked.append(buckets) or land(df, name, path, buckets))
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").count()
    got = measure_queries.role_pairs_bucketed(spark, "/root/testdata/sf0.001")
    assert asked == [-(-orders // 50)] * 2 and asked[0] > 8
    assert {r.rows for r in got.collect()} == {orders}
