"""Trees of digests against plain comparison."""

import random

import pytest
from pyspark.sql import functions as F

from terrace.operators import hash_tree as ht

SCHEMA = "k string, m int, v double, t string"


def rows(n=500):
    draw = random.Random(3)
    return [(draw.choice(["a", "b", "한", None]), i, draw.choice([0.1, -0.0, 1e9, None]), draw.choice(["x", "", None])) for i in range(n)]


def frame(spark, some):
    return spark.createDataFrame(some, SCHEMA)


def root(df, **more):
    return [r.digest for r in ht.tree(df, ["k", "m"], **more).filter("level = 0").collect()]


def test_order_and_partitions_do_not_matter(spark):
    some = rows()
    a = frame(spark, some)
    assert root(a) == root(frame(spark, some[::-1]).repartition(7).select("t", "m", "v", "k"))
    nodes = ht.tree(a, ["k", "m"]).collect()
    for level in range(4):
        assert sum(r.rows for r in nodes if r.level == level) == len(some)
    assert root(a) != root(a.unionByName(a.limit(1))) and root(a.limit(0)) == []
    # Null is no text, and -0.0 is 0.0.
    assert root(frame(spark, [("a", 1, 0.0, None)])) == root(frame(spark, [("a", 1, -0.0, None)])) != root(frame(spark, [("a", 1, 0.0, "")]))
    repeated = frame(spark, [("a", 1, 0.5, "x")] * 2)
    assert root(repeated) != root(repeated.limit(1))


def test_planted_changes_are_located(spark):
    some = rows()
    other = [r for r in some if r[1] != 17]
    other = [(k, m, v, "changed") if m == 33 else (k, m, 5.5, None) if m == 44 else (k, m, v and v * (1 + 1e-12), t) if m % 9 == 0 else (k, m, v, t) for k, m, v, t in other] + [(None, 9000, 1.0, "new")]
    a, b = frame(spark, some), frame(spark, other).repartition(5)
    expected = {(17, "*"), (9000, "*"), (33, "t"), (44, "v")} | ({(44, "t")} if some[44][3] is not None else set())
    got = ht.differences(a, b, ["k", "m"], rtol=1e-9).collect()
    assert {(r.m, r.column) for r in got} == expected and len(got) == len(expected)
    rounded = ht.narrowed(a, b, ["k", "m"], {"v": 6})
    assert rounded[0].count() < 0.1 * len(some) < len(some)  # only leaves with a change are read
    levels = [ht.differing(ht.tree(a, ["k", "m"]), ht.tree(b, ["k", "m"])).filter(F.col("level") == i).count() for i in range(4)]
    assert levels[0] == 1 and levels[1] <= levels[2] <= levels[3]


def test_without_a_key_and_without_rows(spark):
    a = frame(spark, rows())
    assert ht.differing(ht.tree(a, []), ht.tree(a.repartition(3), [])).count() == 0
    empty = a.limit(0)
    assert ht.differences(empty, empty, ["k", "m"]).collect() == []
    assert {(r.level, r.rows_a, r.rows_b) for r in ht.differing(ht.tree(empty, ["k"]), ht.tree(frame(spark, rows(1)), ["k"])).collect()} == {(i, 0, 1) for i in range(4)}


def test_routes(spark):
    a = frame(spark, rows())
    route = lambda name, df, task="t1": ht.Route(task, name, df)
    changed = a.withColumn("v", F.when(F.col("m") == 7, 3.25).otherwise(F.col("v")))
    got = {r.route: (r.rows, r.equal, r.ranges) for r in ht.equivalence([route("bronze", a), route("silver", a.repartition(3)), route("gold", changed), route("monolithic", a.limit(0))], ["k", "m"]).collect()}
    leaves = ht.leaves(a, ["k", "m"]).count()
    assert got == {"bronze": (500, True, 0), "silver": (500, True, 0), "gold": (500, False, 1), "monolithic": (0, False, leaves)}
    assert [(r.rows, r.equal, r.ranges) for r in ht.equivalence([route("bronze", a.limit(0)), route("silver", a.limit(0))], ["k"]).collect()] == [(0, True, 0)] * 2
    for bad in ([route("bronze", a), route("silver", a, "t3")], [route("bronze", a), route("bronze", a)], [route("bronze", a), route("silver", a.drop("t"))]):
        with pytest.raises(ValueError):
            ht.equivalence(bad, ["k"])


def test_states_are_sums_of_longs_and_texts_tell_rows_apart(spark):
    a = frame(spark, rows())
    assert {t for c, t in ht.leaves(a, ["k", "m"]).dtypes if c.startswith("s")} == {"bigint"}
    odd = [("a", 1, 0.5, t) for t in (None, "", "-", "1:a", "--", ":")] + [(k, 1, 0.5, t) for k, t in (("1:", ""), ("", "1:"), ("-", None), (None, "-"))]
    assert frame(spark, odd).select(ht.canonical(frame(spark, odd))).distinct().count() == len(odd)
    whole = lambda df: [tuple(r) for r in ht.partition_digests(df).collect()]
    assert whole(a) == whole(a.repartition(5)) != whole(a.unionByName(a.limit(1))) and whole(a.limit(0))[0][0] == 0
