"""Pairing without a key against a plain largest matching."""

import math
import random

import pytest
from pyspark.sql import functions as F

from terrace.operators import compare
from terrace.operators.matching import unmatched


def close(x, y, rtol, atol):
    if x is None or y is None:
        return x is y
    if math.isnan(x) or math.isnan(y) or math.isinf(x) or math.isinf(y):
        return x == y or (math.isnan(x) and math.isnan(y))
    return abs(x - y) <= atol + rtol * abs(y)


def brute(a, b, rtol, atol):
    """The size of a largest one-to-one pairing, by augmenting paths over all pairs."""
    near = [[j for j, y in enumerate(b) if x[0] == y[0] and all(close(p, q, rtol, atol) for p, q in zip(x[1:], y[1:], strict=True))] for x in a]
    owner = {}

    def seek(i, seen):
        for j in near[i]:
            if j not in seen:
                seen.add(j)
                if j not in owner or seek(owner[j], seen):
                    owner[j] = i
                    return True
        return False

    return sum(seek(i, set()) for i in range(len(a)))


def left(spark, a, b, **tolerance):
    schema = "k string, v double, w double"
    rows = unmatched(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), **tolerance).collect()
    return {s: sum(r.n for r in rows if r.side == s) for s in "ab"}


@pytest.mark.parametrize(("rtol", "atol"), [(0.0, 0.0), (0.0, 1.0), (1e-2, 0.0), (1e-2, 0.5), (1e-9, 0.0)])
def test_against_a_plain_matching(spark, rtol, atol):
    for seed in range(2):
        draw = random.Random(seed)
        value = lambda: draw.choice([None, math.nan, math.inf, 0.0, -0.0, draw.uniform(-6, 6), draw.uniform(-6, 6), draw.uniform(-6, 6), draw.uniform(90, 110), 1e300, 1e-300])
        a = [(draw.choice("xy"), value(), value()) for _ in range(80)]
        moved = lambda v: v if v is None or draw.random() < 0.5 else v * (1 + draw.uniform(-1.2, 1.2) * rtol) + draw.uniform(-1.2, 1.2) * atol
        b = [(k, moved(v), moved(w)) for k, v, w in draw.sample(a, 70)] + [(draw.choice("xyz"), value(), value()) for _ in range(12)]
        paired = brute(a, b, rtol, atol)
        assert left(spark, a, b, rtol=rtol, atol=atol) == {"a": len(a) - paired, "b": len(b) - paired}


def test_crossed_order_and_chains(spark):
    # By the first float the rows pair one way, by the second the other: only one pairing is within the tolerance.
    a = [("x", 1.0, 9.0), ("x", 1.0 + 1e-12, 2.0)]
    b = [("x", 1.0 + 1e-12, 9.0), ("x", 1.0, 2.0)]
    assert left(spark, a, b, rtol=1e-9) == {"a": 0, "b": 0}
    # Pairing off what is equal would leave 0 alone with n.
    chain = [("x", float(i), 0.0) for i in range(20)]
    assert left(spark, chain, [(k, v + 1, w) for k, v, w in chain], atol=1.0) == {"a": 0, "b": 0}
    assert left(spark, chain, [(k, v + 1, w) for k, v, w in chain], atol=0.5) == {"a": 1, "b": 1}
    assert left(spark, [("x", 1.0, 1.0)] * 5, [("x", 1.0, 1.0)] * 3, atol=0.5) == {"a": 2, "b": 0}


def test_a_million_rows_of_one_exact_group(spark):
    a = spark.range(1_000_000, numPartitions=8).select(F.lit("x").alias("k"), F.rand(1).alias("v"), (F.rand(2) * 1e6).alias("w"))
    b = a.select("k", (F.col("v") * (1 + 1e-12)).alias("v"), (F.col("w") * (1 - 1e-12)).alias("w")).repartition(5)
    assert compare.compare_frames(a, b, rtol=1e-9).equal
    planted = b.withColumn("w", F.when(F.col("w") < 1.0, F.col("w") + 5e5).otherwise(F.col("w")))
    n = b.filter("w < 1.0").count()
    found = compare.compare_frames(a, planted, rtol=1e-9)
    assert n > 0 and not found.equal and found.why == [f"{2 * n} rows have no partner"] and set(found.samples) == {"a", "b"}


def test_edges(spark):
    assert left(spark, [], [], atol=1.0) == {"a": 0, "b": 0}
    assert left(spark, [], [("x", 1.0, None)], atol=1.0) == {"a": 0, "b": 1}
    with pytest.raises(ValueError):
        left(spark, [], [], rtol=1e-14)
    plain = spark.createDataFrame([(1,), (2,), (2,)], "n int")
    rows = unmatched(plain.withColumnRenamed("n", "m"), plain.filter("n = 2").withColumnRenamed("n", "m")).collect()
    assert [(r.side, r.m) for r in rows] == [("a", 1)]
