"""Classes and sets of mutations against Python's sets."""

import itertools
import random

import pytest

from terrace.operators import verdict_sets as vs

SCHEMA = "mutation string, dataset string, kind string, n_cells_mutated int, observed string, verdict string, failure_stage string"
ROWS = [
    ("T-B01", "t", "B", 3, "reject", "correct_reject", "casts"),
    ("T-B02", "t", "B", 3, "accept_equiv", "false_accept", None),
    ("T-B03", "t", "B", 0, "accept_equiv_warn", "warned", None),
    ("T-P01", "t", "P", 1, "accept_equiv", "correct_accept", None),
    ("T-P02", "t", "P", 1, "reject", "false_reject", "coalesce"),
]
CLASSES = [("T-B02", "not_expressible"), ("T-B03", "undeclared_but_expressible")]


def frames(spark, classes=CLASSES, rows=ROWS):
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(classes, "mutation string, contract_class string")


def test_classes_and_appendix(spark):
    verdicts, classes = frames(spark)
    breaks = vs.classified(verdicts, classes)
    assert {r.mutation: r.contract_class for r in breaks.collect()} == {"T-B01": "declared_or_covered", **dict(CLASSES)}
    assert [tuple(r)[1:] for r in vs.by_class(breaks).orderBy("place").collect()] == [("declared_or_covered", 1, 1, 0), ("undeclared_but_expressible", 1, 0, 1), ("not_expressible", 1, 0, 1), ("total", 3, 1, 2)]
    got = {r.mutation: (r.failure_stage, r.contract_class) for r in vs.appendix(verdicts, breaks).collect()}
    assert got == {"T-B01": ("casts", "declared_or_covered"), "T-B02": ("—", "not_expressible"), "T-B03": ("—", "undeclared_but_expressible"), "T-P01": ("—", "—"), "T-P02": ("coalesce", "—")}


@pytest.mark.parametrize("classes", [CLASSES[:1], [*CLASSES, ("T-B01", "not_expressible")], [*CLASSES, ("T-X", "not_expressible")], [*CLASSES, CLASSES[0]], [*CLASSES, ("T-P01", "not_expressible")]])
def test_classes_must_name_what_passed(spark, classes):
    with pytest.raises(Exception, match="classes and silent mutations differ"):
        vs.classified(*frames(spark, classes)).collect()


def test_no_mutations(spark):
    verdicts, classes = frames(spark)
    empty = vs.classified(verdicts.limit(0), classes.limit(0))
    assert empty.collect() == [] and [tuple(r)[2:] for r in vs.by_class(empty).collect()] == [(0, 0, 0)] * 4


def test_sets_against_python(spark):
    draw = random.Random(7)
    ids = [f"m{i:06d}" for i in range(40_000)]  # two buckets
    groups = {g: set(draw.sample(ids, n)) for g, n in (("a", 20_000), ("b", 9000), ("c", 1))}
    rows = spark.createDataFrame([(g, m) for g, some in groups.items() for m in some] + [("c", next(iter(groups["c"])))], "group string, mutation string")
    numbers = vs.numbered(spark.createDataFrame([(i,) for i in ids], "mutation string"))
    assert [(r.mutation, r.number) for r in numbers.orderBy("mutation").collect()] == [(m, i) for i, m in enumerate(ids)]
    sets = vs.bitmaps(rows.join(numbers, "mutation"), ["group"])
    assert {r.group: r.n for r in vs.sizes(sets, ["group"]).collect()} == {g: len(s) for g, s in groups.items()}
    assert vs.sizes(vs.merged(sets.drop("group"), []), []).first().n == len(set().union(*groups.values()))
    expected = {(x, y): (len(groups[x]), len(groups[y]), len(groups[x] & groups[y]), len(groups[x] - groups[y]), len(groups[y] - groups[x])) for x, y in itertools.combinations("abc", 2)}
    assert {(r.a, r.b): tuple(r)[2:] for r in vs.overlaps(sets, "group").collect()} == expected
    assert vs.overlaps(sets.limit(0), "group").collect() == []


def test_reports_of_runs(spark):
    runs = spark.createDataFrame([("t1", "silver", 5, "a" * 64), ("t1", "gold", 5, "b" * 64), ("t1", "bronze", 5, "a" * 64), ("t2", "gold", 1, "c" * 64)], "task string, condition string, rows int, output_hash string")
    assert {(r.task, r.condition): (r.equivalence, r.output_hash) for r in vs.preparation(runs).collect()} == {("t1", "silver"): ("PASS", "a" * 12), ("t1", "gold"): ("FAIL", "b" * 12), ("t1", "bronze"): ("PASS", "a" * 12), ("t2", "gold"): ("FAIL", "c" * 12)}
    sources = spark.createDataFrame([("G1", 5, "ok", None, 5, "d" * 64), ("G2", 5, "failed", "casts", None, "e" * 64)], "generation string, rows_in int, status string, failed_stage string, rows_out int, config_hash string")
    assert [(r.result, r.failed_stage) for r in vs.source_evolution(sources).collect()] == [("accepted", "—"), ("rejected", "casts")]
