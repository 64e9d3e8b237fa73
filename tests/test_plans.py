from datetime import date

import pytest

from terrace.plans import identity as ident
from terrace.plans import runs
from terrace.plans.catalog import LayerStore
from terrace.sources import records


def test_tree_digest_and_snapshots(tmp_path):
    source = tmp_path / "src"
    source.mkdir()
    (source / "a.jsonl").write_text('{"k": 1}\n')
    (source / ".hidden").write_text("x")
    first = ident.tree_digest(source)
    (source / "metadata.json").write_text("{}")
    assert ident.tree_digest(source) == first and list(first.files) == ["a.jsonl"]
    store = ident.SnapshotStore(tmp_path / "snapshots")
    made = store.register(source, "trades", date(2026, 1, 2), 1, ["k"])
    assert made == store.register(source, "trades", date(2026, 1, 2), 1, ["k"]) and made.snapshot_id == f"20260102-{first.short}"
    assert store.verify_all() == {f"trades/{made.snapshot_id}": True}
    (tmp_path / "snapshots" / "trades" / made.snapshot_id / "a.jsonl").write_text("changed")
    assert not store.verify("trades", made.snapshot_id)
    with pytest.raises(ident.IdentityError):
        ident.tree_digest(tmp_path / "nothing")


def test_config_hash_ignores_order_and_run_scoped_keys():
    a = {"rename": {"x": "y"}, "casts": {"y": "int"}, "output_path": "/a"}
    b = {"casts": {"y": "int"}, "rename": {"x": "y"}, "nested": {}, "title": "t"}
    b.pop("nested")
    assert ident.config_hash(a) == ident.config_hash(b) != ident.config_hash({"rename": {"x": "z"}})
    with pytest.raises(ValueError):
        ident.config_hash({"x": float("nan")})


def build(dataset, layer, upstream=None, snapshot="s", **more):
    return ident.Build(dataset, layer, snapshot, "b+c", "c", "sum", 1, ["k"], upstream, **more)


def test_lineage(tmp_path):
    store = ident.BuildStore(tmp_path)
    bronze = build("a", "bronze")
    silver = build("a", "silver", bronze.build_id)
    other = build("b", "bronze")
    other_silver = build("b", "silver", other.build_id)
    gold = ident.joined_build("ab", "gold", [other_silver, silver], "recipe", checksum="g", rows=1, columns=[])
    for b in (bronze, silver, other, other_silver, gold):
        store.write(b)
    assert [b.layer for b in store.lineage(gold.build_id)] == ["bronze", "bronze", "silver", "silver", "gold"]
    assert store.matching("s", "c", "b", "sum").build_id in {b.build_id for b in store.all()}
    for broken in (lambda: build("a", "bronze", "x"), lambda: build("a", "silver"), lambda: ident.joined_build("a", "gold", [silver], "r", checksum="", rows=0, columns=[]), lambda: store.find("none")):
        with pytest.raises(ident.IdentityError):
            broken()


def test_manifest(tmp_path):
    (tmp_path / "r.csv").write_text("1")
    known = ident.manifest([tmp_path / "r.csv"])
    assert ident.manifest_breaks(known, tmp_path) == []
    (tmp_path / "r.csv").write_text("2")
    assert ident.manifest_breaks(known, tmp_path) == ["r.csv"]


def test_steps_count_at_the_top_level_only():
    steps = runs.Steps()
    with pytest.raises(ValueError), steps.step("outer"), steps.step("inner"):
        raise ValueError
    with steps.step("next"):
        pass
    assert steps.names == ["outer", "next"] and steps.depth == 0


def prepare_rows(ctx):
    """Two rows."""
    with ctx.steps.step("load"):
        # a comment
        return ctx.spark.range(2).selectExpr("id", "id / 3.0 as v")


def prepare_failing(ctx):
    return ctx.spark.sql("select cast('x' as int) as id")


def test_runs_and_results(spark, tmp_path):
    task = runs.Task("t", {"bronze": prepare_rows, "gold": prepare_rows, "silver": prepare_failing}, lambda df: df)
    context = lambda c: runs.RunContext(spark, "t", c, "d", lambda *_: None)
    good = [runs.run_condition(task, context(c)) for c in ("bronze", "gold")]
    failed = runs.run_condition(task, context("silver"))
    assert failed["status"] == "failed" and good[0]["output_hash"] == good[1]["output_hash"] and good[0]["transformation_steps"] == 1
    with pytest.raises(ValueError, match="no condition"):
        runs.run_condition(task, context("monolithic"))
    store = runs.ResultStore(spark, str(tmp_path / "results"))
    store.append([*good, failed])
    assert store.query().count() == 2 and store.query(status=None, condition="silver").count() == 1
    for bad in ({**good[0]}, {**good[0], "run_id": "n", "condition": "nowhere"}, {**good[0], "run_id": "m", "beauty": 1}, {**good[0], "run_id": "o", "output_hash": None}):
        with pytest.raises(ValueError):
            store.append([bad])
    (tmp_path / "results").rename(tmp_path / "results.next")
    assert store.load().count() == 3  # a replacement cut off between its two steps
    store.drop_task("other")
    assert store.load().count() == 3 and not (tmp_path / "results.next").exists()
    store.drop_task("t")
    assert store.load().count() == 0


def test_code_metrics():
    assert runs.code_metrics(prepare_rows) == {"loc": 3, "net_loc": 2, "functions": 1, "steps": 1}
    assert runs.effective_lines('"""doc"""\n\nx = 1  # one\n# two\ny = (\n    2\n)\n') == 4
    assert runs.effective_lines('class A:\n    """doc\n    more"""\n\n    def f(self):\n        # one\n        return """a\n\n# b"""\n') == 5
    assert runs.redefined("def a(): pass\ndef b(): pass", "def b(): pass") == {"b"}


def test_schedule_and_pairs():
    assert [s[0] for _, _, s in runs.schedule(2, ("a", "b"))] == ["a", "b", "b", "a", "a", "b"]
    rows = [{"round": r, "warmup": False, "strategy": s, "seconds": k * (r + 1)} for r in range(5) for s, k in (("materialized", 1.0), ("monolithic", 2.0))]
    assert runs.paired(rows) == {"pairs": 5, "ratio": 2.0, "delta": 3.0}
    assert runs.reproducibility(["a", "a", None])["equal"] is True and runs.reproducibility(["a"])["equal"] is None and runs.reproducibility(["a", "b"])["equal"] is False


def test_jsonl_keeps_types_and_order(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text('{"x": 0, "y": "0"}\n\n{"x": "0"}\n{"x": 1.5, "z": null}\n')
    assert tuple(records.scan_jsonl(spark, str(tmp_path / "in")).first()) == (3, ["x", "y", "z"])
    df = records.read_jsonl(spark, str(tmp_path / "in"))
    assert {r.field: r.types for r in records.field_types(df).collect()} == {"x": ["float", "int", "str"], "y": ["str"], "z": []}
    assert [r[0] for r in df.orderBy("_ordinal").select("_ordinal").collect()] == [0, 1, 2]
    native = records.as_declared(df, {"x": ["float", "int", "str"], "y": ["str"], "z": []})
    assert [r.x for r in native.orderBy("_ordinal").collect()] == ["0", '"0"', "1.5"]
    store = LayerStore(spark, {("d", "bronze"): str(tmp_path / "gone"), ("e", "bronze"): str(tmp_path / "out")})
    with pytest.raises(FileNotFoundError):
        store.load("d", "bronze")
    with pytest.raises(LookupError):
        store.load("d", "silver")
    records.land(native, str(tmp_path / "out"))
    assert store.load("e", "bronze").count() == 3


def test_samples_and_months(spark):
    df = spark.range(10).withColumnRenamed("id", "_ordinal")
    assert [r[0] for r in records.systematic_sample(df, 10, 3).orderBy("_ordinal").collect()] == [0, 4, 8]
    assert records.systematic_sample(df, 10, 3, up=False).count() == 4
    assert [r[0] for r in records.months(spark, "202311", "202401").collect()] == ["202311", "202312", "202401"]


def test_incremental_landing(spark, tmp_path):
    from terrace.streaming import landing

    source, target = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    for name, rows in (("a.jsonl", '{"k": 1, "v": "x"}\n'), ("b.jsonl", '{"k": 2}\n\n')):
        (source / name).write_text(rows)
        landing.land(spark, str(source), target, str(tmp_path / "check"), ["k", "v"]).awaitTermination(60)
    assert sorted((r.k, r.v) for r in spark.read.parquet(target).collect()) == [("1", "x"), ("2", None)]
