"""JSON types against Python's own reading of the same literals."""

import json
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from terrace.functions import json_types as jt
from terrace.operators import pairing
from terrace.operators.contract import Contract, ContractError, compile_contract
from terrace.sources import records

LITERALS = [
    "1", "1.0", "1.00", "0.0", "1e0", "1E5", "-0", "-0.0", "0", "0.1", "1.10", "-7", "12345678901234567.0", "9223372036854775807", "-9223372036854775808", "9223372036854775808", "-9223372036854775809",
    "9223372036854775808.0", "100000000000000000000", "123456789012345678901234567890", "123456789012345678901234567890.0", "-" + "9" * 38, "9" * 39, "1" * 60, "1" * 60 + ".5", "1.5e300", "1e400", '"1"', '"1.0"', '""',
    '"' + "9" * 40 + '"', "null", "true", "false", "[1, 2.0]", "[]", '{"a": 1.0}', "{}",
]
NAMES = {int: "int", float: "float", str: "str", bool: "bool", list: "array", dict: "object", type(None): None}


def kind(literal):
    return NAMES[type(json.loads(literal))]


def written(folder, rows, name="a.jsonl"):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join("{" + ", ".join(f'"{k}": {v}' for k, v in r.items()) + "}" for r in rows) + "\n\n")
    return str(folder)


def test_every_literal_keeps_its_type_and_integers_their_digits(spark, tmp_path):
    path = written(tmp_path / "in", [{"x": v, "o'clock": v, r"""both'\"quotes""": v, "a.b": v} for v in LITERALS])
    df = records.read_jsonl(spark, path)
    for column in ("x", "o'clock", """both'"quotes""", "a.b"):
        c = F.col(f"`{column}`")
        rows = df.orderBy("_ordinal").select(jt.json_kind(c).alias("k"), jt.json_text(c).alias("t"), jt.digits(c).alias("d")).collect()
        assert [r.k for r in rows] == [kind(v) for v in LITERALS]
        for v, r in zip(LITERALS, rows, strict=True):
            if kind(v) == "int":
                assert (r.t, r.d) == (str(json.loads(v)), len(str(abs(json.loads(v)))))
            elif kind(v) == "float":
                assert float(r.t) == json.loads(v) and r.d == 0
                assert not r.t.lstrip("-").isdigit()
            elif kind(v) == "str":
                assert r.t == json.loads(v)


def test_states_in_one_pass_and_merged(spark, tmp_path):
    draw = random.Random(1)
    fields = {"mixed": LITERALS, "ints": ["1", "-20", "null"], "halves": ["1", "1.0"], "wide": ["1", "9" * 30], "wider": ["9" * 40, "null"], "floats": ["1.0", "2e0", "null"], "none": ["null"], "text": ['"1"', "null"], "flag": ["true"]}
    days = [[{f: draw.choice(v) for f, v in fields.items() if draw.random() < 0.9} for _ in range(60)] for _ in range(3)]
    states = [jt.type_states(records.lines(spark, written(tmp_path / f"day{i}", day))) for i, day in enumerate(days)]
    whole = jt.type_states(records.lines(spark, written(tmp_path / "all", [r for day in days for r in day])))
    key = lambda df: {r.field: (r.mask, r.digits, r.present) for r in df.collect()}
    found = key(whole)
    assert key(jt.merged(*states)) == found
    told = {r.field: r for r in whole.withColumns({"types": jt.types_in(F.col("mask")), "native": jt.native_type(F.col("mask"), F.col("digits"))}).collect()}
    for f in fields:
        seen = [json.loads(r[f]) for day in days for r in day if f in r and r[f] != "null"]
        assert told[f].types == sorted({NAMES[type(v)] for v in seen}) and told[f].present == len(seen)
        assert told[f].digits == max((len(str(abs(v))) for v in seen if type(v) is int), default=0)
    natives = {f: r.native for f, r in told.items()}
    assert natives == {"mixed": "json", "ints": "bigint", "halves": "json", "wide": "decimal(38,0)", "wider": "string", "floats": "double", "none": "string", "text": "string", "flag": "boolean"}
    wide = records.field_types(records.read_jsonl(spark, str(tmp_path / "all"))).collect()
    assert {r.field: (r.types, r.native) for r in wide} == {f: (r.types, r.native) for f, r in told.items()}


def test_long_integers_are_declared_whole_or_refused(spark, tmp_path):
    df = records.read_jsonl(spark, written(tmp_path / "in", [{"n": "9" * 30}, {"n": "1"}, {"n": "null"}]))
    assert [r.n for r in records.as_declared(df, {"n": ["int"]}, {"n": 30}).orderBy("_ordinal").collect()] == [Decimal("9" * 30), 1, None]
    assert [r.n for r in records.as_declared(df, {"n": ["int"]}, {"n": 40}).orderBy("_ordinal").collect()] == ["9" * 30, "1", None]
    with pytest.raises(Exception, match="no bigint"):
        records.as_declared(df, {"n": ["int"]}).collect()


def test_a_column_of_1_and_1_0_is_refused(spark, tmp_path):
    for i, (rows, mixed) in enumerate([(["1", "1.0"], True), (["1", "2"], False), (["1.0", "1e0", "0.0"], False), (["1", "9" * 40, "9" * 30], False), (["9" * 30, "9" * 30 + ".0"], True), (["1", "null"], False)]):
        df = records.read_jsonl(spark, written(tmp_path / f"in{i}", [{"n": v} for v in rows]), ordinal=False)
        compiled = compile_contract(Contract.of({}), df)
        assert (compiled.counts().first()[0] > 0) == mixed
        if mixed:
            with pytest.raises(ContractError, match="heterogeneous"):
                compiled.checked()
    assert [r.n for r in compile_contract(Contract.of({"read_as": {"n": "str"}}), records.read_jsonl(spark, str(tmp_path / "in0"))).checked().orderBy("_ordinal").collect()] == ["1", "1.0"]


def test_tokens_of_stored_and_read_values_meet(spark, tmp_path):
    df = records.read_jsonl(spark, written(tmp_path / "in", [{"n": "1.0"}, {"n": "2.5"}, {"n": "3e0"}]))
    native = records.as_declared(df, {"n": ["float"]})
    tokens = [[tuple(r[0]) for r in x.orderBy("_ordinal").select(pairing.token(x, "n")).collect()] for x in (df, native)]
    assert tokens[0] == tokens[1] == [("float", "1.0"), ("float", "2.5"), ("float", "3.0")]


def test_empty_source_and_blank_lines(spark):
    assert jt.type_states(spark.createDataFrame([("",), ("  ",), (None,)], "value string")).collect() == []
