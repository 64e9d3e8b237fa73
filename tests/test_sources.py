"""Controlled files and CSV in old code pages, against plain readers."""

import csv
import io
import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from terrace.sources import records

HEADER = records.HEADERS["G4"]


# ---- controlled files --------------------------------------------------------------------------


def test_row_groups_are_of_exact_size(spark, tmp_path):
    df = spark.range(10_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("s"))
    records.land_controlled(df.coalesce(2), str(tmp_path / "a"), rows=1500)
    for file in (tmp_path / "a").glob("*.parquet"):
        meta = pq.ParquetFile(file).metadata
        assert [meta.row_group(g).num_rows for g in range(meta.num_row_groups)] == [1500, 1500, 1500, 500]
        assert {meta.row_group(0).column(c).compression for c in range(2)} == {"ZSTD"}
    told = records.footers(spark, str(tmp_path / "a")).collect()
    assert [r.row_groups for r in told] == [[1500, 1500, 1500, 500]] * 2 and {tuple(r.codecs) for r in told} == {("ZSTD",)}
    assert "MapIn" not in df._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(Exception, match="exists"):
        records.land_controlled(df, str(tmp_path / "a"))


def test_what_cannot_be_compared_is_told(spark, tmp_path):
    df = spark.range(5000).coalesce(1)
    records.land_controlled(df, str(tmp_path / "good"), rows=2000)
    df.write.option("compression", "snappy").parquet(str(tmp_path / "bad"))
    (tmp_path / "none").mkdir()
    assert records.control_problems(spark, {"good": str(tmp_path / "good")}, rows=2000) == []
    found = records.control_problems(spark, {n: str(tmp_path / n) for n in ("good", "bad", "none")}, rows=2000)
    assert len(found) == 3 and "codec SNAPPY" in found[0] and "row groups" in found[1] and found[2] == "none: no file"


def test_reencoding_keeps_the_rows(spark, tmp_path, monkeypatch):
    rows = [(i % 7, None if i % 5 == 0 else i / 3, f"t{i % 3}", [i]) for i in range(3000)] * 2
    spark.createDataFrame(rows, "k int, v double, t string, a array<int>").repartition(5).write.parquet(str(tmp_path / "a"))
    assert records.reencode(spark, str(tmp_path / "a"), str(tmp_path / "b"), rows=1000) == 6000
    assert records.control_problems(spark, {"b": str(tmp_path / "b")}, rows=1000) == []
    land = records.land_controlled
    monkeypatch.setattr(records, "land_controlled", lambda df, path, rows: land(df.filter("k <> 3 or v is not null"), path, rows))
    with pytest.raises(ValueError, match="does not hold the rows"):
        records.reencode(spark, str(tmp_path / "a"), str(tmp_path / "c"))


# ---- CSV ---------------------------------------------------------------------------------------


def write(path, rows, encoding, end="\n", header=HEADER):
    out = io.StringIO()
    csv.writer(out, lineterminator=end).writerows([header, *rows])
    path.write_bytes(out.getvalue().encode(encoding))


def expected(folder, encodings):
    out = []
    for name in sorted(encodings):
        text = (folder / name).read_bytes().decode(encodings[name])
        out += [(name, i, *r) for i, r in enumerate(list(csv.reader(io.StringIO(text, newline="")))[1:]) if r]
    return [(*r[:2], n, *r[2:]) for n, r in enumerate(out)]


def read(spark, folder):
    got = records.read_csv(spark, str(folder), "G4")
    assert got.columns == ["file", "line", "_ordinal", *HEADER]
    return sorted(((r[0].rsplit("/", 1)[1], *r[1:]) for r in got.collect()), key=lambda r: r[2])


@pytest.mark.parametrize("piece", [None, 700])
def test_files_of_both_encodings_in_pieces(spark, tmp_path, piece):
    draw = random.Random(1)
    some = lambda n: [[draw.choice(["강남구", "서초구", ""]), draw.choice(['역 "1번"', "a,b", "x", "쿽뷁"]), "2020-01", draw.choice(["1", "\\N", ""]), str(i)] for i in range(n)]
    encodings = {"a.csv": "cp949", "b.csv": "utf-8-sig", "c.csv": "utf-8", "d.csv": "cp949", "e.csv": "utf-8"}
    for i, (name, encoding) in enumerate(encodings.items()):
        rows = some(60) if name != "e.csv" else [["a", "b", "c", "", "1"]]
        write(tmp_path / name, rows, encoding, end="\r\n" if i % 2 else "\n")
    with (tmp_path / "d.csv").open("ab") as f:
        f.write("\n\n끝,역,2020-02,,5\n\n".encode("cp949"))
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        if piece:
            for k in kept:
                spark.conf.set(k, str(piece))
            raw = records._raw_lines(spark, str(tmp_path), "*.csv")
            assert raw.select("file", "start").distinct().count() > 2 * len(encodings)
        assert read(spark, tmp_path) == expected(tmp_path, encodings)
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize(
    ("data", "why"),
    [
        (b"a,b\n1,2\n", "not of generation|2 fields, not 5"),
        (b"", "is empty"),
        (",".join(HEADER).encode() + b"\n1,2,3,4\n", "4 fields, not 5"),
        (",".join(HEADER).encode() + b"\n1,2,3,4,5,6\n", "6 fields, not 5"),
        (",".join(HEADER).encode() + b'\n1,"2\n3",4,5,6\n', "quotes do not close|4 fields, not 5"),
        (",".join(HEADER).encode("cp949") + b"\n1,2,3,\xff\xff,5\n", "MALFORMED"),
        (",".join(HEADER[::-1]).encode(), "not of generation"),
    ],
)
def test_what_is_refused(spark, tmp_path, data, why):
    write(tmp_path / "good.csv", [["a", "b", "c", "d", "e"]], "utf-8")
    (tmp_path / "bad.csv").write_bytes(data)
    with pytest.raises(Exception, match=why):
        records.read_csv(spark, str(tmp_path), "G4").collect()


def test_json_lines_in_order(spark, tmp_path):
    write(tmp_path / "a.csv", [[f"구{i}", "", "2020-01", "\\N", str(i)] for i in range(300)], "cp949")
    records.land_jsonl(records.read_csv(spark, str(tmp_path), "G4").drop("file", "line"), str(tmp_path / "out"))
    lines = [line for f in sorted((tmp_path / "out").glob("part-*")) for line in f.read_text().splitlines()]
    assert lines == ['{"자치구":"구%d","대여소명":"","기준년월":"2020-01","대여건수":"\\\\N","반납건수":"%d"}' % (i, i) for i in range(300)]


def test_headers(spark):
    assert records.classify(records.HEADERS["G1"]) == "G1"
    with pytest.raises(ValueError):
        records.classify(("a",))
