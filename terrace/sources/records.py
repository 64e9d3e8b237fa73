"""Sources and sinks of the lowest layer: JSON lines, CSV files in old encodings, Parquet."""

from __future__ import annotations

import contextlib
import fnmatch
from collections.abc import Iterator, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrace.functions.json_types import digits, json_text, native_type, spelt, type_bit, types_in
from terrace.operators.hash_tree import partition_digests

ORDINAL = "_ordinal"

#: Headers of the bike sources by generation, column by column.
_BIKE = ("대여소번호", "대여소명", "대여구분코드", "성별", "연령대코드", "이용건수", "운동량", "탄소량")
HEADERS: dict[str, tuple[str, ...]] = {
    "G1": ("대여일자", *_BIKE, "이동거리", "이용시간"),
    "G2": ("대여일자", *_BIKE, "이동거리(M)", "이용시간(분)"),
    "I1": ("대여일자", *_BIKE, "이용거리(M)", "이용시간(본)"),
    "G3": ("대여년월", *_BIKE, "이용거리(M)", "이용시간(분)"),
    "G4": ("자치구", "대여소명", "기준년월", "대여건수", "반납건수"),
}


def with_ordinal(df: DataFrame) -> DataFrame:
    """Adds _ordinal, 0 to n - 1 in the order of the input's files and lines.

    Rows are numbered within their partition, behind the rows of the partitions before it: a small
    table that is joined, so neither the plan nor the driver grows with the input. Write the frame
    before using the numbers in two plans: they follow the layout of this scan.
    """
    marked = df.withColumn("__id", F.monotonically_increasing_id())
    part, place = F.shiftright("__id", 33), F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = marked.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__rows"))
    # One row a partition: the only thing that is ever in one place.
    before = F.sum("__rows").over(Window.orderBy("__part")) - F.col("__rows")
    starts = sizes.select("__part", before.alias("__start"))
    found = marked.withColumns({"__part": part, "__place": place}).join(starts, "__part")
    return found.select(*df.columns, (F.col("__start") + F.col("__place")).alias(ORDINAL))


def lines(spark: SparkSession, path: str, glob: str = "*.jsonl") -> DataFrame:
    """Non-blank lines of all files below a folder, as text."""
    return spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path).filter(F.trim("value") != "")


def scan_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(rows, keys): the number of records and the sorted union of their keys. No record is an error."""
    record = F.parse_json("value")
    keys = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.map_keys(F.try_variant_get(record, "$", "map<string,variant>"))))))
    found = lines(spark, path).agg(F.count(F.lit(1)).alias("rows"), keys.alias("keys"))
    return found.select(F.when(F.col("rows") > 0, F.col("rows")).otherwise(F.raise_error(F.lit("no record in the source"))).alias("rows"), "keys")


def read_jsonl(spark: SparkSession, path: str, keys: Sequence[str] | None = None, ordinal: bool = True) -> DataFrame:
    """Records as one variant column a key, without any coercion: 0, "0" and 0.0 stay apart, and integers
    of any length from floats (see json_types).

    Keys come from the union over all records unless given; a key that a record lacks is null.
    """
    keys = keys or scan_jsonl(spark, path).first()["keys"]
    source = lines(spark, path)
    source = with_ordinal(source) if ordinal else source
    record = source.withColumn("__r", F.parse_json("value"))
    kept = [ORDINAL] if ordinal else []
    return record.select(*kept, *[spelt(_value(k), _literal(k)).alias(k) for k in keys])


def _value(key: str) -> Column:
    """A record's value. Paths have no spelling for a key with both kinds of quotes, or a backslash."""
    if "\\" in key or ("'" in key and '"' in key):
        return F.element_at(F.try_variant_get("__r", "$", "map<string,variant>"), F.lit(key))
    return F.try_variant_get("__r", f'$["{key}"]' if "'" in key else f"$['{key}']", "variant")


def _literal(key: str) -> Column:
    """The text of a record's value."""
    if "'" in key or "\\" in key:
        return F.element_at(F.from_json("value", "map<string,string>"), F.lit(key))
    return F.get_json_object("value", f"$['{key}']")


def field_types(records: DataFrame) -> DataFrame:
    """(field, types, rows, digits, native): the JSON types that each variant column holds, nulls left out,
    the length of its longest integer and the Spark type that holds them all (json: JSON text)."""
    fields = [c for c, t in records.dtypes if t == "variant"]
    told = [F.struct(F.lit(c).alias("field"), F.coalesce(F.bit_or(type_bit(c)), F.lit(0)).alias("mask"), F.count(F.lit(1)).alias("rows"), F.coalesce(F.max(digits(c)), F.lit(0)).cast("bigint").alias("digits")) for c in fields]
    states = records.agg(F.array(*told).alias("all")).select(F.inline("all"))
    return states.select("field", types_in(F.col("mask")).alias("types"), "rows", "digits", native_type(F.col("mask"), F.col("digits")).alias("native"))


_NATIVE = {"int": "bigint", "float": "double", "str": "string", "bool": "boolean"}


def as_declared(records: DataFrame, types: Mapping[str, Sequence[str]], digits: Mapping[str, int] | None = None) -> DataFrame:
    """Variant columns as native ones: one type gives that type, several give JSON text, none text.

    `digits` tells the columns' longest integers, where known: more than 18 give decimal(38,0), more
    than 38 text. An integer that its type cannot hold is an error, never a null.
    """
    out = []
    for c in records.columns:
        seen, long = types.get(c), (digits or {}).get(c, 0)
        if seen is None:
            out.append(F.col(c))
        elif len(seen) == 1:
            kind = _NATIVE.get(seen[0], "string")
            if kind == "bigint" and long > 18:
                kind = "decimal(38,0)" if long <= 38 else "string"
            value = json_text(c) if kind == "string" else F.try_variant_get(c, "$", kind)
            if seen[0] == "int" and kind != "string":
                too_long = F.raise_error(F.concat(F.lit(f"{c}: no {kind}: "), json_text(c))).cast(kind)
                value = F.when(value.isNull() & json_text(c).isNotNull(), too_long).otherwise(value)
            out.append(value.alias(c))
        else:
            out.append((F.to_json(c) if seen else F.lit(None).cast("string")).alias(c))
    return records.select(*out)


#: Rows of a row group, the codec and its level of controlled files.
ROW_GROUP, CODEC, LEVEL = 131_072, "ZSTD", 3


def land(records: DataFrame, path: str, level: int = 3, read_as: Mapping[str, str] | None = None) -> None:
    """Writes a layer as Parquet in zstd, variant columns that read_as names as their text."""
    texts = {c: json_text(c) if dict(records.dtypes)[c] == "variant" else F.col(c).cast("string") for c in read_as or {}}
    records = records.withColumns(texts) if texts else records
    records.write.mode("errorifexists").option("compression", "zstd").option("parquet.compression.codec.zstd.level", str(level)).parquet(path)


def land_controlled(df: DataFrame, path: str, rows: int = ROW_GROUP, most_bytes: int = 1 << 30) -> None:
    """Writes a layer whose size can be compared with another's: zstd of one level, row groups of exactly
    `rows` rows but for the last of a file. Spark's own writer closes a row group at a number of rows;
    its limit by bytes is set out of the way, since rows of most_bytes / rows each are not expected."""
    options = {"compression": CODEC.lower(), "parquet.compression.codec.zstd.level": str(LEVEL), "parquet.block.row.count.limit": str(rows), "parquet.block.size": str(most_bytes)}
    df.write.mode("errorifexists").options(**options).parquet(path)


def _listed(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(name, bytes) of all files below a folder of any file system. Spark's readers pass empty files over."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files, found = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(root, True), []
    while files.hasNext():
        status = files.next()
        found.append((status.getPath().toString(), status.getLen()))
    return sorted(found)


def footers(spark: SparkSession, path: str) -> DataFrame:
    """(file, codecs, row_groups, writer): what the files of a layer say of themselves, on any file
    system. Only footers are read: a few kB a file."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    found = []
    for name, _ in _listed(spark, path):
        if not name.endswith(".parquet"):
            continue
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(name), conf))
        try:
            meta = reader.getFooter()
            blocks = list(meta.getBlocks())
            codecs = sorted({c.getCodec().toString() for b in blocks for c in b.getColumns()})
            found.append((name.rsplit("/", 1)[-1], codecs, [b.getRowCount() for b in blocks], meta.getFileMetaData().getCreatedBy()))
        finally:
            reader.close()
    return spark.createDataFrame(sorted(found), "file string, codecs array<string>, row_groups array<bigint>, writer string")


def control_problems(spark: SparkSession, layers: Mapping[str, str], rows: int = ROW_GROUP, codec: str = CODEC) -> list[str]:
    """Why the files of layers (name -> path) cannot be compared by size; empty if they can."""
    problems, writers = [], set()
    for name, path in layers.items():
        told = footers(spark, path).collect()
        if not told:
            problems.append(f"{name}: no file")
        for f in told:
            writers.add(f["writer"])
            if f["codecs"] not in ([codec], []):
                problems.append(f"{name}/{f['file']}: codec {', '.join(f['codecs'])}")
            if any(n != rows for n in f["row_groups"][:-1]) or any(n > rows for n in f["row_groups"][-1:]):
                problems.append(f"{name}/{f['file']}: row groups of {f['row_groups']} rows")
    if len(writers) > 1:
        problems.append(f"written by {', '.join(sorted(writers))}")
    return problems


def reencode(spark: SparkSession, source: str, target: str, rows: int = ROW_GROUP) -> int:
    """Rewrites a layer as a controlled one and proves that the same rows came out; their number. Either
    side is read once for its digests, and nothing but digests is shuffled."""
    before = spark.read.parquet(source)
    land_controlled(before, target, rows)
    after = spark.read.schema(before.schema).parquet(target)
    was, now = (partition_digests(df).first() for df in (before, after))
    if was != now:
        raise ValueError(f"{target} does not hold the rows of {source}: {now['rows']} rows, {was['rows']} before")
    return now["rows"]


def classify(header: Sequence[str]) -> str:
    """The generation of a header; one that is not known is refused."""
    for name, known in HEADERS.items():
        if tuple(header) == known:
            return name
    raise ValueError(f"unknown header {list(header)}")


#: Fixed value: the code page of files that are not UTF-8, by Java's name.
CODE_PAGE = "x-windows-949"


@contextlib.contextmanager
def code_pages(spark: SparkSession) -> Iterator[None]:
    """Lets expressions made inside name Java's code pages."""
    name = "spark.sql.legacy.javaCharsets"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _raw_lines(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """(value, file, start, id): lines as the bytes that they are, cut at line ends by any number of tasks;
    start is the place in its file of the piece that a line was read with, id grows along a piece."""
    source = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path)
    return source.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"))


def read_csv(spark: SparkSession, path: str, generation: str, glob: str = "*.csv") -> DataFrame:
    """Rows of all CSV files of a generation below a folder, all text, with file, line and _ordinal.

    A file is UTF-8 if all its lines are, else of the Korean code page, which reads almost anything; what it
    cannot read is an error. That takes one pass that settles each file's encoding; then all pieces
    of all files are read side by side, so no file has to fit anywhere. Empty fields stay empty text.

    line counts from 0 behind the header; _ordinal numbers the rows in the order of files and lines.
    Headers of another generation, empty files, rows of another width than the header, and quotes that
    do not close on their line are errors; blank lines are skipped. Fields may be quoted, with quotes
    doubled inside.
    """
    header = HEADERS[generation]
    if empty := [name for name, size in _listed(spark, path) if not size and fnmatch.fnmatch(name.rsplit("/", 1)[-1], glob)]:
        raise ValueError(f"{empty[0]} is empty: it is not of generation {generation}")
    raw = _raw_lines(spark, path, glob)
    # One row a piece: its first id, and whether the whole file is UTF-8.
    whole_file = Window.partitionBy("file")
    pieces = raw.groupBy("file", "start").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"), F.bool_and(F.is_valid_utf8("value")).alias("utf8"))
    earlier = whole_file.orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select("file", "start", "first", F.bool_and("utf8").over(whole_file).alias("utf8"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    with code_pages(spark):
        text = F.when(F.col("utf8"), F.col("value")).otherwise(F.decode(F.col("value").cast("binary"), CODE_PAGE))
        lines = raw.join(pieces, ["file", "start"]).select("file", "start", "id", (F.col("before") + F.col("id") - F.col("first") - 1).alias("line"), text.alias("text"))
    fields = lines.select("file", "start", "id", "line", "text", _fields(F.regexp_replace("text", "^\uFEFF", "")).alias("fields"))
    where = F.concat(F.col("file"), F.lit(", line "), F.col("line").cast("string"))
    stop = lambda *why: F.raise_error(F.concat(where, F.lit(": "), *why)).cast("boolean")
    kept = (
        F.when(F.col("line") < 0, F.when(F.col("fields").eqNullSafe(F.array(*map(F.lit, header))), False).otherwise(stop(F.lit(f"not of generation {generation}"))))
        .when(F.col("text") == "", False)
        .when(F.col("fields").isNull(), stop(F.lit("quotes do not close")))
        .when(F.size("fields") != len(header), stop(F.size("fields").cast("string"), F.lit(f" fields, not {len(header)}")))
        .otherwise(True)
    )
    rows = fields.filter(kept).select("file", "start", "id", "line", *[F.get("fields", F.lit(i)).alias(c) for i, c in enumerate(header)])
    # Rows are numbered within their piece, behind those of the pieces before it: one row a piece is in one place.
    counted = rows.groupBy("file", "start").agg(F.count(F.lit(1)).alias("n"))
    starts = counted.select("file", "start", (F.sum("n").over(Window.orderBy("file", "start")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("file", "start").orderBy("id")) - 1
    return rows.withColumn("place", place).join(starts, ["file", "start"]).select("file", "line", (F.col("before") + F.col("place")).alias(ORDINAL), *header)


def _fields(line: Column) -> Column:
    """The fields of a CSV line; null where its quotes do not close."""
    field = '"(?:[^"]|"")*+"|[^",][^,]*+|'
    found = F.regexp_extract_all(F.concat(line, F.lit(",")), F.lit(f"({field}),"), F.lit(1))
    bare = F.transform(found, lambda f: F.when(f.startswith('"'), F.replace(F.substring(f, F.lit(2), F.length(f) - 2), F.lit('""'), F.lit('"'))).otherwise(f))
    return F.when(~F.contains(line, F.lit('"')), F.split(line, ",", -1)).when(line.rlike(f"^(?:(?:{field}),)*+(?:{field})$"), bare)


def land_jsonl(df: DataFrame, path: str, ordinal: str = ORDINAL) -> None:
    """Writes a frame as JSON lines in the order of its ordinal, which is not written: files by name hold
    ascending rows. Nulls are written as null, so that every record has every key."""
    ordered = df.repartitionByRange(ordinal).sortWithinPartitions(ordinal)
    record = F.to_json(F.struct(*[F.col(c) for c in df.columns if c != ordinal]), {"ignoreNullFields": "false"})
    ordered.select(record.alias("value")).write.mode("errorifexists").text(path)


def systematic_sample(df: DataFrame, total: int, most: int, up: bool = True) -> DataFrame:
    """Every k-th row by _ordinal from the first: k is total / most, rounded up (or down, at least 1)."""
    step = -(-total // most) if up else max(1, total // most)
    return df.filter(F.col(ORDINAL) % max(1, step) == 0)


def last_wins(df: DataFrame, key: Sequence[str], order: str = ORDINAL) -> DataFrame:
    """One row a key, the last by `order`; other columns come with it. A partial aggregation keeps
    the traffic to a row for each key and task."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("__last")).select(*key, "__last.*").select(*df.columns)


def months(spark: SparkSession, start: str, end: str) -> DataFrame:
    """(month): YYYYMM from start to end, both included."""
    first, last = (F.to_date(F.lit(x + "01"), "yyyyMMdd") for x in (start, end))
    return spark.range(1).select(F.explode(F.sequence(first, last, F.expr("interval 1 month"))).alias("d")).select(F.date_format("d", "yyyyMM").alias("month"))


def merged(spark: SparkSession, paths: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Monthly tables one behind the other, and the paths that were missing."""
    parts, missing = [], []
    for p in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            parts.append(spark.read.parquet(p))
        else:
            missing.append(p)
    if not parts:
        raise FileNotFoundError(f"none of {len(paths)} monthly tables is there")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out, missing
