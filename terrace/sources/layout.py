"""Layers whose layout is part of what they promise: totally ordered files, positions without a second
scan, and buckets by ordinal that pair without a shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrace.operators.reports import CONDITIONS
from terrace.sources.records import HEADERS, ORDINAL, footers

#: The order of conditions along the layers, and of the bike sources' generations.
ORDERS: dict[str, tuple[str, ...]] = {"condition": tuple(CONDITIONS), "generation": tuple(HEADERS)}


def in_order(column: str, order: Sequence[str]) -> list[Column]:
    """Sort keys that put a column's values into a given order; others come behind, by value, null last."""
    known = F.array(*map(F.lit, order))
    place = F.array_position(known, F.col(column))
    return [F.when(place > 0, place).otherwise(len(order) + 1), F.when(F.coalesce(place, F.lit(0)) == 0, F.col(column)).asc_nulls_last()]


def _keys(keys: Sequence[str], orders: dict[str, Sequence[str]] | None) -> list[Column]:
    out = []
    for k in keys:
        out += in_order(k, orders[k]) if orders and k in orders else [F.col(k).asc_nulls_last()]
    return out


def land_sorted(df: DataFrame, path: str, keys: Sequence[str], orders: dict[str, Sequence[str]] | None = None) -> None:
    """Writes a layer in one total order: rows of a file ascend, and files ascend by name. Ranges of keys
    are found by a sample, so no task sorts more than its range; `orders` gives columns an order of their own."""
    by = _keys(keys, orders)
    df.repartitionByRange(*by).sortWithinPartitions(*by).write.mode("errorifexists").option("compression", "zstd").parquet(path)


def positioned(spark: SparkSession, path: str, name: str = ORDINAL) -> DataFrame:
    """A layer with the position of each row, 0 to n - 1 in the order of its files and of their rows.

    The files' footers tell how many rows lie before each file, and the reader tells a row's place
    in its file, so the layer itself is read once, by whoever uses the rows.
    """
    rows = footers(spark, path).select("file", F.aggregate("row_groups", F.lit(0).cast("bigint"), lambda a, n: a + n).alias("n"))
    # One row a file.
    before = rows.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("__before"))
    layer = spark.read.parquet(path)
    marked = layer.select(*layer.columns, F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("__index"))
    return marked.join(F.broadcast(before), "file").select((F.col("__before") + F.col("__index")).alias(name), *layer.columns)


def order_breaks(spark: SparkSession, path: str, keys: Sequence[str], orders: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """(file, within, overlaps): files whose rows do not ascend, by the number of steps down, or whose
    first row lies before the last one of the file before them. Empty for a layer in total order."""
    layer = spark.read.parquet(path)
    parts = []
    for k in keys:
        if orders and k in orders:
            place = F.array_position(F.array(*map(F.lit, orders[k])), F.col(k))
            parts += [F.when(place > 0, place).otherwise(len(orders[k]) + 1), F.when(F.coalesce(place, F.lit(0)) == 0, F.col(k))]
        else:
            parts.append(F.col(k))
    # As a struct nulls come first; a flag before each part puts them last.
    key = F.struct(*[c for i, p in enumerate(parts) for c in (p.isNull().alias(f"n{i}"), p.alias(f"k{i}"))])
    marked = layer.select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("at"), key.alias("key"))
    steps = marked.withColumn("before", F.lag("key").over(Window.partitionBy("file").orderBy("at")))
    files = steps.groupBy("file").agg(F.count_if(F.col("key") < F.col("before")).alias("within"), F.min_by("key", "at").alias("first"), F.max_by("key", "at").alias("last"))
    # One row a file.
    told = files.withColumn("overlaps", F.coalesce(F.col("first") < F.lag("last").over(Window.orderBy("file")), F.lit(False)))
    return told.filter((F.col("within") > 0) | F.col("overlaps")).select("file", "within", "overlaps")


#: Rows, about, of a bucket: one task sorts those of its bucket on both sides of a join.
BUCKET_ROWS = 1 << 17


def buckets_for(df: DataFrame, least: int = 8, rows: int = BUCKET_ROWS) -> int:
    """How many buckets a layer of these rows takes, so that a bucket, and with it a task, does not grow
    with the layer: by a count. Layers that are to pair take the number of the larger one."""
    most = int(df.sparkSession.conf.get("spark.sql.sources.bucketing.maxBuckets"))
    return min(max(least, -(-df.count() // rows)), most)


def land_bucketed(df: DataFrame, name: str, path: str, buckets: int, ordinal: str = ORDINAL) -> DataFrame:
    """Writes a layer as a table in buckets by ordinal, and gives it back. Two layers of as many buckets
    join by their ordinals where they lie: neither is shuffled again. See buckets_for for their number."""
    spread = df.repartition(buckets, ordinal)
    spread.write.mode("errorifexists").option("path", path).option("compression", "zstd").bucketBy(buckets, ordinal).sortBy(ordinal).saveAsTable(name)
    return df.sparkSession.table(name)
