"""Layers that are rebuilt partition by partition, where their source has moved.

Beside a layer's rows lies a small table with the digest that each source partition had when the layer's
was built. A refresh takes the digests anew in one aggregation over the source, and rebuilds only
partitions whose digest, or whose recipe, is another; the others keep their files. Digests are written
last, so a refresh that is cut off is simply done again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.operators.hash_tree import partition_digests
from terrace.sources.scratch import stored


def _same(a: DataFrame, b: DataFrame, partition: Sequence[str]) -> Column:
    same = F.lit(True)
    for c in partition:
        same = same & a[c].eqNullSafe(b[c])
    return same


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def _move(spark: SparkSession, source: str, target: str) -> None:
    of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = of(target).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(of(target), True)
    if not fs.rename(of(source), of(target)):
        raise OSError(f"{source} cannot be moved to {target}")


def _files(spark: SparkSession, layer: str, partition: Sequence[str]) -> DataFrame:
    """(partition, path): a layer's files, as they are listed; none is opened."""
    kinds = ["path string", "modificationTime timestamp", "length bigint", "content binary", *[f"`{c}` string" for c in partition]]
    return spark.read.schema(", ".join(kinds)).option("pathGlobFilter", "*.parquet").format("binaryFile").load(layer).select(*partition, "path")


@dataclass
class Refreshed:
    """rows: the layer as it is now; rebuilt: (partition, change) for each partition that was built (`new`,
    `moved`) or taken out (`gone`)."""

    rows: DataFrame
    rebuilt: DataFrame


def refresh(source: DataFrame, path: str, partition: Sequence[str], build: Callable[[DataFrame], DataFrame], recipe: str = "") -> Refreshed:
    """Brings the layer at `path` up to date with its source.

    build makes rows of the layer out of source rows, one partition's out of that partition's alone,
    and keeps the partition's columns, which must be text. recipe names how; another one rebuilds
    all. A partition of which no row comes out has no files. Nulls are a partition like others.
    """
    spark = source.sparkSession
    new = stored(partition_digests(source, partition, recipe), "digests")
    told = f"{path.rstrip('/')}/digests"
    old = spark.read.schema(new.schema).parquet(told) if _exists(spark, told) else new.limit(0)
    a, b = new.alias("a"), old.alias("b")
    same = F.lit(True)
    for c in partition:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    both = a.join(b, same, "full_outer").filter(~F.col("a.digest").eqNullSafe(F.col("b.digest")))
    change = F.when(F.col("b.digest").isNull(), "new").when(F.col("a.digest").isNull(), "gone").otherwise("moved")
    key = [F.when(F.col("a.digest").isNotNull(), F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")).alias(c) for c in partition]
    changed = stored(both.select(*key, change.alias("change")), "changed")

    wanted = changed.filter("change <> 'gone'")
    built = build(source.join(wanted, _same(source, wanted, partition), "left_semi"))
    layer = f"{path.rstrip('/')}/rows"
    before = stored(_files(spark, layer, partition), "files") if _exists(spark, layer) else None
    if not wanted.isEmpty():
        built.write.mode("overwrite").option("compression", "zstd").option("partitionOverwriteMode", "dynamic").partitionBy(*partition).parquet(layer)
    if before is not None:
        # A dynamic overwrite leaves partitions alone of which no row came out: what changed and still has a
        # file of before goes. That takes the names of files, not the rows once more.
        left = _files(spark, layer, partition).join(before.select("path"), "path", "left_semi")
        stale = left.join(changed, _same(left, changed, partition), "left_semi").select(F.regexp_replace("path", "/[^/]*$", "").alias("folder"))
        for r in stale.distinct().collect():  # one name a partition that has gone
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(r["folder"])
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    written = [*[f for f in built.schema.fields if f.name not in partition], *[f for f in built.schema.fields if f.name in partition]]
    schema = built.schema.__class__(written)
    here = spark.read.schema(schema).parquet(layer) if _exists(spark, layer) else spark.createDataFrame([], schema)
    beside = f"{told}.{uuid.uuid4().hex}"
    new.write.parquet(beside)
    _move(spark, beside, told)
    return Refreshed(here.select(*built.columns), changed)
