"""Intermediate tables in the folder that spark.checkpoint.dir names."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_folders: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """A folder of this application that all executors share; it goes when the driver ends.

    Only where the session names none and the executors are threads of the driver (tests on one
    machine) a local one is made; a cluster without the setting is an error.
    """
    app = spark.sparkContext.applicationId
    if app not in _folders:
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not re.fullmatch(r"local(\[.*)?", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="layers-")
        _folders[app] = f"{base.rstrip('/')}/layers-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, _folders[app])
    return _folders[app]


def _remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None:
        return
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def place(spark: SparkSession, name: str) -> str:
    """A path of its own for a table or layer."""
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame written as Parquet and read again: it cuts the lineage, and a lost executor costs no
    recomputation of what lies before it."""
    path = place(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
