"""Where the layers of a dataset are stored."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from terrace.sources import records


class LayerStore:
    """(dataset, layer) -> path of an artifact: JSON lines (a name with .jsonl) or Parquet.

    An unregistered layer and one that is registered but not built are different errors."""

    def __init__(self, spark: SparkSession, paths: Mapping[tuple[str, str], str]) -> None:
        self.spark, self.paths = spark, dict(paths)

    def path(self, dataset: str, layer: str) -> str:
        try:
            return self.paths[dataset, layer]
        except KeyError:
            raise LookupError(f"{dataset} has no layer {layer} in this catalog") from None

    def load(self, dataset: str, layer: str) -> DataFrame:
        path = self.path(dataset, layer)
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if not at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            raise FileNotFoundError(f"{dataset}/{layer} is registered but not built: {path}")
        return read_artifact(self.spark, path)


def read_artifact(spark: SparkSession, path: str) -> DataFrame:
    return records.read_jsonl(spark, path) if path.endswith(".jsonl") else spark.read.parquet(path)
