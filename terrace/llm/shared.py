"""What the training-data operators share: scratch tables, row keys and small native expressions."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import io
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_scratch: dict[str, str] = {}
_shipped: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Sends this subpackage to the executors' Python workers, once an application, so that the
    functions passed to mapInArrow need no installation there."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for f in sorted(root.glob("*.py")):
            z.writestr(f"terrace/llm/{f.name}", f.read_bytes())
        z.writestr("terrace/__init__.py", (root.parent / "__init__.py").read_bytes())
    path = Path(tempfile.mkdtemp(prefix="terrace-code-")) / "terrace_llm.zip"
    path.write_bytes(packed.getvalue())
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)


def give_back() -> None:
    """Hands a Python worker's free memory back to the system: Spark keeps the worker for whatever
    stage comes next, and beside it the executor's other workers and its JVM need room."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def scratch_dir(spark: SparkSession) -> str:
    """A folder of this application in the shared folder that spark.checkpoint.dir names.

    Only where the session names none and the executors are threads of the driver (tests on one
    machine) a local folder is made and set; a cluster without the setting is an error. The folder
    goes when the driver ends.
    """
    app = spark.sparkContext.applicationId
    if app not in _scratch:
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not re.fullmatch(r"local(\[.*)?", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="terrace-")
            spark.sparkContext.setCheckpointDir(base)
        _scratch[app] = f"{base.rstrip('/')}/terrace-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, _scratch[app])
    return _scratch[app]


def _remove(spark: SparkSession, folder: str) -> None:
    if spark.sparkContext._jsc is None:
        return
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame written as a Parquet table in the shared folder and read again: it cuts the
    lineage, and a lost executor costs no recomputation of what lies before it."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(c, UPPER, LOWER)


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds


#: What a stored table may have in bytes of files to be broadcast: some ten times that in memory.
BROADCAST_BYTES = 8 << 20


def small_enough(table: DataFrame) -> bool:
    """Whether a stored table may be broadcast: its files' measured size decides."""
    return input_bytes(table) <= BROADCAST_BYTES


def joined(large: DataFrame, table: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """A join with a stored table, which is broadcast where its size allows and shuffled else."""
    return large.join(F.broadcast(table) if small_enough(table) else table, on, how)


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of a Spark schema written as text."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def input_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of a frame's size in bytes: for a stored table, its files' size."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
