"""What the operators over embeddings share: which vectors count, and their values as numpy arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def whole(vector: Column) -> Column:
    """Whether a vector is there and every component of it is there and finite."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad, F.lit(False))


def padded(df: DataFrame, vector: str = "vector") -> tuple[DataFrame, int]:
    """The frame with every vector filled up with zeros to the longest one's length, and that length."""
    sizes = df.agg(F.min(F.size(vector)), F.max(F.size(vector))).first()
    least, most = (sizes[0] or 0), (sizes[1] or 0)
    if least == most:
        return df, most
    zeros = F.array_repeat(F.lit(0.0).cast(df.schema[vector].dataType.elementType), F.lit(most) - F.size(vector))
    return df.withColumn(vector, F.concat(vector, zeros)), most


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """A list column of equally long vectors without nulls as doubles, a row each."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dims)
