"""Vectors as whole numbers, shared by the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LIMIT = 1 << 62  # entries beyond it count as it


def scaled(vector: str, scale: int) -> Column:
    """floor(scale * entry) of each entry as long; NULL where the vector or an entry is NULL or an entry is not finite."""
    v = F.transform(F.col(vector), lambda c: c.cast("double"))
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = F.transform(v, lambda c: F.least(F.greatest(F.floor(c * scale), F.lit(-LIMIT)), F.lit(LIMIT)))
    return F.when(fine & (F.size(v) > 0), whole)


def usable(df: DataFrame, id_col: str, vector: str, scale: int) -> tuple[DataFrame, int]:
    """Columns ``id`` and ``x`` (longs) of the rows whose vector counts, and the vectors' length.

    NULL and empty vectors, and those with a NULL, NaN or infinite entry, are left out; so are those of another length than
    the commonest one (of equally common ones the largest). The length is 0 where no row is left.
    """
    rows = df.select(F.col(id_col).alias("id"), scaled(vector, scale).alias("x")).where("x is not null")
    common = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    size = common["d"] if common else 0
    return rows.where(F.size("x") == size), size


def matrix(column: pa.Array, size: int) -> np.ndarray:
    """The lists of an Arrow column as rows of 64-bit whole numbers."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), size)


def id_type(df: DataFrame) -> T.DataType:
    return df.schema["id"].dataType
