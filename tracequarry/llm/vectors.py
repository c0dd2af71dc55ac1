"""Vectors as Spark rows: validity, grouping of equal ones, Arrow conversion."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import need


def valid_vectors(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id (long) and vector (array of double) of rows with an id and a vector of finite numbers."""
    need(table, id_col, vector_col)
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    good = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return rows.where(F.col("id").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0) & good)


def smallest_ids(rows: DataFrame, key: str, many: int) -> DataFrame:
    """Each distinct key with its ``many`` smallest ids in order; a hot key is limited before it is shuffled."""
    ranked = rows.withColumn("place", F.row_number().over(W.partitionBy(key).orderBy("id"))).where(F.col("place") <= many)
    return ranked.groupBy(key).agg(F.sort_array(F.collect_list("id")).alias("ids"))


def matrix(column: pa.Array | pa.ChunkedArray, dtype=np.float64) -> np.ndarray:
    """Rows of a list column of equal lengths."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    return np.asarray(column.flatten(), dtype).reshape(len(column), -1)


def bytes_matrix(column: pa.Array | pa.ChunkedArray, dtype) -> np.ndarray:
    """Rows of a binary column of equal lengths."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), -1)
