"""Sliding windows of fixed length."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import require_columns


def sliding_windows(df: DataFrame, features: list[str], entity: str, timestamp: str, size: int = 60, stride: int = 1) -> DataFrame:
    """(entity, timestamp of the last row, window as array<array<float>>), complete windows that start at rows 0, stride,
    2 * stride ... of each entity. Too few rows give an empty table of the same type."""
    if size < 1 or stride < 1:
        raise ValueError("size and stride must be positive")
    require_columns(df, [*features, entity, timestamp])
    by = Window.partitionBy(entity).orderBy(timestamp)
    row = F.array(*(F.col(c).cast("float") for c in features))
    rows = df.select(entity, timestamp, F.row_number().over(by).alias("n"), F.collect_list(row).over(by.rowsBetween(1 - size, 0)).alias("window"))
    return rows.where((F.col("n") >= size) & ((F.col("n") - size) % stride == 0)).select(entity, timestamp, "window")
