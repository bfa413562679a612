"""Row-wise operators on streams: features, scores and labels need no state, so the batch operators serve as they are."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def apply(spark: SparkSession, path: str, schema: str, operators: list[Callable[[DataFrame], DataFrame]], format: str = "parquet") -> DataFrame:
    """The stream of a folder's files through operators without state."""
    df = spark.readStream.schema(schema).format(format).load(path)
    for f in operators:
        df = f(df)
    if not df.isStreaming:
        raise ValueError("an operator ended the stream")
    return df
