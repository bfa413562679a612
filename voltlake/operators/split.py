"""Chronological split on distinct timestamps."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import require_columns, seconds

NAMES = ("train", "validation", "test")


@dataclass(frozen=True)
class SplitConfig:
    train: float = 0.6
    validation: float = 0.2
    test: float = 0.2
    least: int = 3

    def __post_init__(self):
        if min(self.train, self.validation, self.test) <= 0 or not math.isclose(self.train + self.validation + self.test, 1.0, abs_tol=1e-9):
            raise ValueError("shares must be positive and sum to 1")


def nth_timestamps(df: DataFrame, timestamp: str, places: list[int], bucket_seconds: int = 3600) -> list:
    """The distinct timestamps at these places (from 0) of their order: counts by bucket, then the bucket's own order.
    No window over all rows."""
    distinct = df.select(F.col(timestamp).alias("t")).where("t is not null").distinct()
    bucket = F.floor(seconds(F.col("t")) / bucket_seconds)
    counted = sorted(tuple(r) for r in distinct.groupBy(bucket.alias("b")).count().collect())
    out = []
    for k in places:
        for b, n in counted:
            if k < n:
                out.append(distinct.where(bucket == b).orderBy("t").limit(k + 1).agg(F.max("t")).first()[0])
                break
            k -= n
    return out


def temporal_split(df: DataFrame, timestamp: str, config: SplitConfig = SplitConfig(), guard: bool = True) -> DataFrame:
    """df with `split`: train, validation or test. The cuts are timestamps, so a filter on split is one on the scan."""
    require_columns(df, [timestamp])
    n = df.select(timestamp).where(F.col(timestamp).isNotNull()).distinct().count()
    if guard and n < config.least:
        raise ValueError(f"{n} timestamps are too few to split")
    first = math.floor(n * config.train)
    train = max(1, first)
    validation = min(max(train + 1, first + math.floor(n * config.validation)), n - 1)
    t = F.col(timestamp)
    cuts = nth_timestamps(df, timestamp, [train, validation]) if n >= 3 else [None, None]
    return df.withColumn("split", F.when(t < F.lit(cuts[0]), NAMES[0]).when(t < F.lit(cuts[1]), NAMES[1]).when(t.isNotNull(), NAMES[2]))


def summarize(split: DataFrame, timestamp: str) -> DataFrame:
    return split.groupBy("split").agg(F.count("*").alias("rows"), F.min(timestamp).alias("first"), F.max(timestamp).alias("last"), F.countDistinct(timestamp).alias("timestamps"))


def leakage(split: DataFrame, timestamp: str) -> DataFrame:
    """Timestamps found in more than one split: none, if it is sound."""
    return split.groupBy(timestamp).agg(F.countDistinct("split").alias("splits")).where("splits > 1")
