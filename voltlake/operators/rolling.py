"""Rolling and global statistics of signals."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import kurtosis_sample, numeric, require_columns, skew_sample
from .ordered import over_order
from .quantiles import exact_quantiles


@dataclass(frozen=True)
class RollingConfig:
    window: int = 4
    min_periods: int = 2

    def __post_init__(self):
        if self.window < 2 or not 1 <= self.min_periods <= self.window:
            raise ValueError("window must be 2 at least, min_periods from 1 to window")


def rolling_statistics(df: DataFrame, signals: list[str], order: list[str], entity: list[str] | None = None, config: RollingConfig = RollingConfig()) -> DataFrame:
    """mean, std, variance, rms, skewness, kurtosis, min, max and range of trailing rows of each signal.

    All share one window, so one sort. Without `entity` the frame runs over the order of the whole table, in blocks,
    and windows cross entities."""
    require_columns(df, [*signals, *order, *(entity or [])])
    if entity:
        return _rolling(df, Window.partitionBy(*entity).orderBy(*order), signals, config)
    return over_order(df, order, config.window - 1, lambda rows, by: _rolling(rows, by, signals, config))


def _rolling(df: DataFrame, by: WindowSpec, signals: list[str], config: RollingConfig) -> DataFrame:
    frame, new = by.rowsBetween(1 - config.window, 0), {}
    for s in signals:
        x = numeric(s)
        enough = F.count(x).over(frame) >= config.min_periods
        stats = {
            "mean": F.avg(x).over(frame), "std": F.stddev_samp(x).over(frame), "variance": F.var_samp(x).over(frame), "rms": F.sqrt(F.avg(x * x).over(frame)),
            "skewness": skew_sample(x, frame), "kurtosis": kurtosis_sample(x, frame), "min": F.min(x).over(frame), "max": F.max(x).over(frame), "range": F.max(x).over(frame) - F.min(x).over(frame),
        }
        new |= {f"{s}_rolling_{k}": F.when(enough, v) for k, v in stats.items()}
    return df.withColumns(new)


def global_statistics(df: DataFrame, signals: list[str]) -> DataFrame:
    """A row for each signal: count, mean, std, min, quartiles, max, variance, skewness, kurtosis."""
    rows, found = [], exact_quantiles(df, signals, [0.25, 0.5, 0.75])
    for s in signals:
        x, q = numeric(s), [F.max(F.lit(v).cast("double")) for v in found[s]]
        rows.append(F.struct(F.lit(s).alias("feature"), F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), q[0].alias("q1"), q[1].alias("median"), q[2].alias("q3"), F.max(x).alias("max"), F.var_samp(x).alias("variance"), skew_sample(x).alias("skewness"), kurtosis_sample(x).alias("kurtosis")))
    return df.agg(F.array(*rows).alias("r")).select(F.explode("r").alias("r")).select("r.*")
