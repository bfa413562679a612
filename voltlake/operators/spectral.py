"""Spectra: sampling interval, Fourier transforms of series, spectral features of windows."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric, seconds
from ..session import ship

FEATURES = (
    "dominant_frequency_cph", "dominant_period_hours", "dominant_power", "total_spectral_energy", "spectral_centroid_cph", "spectral_bandwidth_cph", "spectral_entropy",
    "low_frequency_energy", "high_frequency_energy", "low_frequency_energy_ratio", "high_frequency_energy_ratio", "spectral_peak_count",
)


@dataclass(frozen=True)
class SpectralConfig:
    window: int = 96
    min_periods: int = 32
    low_cph: float = 1.0
    high_cph: float = 2.0
    peak_share: float = 0.1
    epsilon: float = 1e-12

    def __post_init__(self):
        if self.window < 4 or not 4 <= self.min_periods <= self.window or self.high_cph <= self.low_cph:
            raise ValueError("window and min_periods must be 4 at least, high above low")


def sampling_interval(df: DataFrame, timestamp: str, entity: list[str] | None = None) -> DataFrame:
    """Median positive step in seconds between distinct timestamps, of each entity if given."""
    keys = entity or []
    rows = df.select(*keys, F.col(timestamp).alias("t")).where("t is not null").distinct()
    step = seconds(F.col("t")) - seconds(F.lag("t").over(Window.partitionBy(*keys).orderBy("t")))
    return rows.select(*keys, step.alias("step")).where("step > 0").groupBy(*keys).agg(F.percentile("step", F.lit(0.5)).alias("interval_seconds"))


def features_of(windows: list[np.ndarray], intervals: np.ndarray, config: SpectralConfig = SpectralConfig()) -> np.ndarray:
    """A row of FEATURES for each window, NaN where there are too few values or no power. A window is de-meaned, shaped by a
    symmetric Hann window and transformed; windows of one length are one matrix."""
    out, interval = np.full((len(windows), len(FEATURES)), np.nan), np.asarray(intervals, float)
    sizes = np.array([len(w) for w in windows], int)
    for n in np.unique(sizes[(sizes >= 4) & (interval > 0)]).tolist():
        at = np.flatnonzero((sizes == n) & (interval > 0))
        x = np.stack([windows[i] for i in at])
        x = (x - x.mean(axis=1, keepdims=True)) * (0.5 - 0.5 * np.cos(2 * math.pi * np.arange(n) / (n - 1)))
        p = np.abs(np.fft.rfft(x, axis=1))[:, 1:] ** 2
        f = np.arange(1, p.shape[1] + 1)[None, :] * (3600 / (n * interval[at]))[:, None]
        total = p.sum(axis=1)
        live = total > config.epsilon
        at, p, f, total = at[live], p[live], f[live], total[live]
        if not len(at):
            continue
        top = p.argmax(axis=1)[:, None]
        centre = (f * p).sum(axis=1) / total
        share = np.where(p > config.epsilon, p, 0.0)
        share /= share.sum(axis=1, keepdims=True)
        some = (share > 0).sum(axis=1)
        entropy = -(share * np.log(np.where(share > 0, share, 1.0))).sum(axis=1)
        entropy = np.divide(entropy, np.log(np.maximum(some, 2)), out=np.zeros(len(at)), where=some > 1)
        low, high = np.where(f <= config.low_cph, p, 0.0).sum(axis=1), np.where(f >= config.high_cph, p, 0.0).sum(axis=1)
        mid = p[:, 1:-1]
        peaks = ((mid > p[:, :-2]) & (mid > p[:, 2:]) & (mid >= config.peak_share * p.max(axis=1, keepdims=True))).sum(axis=1)
        best = np.take_along_axis(f, top, 1)[:, 0]
        spread = np.sqrt((p * (f - centre[:, None]) ** 2).sum(axis=1) / total)
        out[at] = np.stack([best, 1 / best, np.take_along_axis(p, top, 1)[:, 0], total, centre, spread, entropy, low, high, low / total, high / total, peaks], axis=1)
    return out


def window_features(values: np.ndarray, interval: float, config: SpectralConfig = SpectralConfig()) -> tuple | None:
    """FEATURES of a window; None where there are too few values or no power."""
    row = features_of([values[np.isfinite(values)]], np.array([interval or 0.0]), config)[0]
    return None if np.isnan(row[0]) else tuple(row.tolist())


def rolling_features(df: DataFrame, signal: str, entity: list[str], timestamp: str, config: SpectralConfig = SpectralConfig()) -> DataFrame:
    """df with FEATURES of the trailing window of each row. The window is an array over the entity's frame; an Arrow batch of
    arrays is transformed at once, rows stay where they are."""
    schema = ", ".join(f"{c} double" for c in FEATURES)
    ship(df.sparkSession)

    @F.pandas_udf(schema)
    def features(window: pd.Series, interval: pd.Series) -> pd.DataFrame:
        windows = [np.asarray(w, float) for w in window]
        few = [len(w) < config.min_periods for w in windows]
        out = features_of(windows, np.where(few, 0.0, interval.to_numpy(float)), config)
        return pd.DataFrame(out, columns=list(FEATURES))

    frame = Window.partitionBy(*entity).orderBy(timestamp).rowsBetween(1 - config.window, 0)
    steps = sampling_interval(df, timestamp, entity)
    rows = df.withColumn("__w", F.collect_list(numeric(signal)).over(frame)).join(steps, entity, "left")
    return rows.withColumn("__f", features("__w", F.coalesce("interval_seconds", F.lit(0.0)))).drop("__w", "interval_seconds").select(*df.columns, *(F.col(f"__f.{c}").alias(f"{signal}_{c}") for c in FEATURES))


def dft(series: DataFrame, value: str, order: str, hann: bool = False) -> DataFrame:
    """(n, k, re, im) of a de-meaned series, k from 0 to n / 2. A system's series has one value a time, so that it fits one
    task, where a fast transform takes n log n steps; missing values count as the mean."""
    ship(series.sparkSession)

    def transform(table: pa.Table) -> pa.Table:
        x = table.sort_by("t")["x"].to_numpy(zero_copy_only=False).astype(float)
        n = len(x)
        x = np.nan_to_num(x - (np.nanmean(x) if np.isfinite(x).any() else 0.0))
        found = np.fft.rfft(x * (0.5 - 0.5 * np.cos(2 * math.pi * np.arange(n) / max(1, n - 1))) if hann else x)
        return pa.table({"n": pa.array(np.full(len(found), n)), "k": pa.array(np.arange(len(found), dtype=np.int32)), "re": pa.array(found.real.copy()), "im": pa.array(found.imag.copy())})

    rows = series.select(F.lit(0).alias("one"), F.col(order).alias("t"), F.col(value).cast("double").alias("x"))
    return rows.groupBy("one").applyInArrow(transform, "n long, k int, re double, im double")


def system_fft(series: DataFrame, value: str, order: str, interval_seconds: float) -> DataFrame:
    """(k, frequency_hz, frequency_cph, period_hours, amplitude) of a system series: 2 / n * |X|, the constant and, for even n,
    the last bin halved."""
    bins = dft(series, value, order)
    half = (F.col("k") == 0) | ((F.col("n") % 2 == 0) & (2 * F.col("k") == F.col("n")))
    amplitude = F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")) * 2 / F.col("n") * F.when(half, 0.5).otherwise(1.0)
    hz = F.col("k") / (F.col("n") * float(interval_seconds))
    return bins.select("k", hz.alias("frequency_hz"), (hz * 3600).alias("frequency_cph"), F.when(F.col("k") > 0, 1 / (hz * 3600)).alias("period_hours"), amplitude.alias("amplitude"))


def dominant(spectrum: DataFrame) -> DataFrame:
    """The strongest bin but the constant one, and the energy of all bins."""
    best = F.min_by(F.struct("k", "frequency_hz", "period_hours", "amplitude"), F.when(F.col("k") > 0, F.struct(-F.col("amplitude"), F.col("k"))))
    return spectrum.agg(best.alias("b"), F.sum(F.col("amplitude") * F.col("amplitude")).alias("energy")).select("b.*", "energy")


def periods(spectrum: DataFrame, least_hours: float = 0.25, most_hours: float = 24.0) -> DataFrame:
    return spectrum.where(F.col("period_hours").between(least_hours, most_hours))


def series_features(series: DataFrame, value: str, order: str, interval_seconds: float, config: SpectralConfig = SpectralConfig()) -> DataFrame:
    """FEATURES of one short series, declared over its bins."""
    cph = 3600.0 / interval_seconds
    bins = dft(series.where(numeric(value).isNotNull()), value, order, hann=True).where("k > 0 and n >= 4")
    bins = bins.select("k", (F.col("k") * cph / F.col("n")).alias("f"), (F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("p"))
    by = Window.orderBy("k")
    bins = bins.withColumns({"a": F.lag("p").over(by), "b": F.lead("p").over(by), "t": F.sum("p").over(Window.partitionBy()), "m": F.max("p").over(Window.partitionBy()), "c": F.sum(F.col("f") * F.col("p")).over(Window.partitionBy()) / F.sum("p").over(Window.partitionBy()), "pos": F.sum(F.when(F.col("p") > config.epsilon, F.col("p"))).over(Window.partitionBy())})
    q = F.when(F.col("p") > config.epsilon, F.col("p") / F.col("pos"))
    peak = (F.col("p") > F.col("a")) & (F.col("p") > F.col("b")) & (F.col("p") >= config.peak_share * F.col("m"))
    low, high = F.sum(F.when(F.col("f") <= config.low_cph, F.col("p")).otherwise(0.0)), F.sum(F.when(F.col("f") >= config.high_cph, F.col("p")).otherwise(0.0))
    top = F.min_by("f", F.struct(-F.col("p"), F.col("k")))
    values = (top, 1 / top, F.max("p"), F.sum("p"), F.max("c"), F.sqrt(F.sum(F.col("p") * F.pow(F.col("f") - F.col("c"), F.lit(2))) / F.sum("p")), F.coalesce(F.sum(-q * F.log(q)) / F.nullif(F.log(F.count(q)), F.lit(0.0)), F.lit(0.0)), low, high, low / F.sum("p"), high / F.sum("p"), F.count_if(F.coalesce(peak, F.lit(False))).cast("double"))
    return bins.where(F.col("t") > config.epsilon).agg(*(v.alias(c) for c, v in zip(FEATURES, values)))
