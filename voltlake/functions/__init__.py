"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def numeric(c: Column | str) -> Column:
    """try_cast to double, with NaN and infinities as null: null is the only missing value."""
    x = col(c).try_cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def flag(condition: Column) -> Column:
    """1 or 0; an unknown condition is 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def skew_sample(x: Column, over=None) -> Column:
    """Bias-corrected skewness; 0 for constant values, null below three."""
    w = (lambda e: e.over(over)) if over is not None else (lambda e: e)
    n = w(F.count(x)).cast("double")
    return F.when(n < 3, None).when(w(F.max(x)) == w(F.min(x)), 0.0).otherwise(w(F.skewness(x)) * F.sqrt(n * (n - 1)) / (n - 2))


def kurtosis_sample(x: Column, over=None) -> Column:
    """Bias-corrected excess kurtosis; -3 for constant values, null below four."""
    w = (lambda e: e.over(over)) if over is not None else (lambda e: e)
    n = w(F.count(x)).cast("double")
    return F.when(n < 4, None).when(w(F.max(x)) == w(F.min(x)), -3.0).otherwise((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * w(F.kurtosis(x)) + 6))


def seconds(ts: Column) -> Column:
    """Seconds since the epoch as a double, of timestamps with or without a time zone."""
    return F.unix_micros(ts.cast("timestamp")) / 1e6


def require_columns(df: DataFrame, columns) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def require_rows(df: DataFrame, what: str = "table") -> None:
    if df.isEmpty():
        raise ValueError(f"{what} is empty")
