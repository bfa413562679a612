"""Cleaning: duplicates, coercion, gaps and time features."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric, require_columns

STRATEGIES = ("linear", "forward_fill", "none")
BUS_COLUMNS = ("voltage_pu", "angle_deg", "active_power_mw", "reactive_power_mvar", "frequency_hz", "der_generation_mw")
LINE_COLUMNS = ("current_from_ka", "current_to_ka", "loading_percent")


def parse_timestamps(df: DataFrame, column: str = "timestamp") -> DataFrame:
    """Timestamps of strings; an unreadable one is an error when the result is computed."""
    if dict(df.dtypes)[column].startswith("timestamp"):
        return df
    parsed = F.try_to_timestamp(F.col(column).cast("string"))
    return df.withColumn(column, F.when(parsed.isNull(), F.raise_error(F.concat(F.lit("invalid timestamp: "), F.coalesce(F.col(column).cast("string"), F.lit("null")))).cast("timestamp")).otherwise(parsed).cast("timestamp_ntz"))


def dedup_full(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def dedup_keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row by `order` of each key."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def coerce(df: DataFrame, columns) -> DataFrame:
    """Those of the columns that are there, as numbers; what can't be read becomes null."""
    return df.withColumns({c: numeric(c) for c in columns if c in df.columns})


def interpolate(df: DataFrame, columns: list[str], entity: list[str], order: list[str], strategy: str = "linear") -> DataFrame:
    """Fill gaps within an entity. linear: by position, ends with the nearest value; forward_fill: leading gaps stay."""
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}")
    require_columns(df, [*columns, *entity, *order])
    if strategy == "none":
        return df
    by = Window.partitionBy(*entity).orderBy(*order)
    before, after = by.rowsBetween(Window.unboundedPreceding, 0), by.rowsBetween(0, Window.unboundedFollowing)
    if strategy == "forward_fill":
        return df.withColumns({c: F.last(numeric(c), ignorenulls=True).over(before) for c in columns})
    df = df.withColumn("__i", F.row_number().over(by))
    filled = {}
    for c in columns:
        x = numeric(c)
        at = F.when(x.isNotNull(), F.col("__i"))
        a, b = F.last(x, ignorenulls=True).over(before), F.first(x, ignorenulls=True).over(after)
        i, j = F.last(at, ignorenulls=True).over(before), F.first(at, ignorenulls=True).over(after)
        filled[c] = F.coalesce(x, a + (b - a) * (F.col("__i") - i) / F.nullif(j - i, F.lit(0)), a, b)
    return df.withColumns(filled).drop("__i")


def time_features(df: DataFrame, timestamp: str = "timestamp") -> DataFrame:
    """hour with minutes as a fraction, day_of_week from Monday as 0, day_of_year and the cycles of hour and week."""
    t = F.col(timestamp)
    hour, day = F.hour(t) + F.minute(t) / 60.0, F.weekday(t)
    angle, week = hour * (2 * math.pi / 24), day * (2 * math.pi / 7)
    return df.withColumns({"hour": hour, "day_of_week": day, "day_of_year": F.dayofyear(t), "hour_sin": F.sin(angle), "hour_cos": F.cos(angle), "day_of_week_sin": F.sin(week), "day_of_week_cos": F.cos(week)})


def preprocess(df: DataFrame, entity: str, ordinal: str, columns, timestamp: str = "timestamp", strategy: str = "linear") -> DataFrame:
    """parse, drop equal rows, keep the first of each (timestamp, entity), coerce, interpolate, time features. Sort at the sink."""
    rows = parse_timestamps(df, timestamp)
    same = rows.groupBy(*(c for c in rows.columns if c != ordinal)).agg(F.min(ordinal).alias(ordinal))
    first = coerce(dedup_keep_first(same, [timestamp, entity], [ordinal]), columns)
    return time_features(interpolate(first, [c for c in columns if c in df.columns], [entity], [timestamp], strategy), timestamp)


def report(before: DataFrame, after: DataFrame, keys: list[str], ordinal: str | None = None) -> DataFrame:
    """One row: rows before and after, equal rows, repeated keys, and missing values before and after."""
    data = [c for c in before.columns if c != ordinal]
    missing = lambda df: sum((F.count_if(F.col(c).isNull()) for c in df.columns if c != ordinal), F.lit(0))
    a = before.agg(F.count("*").alias("rows_before"), missing(before).alias("missing_before"))
    whole = before.select(*data).distinct()
    b = whole.agg(F.count("*").alias("rows_distinct"))
    c = whole.select(*keys).distinct().agg(F.count("*").alias("keys_distinct"))
    d = after.agg(F.count("*").alias("rows_after"), missing(after).alias("missing_after"))
    one = a.crossJoin(F.broadcast(b)).crossJoin(F.broadcast(c)).crossJoin(F.broadcast(d))  # one row each
    return one.select("rows_before", (F.col("rows_before") - F.col("rows_distinct")).alias("equal_rows"), (F.col("rows_distinct") - F.col("keys_distinct")).alias("repeated_keys"), "missing_before", "rows_after", "missing_after")
