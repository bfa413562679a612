"""Exploratory statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import kurtosis_sample, numeric, seconds, skew_sample
from .ordered import over_order
from .quantiles import exact_quantiles

AGGREGATIONS = {"mean": F.avg, "median": lambda x: F.percentile(x, F.lit(0.5)), "min": F.min, "max": F.max, "std": F.stddev_samp}


def dataset_summary(df: DataFrame, timestamp: str, entity: str) -> DataFrame:
    return df.agg(F.count("*").alias("rows"), F.lit(len(df.columns)).cast("long").alias("columns"), F.min(timestamp).alias("first"), F.max(timestamp).alias("last"), F.countDistinct(entity).alias("entities"))


def aggregate_system(df: DataFrame, feature: str, timestamp: str, aggregation: str = "mean") -> DataFrame:
    """One value a timestamp over all entities."""
    if aggregation not in AGGREGATIONS:
        raise ValueError(f"aggregation must be one of {tuple(AGGREGATIONS)}")
    return df.groupBy(timestamp).agg(AGGREGATIONS[aggregation](numeric(feature)).alias("value"))


def temporal_statistics(series: DataFrame, timestamp: str, value: str = "value", window: int = 4) -> DataFrame:
    """Of a system series: moments, steps, ramps by the first step's seconds, autocorrelations, rolling spread."""
    x, t = F.col(value), seconds(F.col(timestamp))

    def steps(rows: DataFrame, by: WindowSpec) -> DataFrame:
        frame = by.rowsBetween(1 - window, 0)
        return rows.withColumns({"d": x - F.lag(x).over(by), "gap": t - F.lag(t).over(by), "x1": F.lag(x, 1).over(by), "x4": F.lag(x, 4).over(by), "s": F.when(F.count(x).over(frame) >= window, F.stddev_samp(x).over(frame))})

    rows = over_order(series.select(timestamp, value), [timestamp], max(4, window - 1), steps)
    step = F.min_by("gap", F.when(F.col("gap").isNotNull(), F.col(timestamp)))  # the first one
    return rows.agg(F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg(F.abs("d")).alias("mean_abs_change"), F.max(F.abs("d")).alias("max_abs_change"), (F.avg(F.abs("d")) / step).alias("mean_abs_ramp"), (F.max(F.abs("d")) / step).alias("max_abs_ramp"), F.corr(x, "x1").alias("acf_1"), F.corr(x, "x4").alias("acf_4"), F.avg("s").alias("rolling_std_mean"), F.max("s").alias("rolling_std_max"))


def autocorrelation(series: DataFrame, timestamp: str, value: str = "value", lags: int = 24) -> DataFrame:
    """(lag, acf): Pearson correlation of the overlap, lags from 0."""
    x = F.col(value)
    rows = over_order(series.select(timestamp, value), [timestamp], lags, lambda rows, by: rows.withColumns({f"l{k}": F.lag(x, k).over(by) for k in range(lags + 1)}))
    return rows.agg(F.array(*(F.struct(F.lit(k).alias("lag"), F.corr(x, f"l{k}").alias("acf")) for k in range(lags + 1))).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def hourly_profile(series: DataFrame, timestamp: str, value: str = "value") -> DataFrame:
    x = F.col(value)
    return series.groupBy(F.hour(timestamp).alias("hour")).agg(F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"))


def daily_profile(series: DataFrame, timestamp: str, value: str = "value") -> DataFrame:
    """Long form of the time-of-day by date table."""
    return series.groupBy(F.date_format(timestamp, "HH:mm").alias("time"), F.date_format(timestamp, "yyyy-MM-dd").alias("date")).agg(F.avg(value).alias("value"))


def daily_pivot(series: DataFrame, timestamp: str, value: str = "value", dates: list[str] | None = None) -> DataFrame:
    return daily_profile(series, timestamp, value).groupBy("time").pivot("date", dates).agg(F.first("value"))


def ramp_rate(series: DataFrame, timestamp: str, value: str = "value", entity: list[str] | None = None) -> DataFrame:
    """Change a second from each row's predecessor; first rows are left out."""

    def steps(rows: DataFrame, by: WindowSpec) -> DataFrame:
        gap = seconds(F.col(timestamp)) - seconds(F.lag(timestamp).over(by))
        return rows.withColumns({"seconds": gap, "change": F.col(value) - F.lag(value).over(by)})

    rows = steps(series, Window.partitionBy(*entity).orderBy(timestamp)) if entity else over_order(series, [timestamp], 1, steps)
    return rows.where("seconds is not null").withColumn("ramp", F.try_divide("change", "seconds"))


def rolling_mean_std(series: DataFrame, timestamp: str, value: str = "value", window: int = 4, entity: list[str] | None = None) -> DataFrame:
    """Of full windows only."""
    if window < 2:
        raise ValueError("window must be 2 at least")

    def rolled(rows: DataFrame, by: WindowSpec) -> DataFrame:
        frame = by.rowsBetween(1 - window, 0)
        full = F.count(value).over(frame) >= window
        return rows.withColumns({"rolling_mean": F.when(full, F.avg(value).over(frame)), "rolling_std": F.when(full, F.stddev_samp(value).over(frame))})

    return rolled(series, Window.partitionBy(*entity).orderBy(timestamp)) if entity else over_order(series, [timestamp], window - 1, rolled)


def _quartiles(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, q1, median, q3): a row for each named column."""
    found = exact_quantiles(df, columns, [0.25, 0.5, 0.75])
    return df.sparkSession.createDataFrame([(c, *found[c]) for c in columns], "feature string, q1 double, median double, q3 double")


def distribution_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row for each column, with Tukey's outliers (strictly beyond 1.5 interquartile ranges)."""
    found, rows = exact_quantiles(df, columns, [0.25, 0.5, 0.75]), []
    for c in columns:
        x, (q1, median, q3) = numeric(c), (F.lit(v).cast("double") for v in found[c])
        span = 1.5 * (q3 - q1)
        rows.append(F.struct(F.lit(c).alias("feature"), F.count(x).alias("count"), F.avg(x).alias("mean"), F.max(median).alias("median"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(q1).alias("q1"), F.max(q3).alias("q3"), F.max(x).alias("max"), skew_sample(x).alias("skewness"), kurtosis_sample(x).alias("kurtosis"), F.count_if(F.coalesce((x < q1 - span) | (x > q3 + span), F.lit(False))).alias("outliers")))
    stats = df.agg(F.array(*rows).alias("r")).select(F.explode("r").alias("r")).select("r.*").where("count > 0")
    return stats.withColumn("outlier_fraction", F.col("outliers") / F.col("count"))


def histogram(df: DataFrame, column: str, bins: int = 40) -> DataFrame:
    """(bin, low, high, count, density) over [min, max]; the last bin is closed on the right."""
    x = numeric(column)
    rows = df.select(x.alias("x")).where("x is not null")
    ends = rows.agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n"))
    at = F.least(F.lit(bins - 1), F.coalesce(F.floor(F.try_divide((F.col("x") - F.col("lo")) * bins, F.col("hi") - F.col("lo"))), F.lit(0))).cast("int")
    counted = rows.crossJoin(F.broadcast(ends)).groupBy(at.alias("bin")).agg(F.count("*").alias("count"))  # one row beside
    grid = ends.select(F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "lo", "hi", "n").withColumn("w", (F.col("hi") - F.col("lo")) / bins)
    both = grid.join(F.broadcast(counted), "bin", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    return both.select("bin", (F.col("lo") + F.col("bin") * F.col("w")).alias("low"), (F.col("lo") + (F.col("bin") + 1) * F.col("w")).alias("high"), "count", F.try_divide("count", F.col("n") * F.col("w")).alias("density"))


def box_plot(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    rows = df.select(*(by or []), F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), numeric(c).alias("x")) for c in columns))).alias("r")).select(*(by or []), "r.*")
    if not by:
        ends = rows.groupBy("feature").agg(F.min("x").alias("min"), F.max("x").alias("max"))
        return ends.join(F.broadcast(_quartiles(df, columns)), "feature").select("feature", "min", "q1", "median", "q3", "max")  # a row for each named column
    q = F.percentile("x", [0.25, 0.5, 0.75])
    return rows.groupBy(*(by or []), "feature").agg(F.min("x").alias("min"), q[0].alias("q1"), q[1].alias("median"), q[2].alias("q3"), F.max("x").alias("max"))


def per_entity(df: DataFrame, entity: str, full: str, also: list[str] = ()) -> DataFrame:
    """mean, std, min, max and range of `full`, mean and std of the others, of each entity."""
    x = numeric(full)
    of = [F.avg(x).alias(f"{full}_mean"), F.stddev_samp(x).alias(f"{full}_std"), F.min(x).alias(f"{full}_min"), F.max(x).alias(f"{full}_max"), (F.max(x) - F.min(x)).alias(f"{full}_range")]
    return df.groupBy(entity).agg(*of, *(a for c in also for a in (F.avg(numeric(c)).alias(f"{c}_mean"), F.stddev_samp(numeric(c)).alias(f"{c}_std"))))


def envelope(df: DataFrame, feature: str, timestamp: str) -> DataFrame:
    x = numeric(feature)
    return df.groupBy(timestamp).agg(F.min(x).alias("min"), F.avg(x).alias("mean"), F.max(x).alias("max"))


def top_variation(df: DataFrame, entity: str, feature: str, k: int = 5) -> DataFrame:
    """The k entities of largest max - min; ties by entity."""
    x = numeric(feature)
    return df.groupBy(entity).agg((F.max(x) - F.min(x)).alias("variation")).orderBy(F.col("variation").desc(), entity).limit(k)


def top_variation_rows(df: DataFrame, entity: str, feature: str, k: int = 5) -> DataFrame:
    return df.join(F.broadcast(top_variation(df, entity, feature, k).select(entity)), entity, "left_semi")  # k rows


def limit_statistics(df: DataFrame, feature: str, low: float, high: float) -> DataFrame:
    x = numeric(feature)
    below, above = F.count_if(F.coalesce(x < low, F.lit(False))), F.count_if(F.coalesce(x > high, F.lit(False)))
    return df.agg(F.count(x).alias("count"), below.alias("below"), above.alias("above"), F.try_divide(below, F.count(x)).alias("below_fraction"), F.try_divide(above, F.count(x)).alias("above_fraction"))
