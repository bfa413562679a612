"""Data-quality checks as rows: (category, column, severity, count). One aggregate pass and one groupBy."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "category string, column string, severity string, count long"


@dataclass(frozen=True)
class Rules:
    """timestamp and id columns, numeric columns, and (low, high) of those with a range; None is open."""

    timestamp: str
    entity: str
    numeric: tuple[str, ...]
    ranges: dict = field(default_factory=dict)
    ordinal: str | None = None


#: Allowed ranges of the measurements.
BUS_RULES = Rules("timestamp", "bus_id", ("voltage_pu", "angle_deg", "active_power_mw", "reactive_power_mvar"), {"voltage_pu": (0.0, 2.0)})
LINE_RULES = Rules("timestamp", "line_id", ("current_from_ka", "current_to_ka", "loading_percent"), {"loading_percent": (0.0, 1000.0), "current_from_ka": (0.0, None), "current_to_ka": (0.0, None)})


def counts(df: DataFrame, rules: Rules) -> DataFrame:
    """One row of counts over the table: `category:column:severity`."""
    of = {}

    def count_if(name: str, condition) -> None:
        of[name] = F.count_if(F.coalesce(condition, F.lit(False)))

    kinds = dict(df.dtypes)
    ts = F.col(rules.timestamp)
    count_if(f"timestamp_parse:{rules.timestamp}:error", ts.isNull() if kinds[rules.timestamp].startswith("timestamp") else ts.isNull() | F.try_to_timestamp(ts.cast("string")).isNull())
    count_if(f"id_missing:{rules.entity}:error", F.col(rules.entity).isNull())
    count_if(f"id_not_numeric:{rules.entity}:warning", F.col(rules.entity).isNotNull() & F.col(rules.entity).try_cast("double").isNull())
    for c in df.columns:
        if c != rules.ordinal:
            count_if(f"missing:{c}:warning", F.col(c).isNull() | (F.isnan(c) if kinds[c] in ("double", "float") else F.lit(False)))
    for c in rules.numeric:
        x = F.col(c).try_cast("double")
        count_if(f"not_numeric:{c}:error", F.col(c).isNotNull() & x.isNull())
        count_if(f"infinite:{c}:error", F.abs(x) == float("inf"))
    for c, (low, high) in rules.ranges.items():
        x = F.col(c).try_cast("double")
        x = F.when(F.isnan(x), None).otherwise(x)
        count_if(f"range:{c}:error", (F.lit(False) if low is None else x < low) | (F.lit(False) if high is None else x > high))
    return df.agg(*(v.alias(k) for k, v in of.items()))


def disorder(df: DataFrame, rules: Rules, per_entity: bool = False) -> DataFrame:
    """How many rows step back in time, over the ordinal; per_entity: within each entity. The order of a whole table is
    checked by ranges of the ordinal: within each, and from each to the next."""
    if per_entity:
        back = F.lag(rules.timestamp).over(Window.partitionBy(rules.entity).orderBy(rules.ordinal)) > F.col(rules.timestamp)
        return df.select(back.alias("back")).agg(F.count_if(F.coalesce("back", F.lit(False))).alias("count"))
    part = F.floor(F.col(rules.ordinal) / 100_000).alias("part")
    rows = df.select(rules.ordinal, F.col(rules.timestamp).alias("ts"), part)
    inside = rows.select("part", (F.lag("ts").over(Window.partitionBy("part").orderBy(rules.ordinal)) > F.col("ts")).alias("back")).agg(F.count_if(F.coalesce("back", F.lit(False))).alias("n"))
    ends = rows.groupBy("part").agg(F.min_by("ts", rules.ordinal).alias("first"), F.max_by("ts", rules.ordinal).alias("last"))
    between = ends.select((F.lag("last").over(Window.orderBy("part")) > F.col("first")).alias("back")).agg(F.count_if(F.coalesce("back", F.lit(False))).alias("n"))
    return inside.union(between).agg(F.sum("n").alias("count"))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """All rows in groups of equal keys, one row of counts."""
    return df.groupBy(*keys).count().where("count > 1").agg(F.coalesce(F.sum("count"), F.lit(0)).cast("long").alias("count"))


def validate(df: DataFrame, rules: Rules) -> DataFrame:
    """Issues with a count above 0. A table that is empty or lacks columns has that issue alone."""
    spark: SparkSession = df.sparkSession
    missing = [c for c in (rules.timestamp, rules.entity, *rules.numeric) if c not in df.columns]
    if missing or df.isEmpty():
        return spark.createDataFrame([("structure", c, "error", 1) for c in missing or ["*"]], SCHEMA)
    row = counts(df, rules)
    parts = F.array(*(F.struct(*(F.lit(x).alias(k) for k, x in zip(("category", "column", "severity"), name.split(":"))), F.col(f"`{name}`").alias("count")) for name in row.columns))
    out = row.select(F.explode(parts).alias("r")).select("r.*")
    out = out.union(duplicates(df, [rules.timestamp, rules.entity]).select(F.lit("duplicate"), F.lit("*"), F.lit("error"), "count"))
    if rules.ordinal:
        out = out.union(disorder(df, rules).select(F.lit("timestamp_order"), F.lit(rules.timestamp), F.lit("error"), "count"))
    return out.where("count > 0")


def passed(issues: DataFrame) -> bool:
    return issues.where("severity = 'error'").isEmpty()


def referential_integrity(edges: DataFrame, nodes: DataFrame, ends: tuple[str, str], node: str) -> DataFrame:
    """Edges with an end that is not a node, and which end."""
    ids = nodes.select(F.col(node).alias("__node")).distinct()
    return edges.join(ids, F.col(ends[0]) == F.col("__node"), "left_anti").withColumn("missing_end", F.lit(ends[0])).unionByName(edges.join(ids, F.col(ends[1]) == F.col("__node"), "left_anti").withColumn("missing_end", F.lit(ends[1])))
