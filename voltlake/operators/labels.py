"""Row labels from event intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import require_columns, seconds

#: Buckets of time that an event is in at most.
SPANS = 16
EVENT_COLUMNS = ("event_id", "anomaly_type", "entity_type", "entity_id", "start_timestamp", "end_timestamp", "severity", "affected_measurement")


def check_events(events: DataFrame) -> DataFrame:
    """The events with typed times; missing columns, missing times and ends before starts are errors."""
    require_columns(events, EVENT_COLUMNS)
    out = events.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start_timestamp", "end_timestamp")})
    if not out.where("start_timestamp is null or end_timestamp is null or end_timestamp < start_timestamp").isEmpty():
        raise ValueError("an event has no start or end, or ends before it starts")
    return out


def label(df: DataFrame, events: DataFrame, entity: str, timestamp: str, entity_type: str | None = None, order: str = "event_id") -> DataFrame:
    """df with is_anomaly, anomaly_event_id, anomaly_type, anomaly_severity and affected_measurement. A row is of the event of its
    entity whose closed interval holds it; of several the last by `order`. Times are cut into buckets of equal length, as
    long as the events are on average; an event is in each bucket that it touches, up to SPANS of them, a longer one in
    buckets of a coarser cut (SPANS times as long, and so on), so that the events that meet a row are those of its buckets
    and no entity's events are one row."""
    rows = events if entity_type is None else events.where(F.col("entity_type") == entity_type)
    a, b = seconds(F.col("start_timestamp")), seconds(F.col("end_timestamp"))
    mean, longest = rows.agg(F.avg(b - a), F.max(b - a)).first()
    base = max(1.0, float(mean or 0.0))
    levels = 1
    while base * SPANS ** (levels - 1) * (SPANS - 1) < (longest or 0.0):
        levels += 1
    # the level whose buckets the event touches SPANS of at most
    level = F.lit(levels - 1)
    for k in reversed(range(levels - 1)):
        level = F.when(b - a <= base * SPANS**k * (SPANS - 1), F.lit(k)).otherwise(level)
    width = F.lit(base) * F.pow(F.lit(float(SPANS)), F.col("__level"))
    touched = F.explode(F.sequence(F.floor(a / width), F.floor(b / width)))
    e = rows.where(a.isNotNull() & (b >= a)).withColumn("__level", level).withColumn("__bucket", touched)
    e = e.groupBy(F.col("entity_id").alias(entity), "__level", "__bucket").agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), "event_id", "anomaly_type", "severity", "affected_measurement", F.col("start_timestamp").alias("a"), F.col("end_timestamp").alias("b"))), asc=False).alias("__events"))
    out, hits = df, []
    for k in range(levels):
        own = e.where(F.col("__level") == k).select(entity, "__bucket", F.col("__events").alias(f"__events{k}"))
        out = out.withColumn("__bucket", F.floor(seconds(F.col(timestamp)) / (base * SPANS**k))).join(own, [entity, "__bucket"], "left").drop("__bucket")
        hits.append(F.get(F.filter(f"__events{k}", lambda x: F.col(timestamp).between(x["a"], x["b"])), F.lit(0)))
    found = F.get(F.sort_array(F.filter(F.array(*hits), lambda x: x.isNotNull()), asc=False), F.lit(0))
    out = out.withColumn("__e", found)
    return out.withColumns({
        "is_anomaly": F.col("__e").isNotNull().cast("int"), "anomaly_event_id": F.coalesce(F.col("__e.event_id").cast("long"), F.lit(-1)), "anomaly_type": F.coalesce("__e.anomaly_type", F.lit("normal")),
        "anomaly_severity": F.coalesce("__e.severity", F.lit(0.0)), "affected_measurement": F.coalesce("__e.affected_measurement", F.lit("")),
    }).drop(*(f"__events{k}" for k in range(levels)), "__e").select(*df.columns, "is_anomaly", "anomaly_event_id", "anomaly_type", "anomaly_severity", "affected_measurement")


def event_summary(labelled: DataFrame, entity: str, timestamp: str) -> DataFrame:
    """A row for each event found in labelled rows."""
    first = lambda c: F.min_by(c, timestamp).alias(c)
    hit = labelled.where("is_anomaly = 1")
    return hit.groupBy("anomaly_event_id").agg(first("anomaly_type"), F.min_by(entity, timestamp).alias("entity_id"), F.min(timestamp).alias("start_timestamp"), F.max(timestamp).alias("end_timestamp"), F.min_by("anomaly_severity", timestamp).alias("severity"), first("affected_measurement"), F.count("*").alias("number_of_rows"))


def confusion(scored: DataFrame, predicted: str = "prediction", actual: str = "is_anomaly") -> DataFrame:
    """Counts of true and false flags (an addition: scores against labels)."""
    p, a = F.col(predicted) == 1, F.col(actual) == 1
    return scored.agg(F.count_if(p & a).alias("true_positive"), F.count_if(p & ~a).alias("false_positive"), F.count_if(~p & a).alias("false_negative"), F.count_if(~p & ~a).alias("true_negative"))
