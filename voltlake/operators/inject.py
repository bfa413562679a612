"""Injected anomalies, as conditional updates, and the events that record them."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_SCHEMA = "event_id int, anomaly_type string, entity_type string, entity_id long, start_timestamp timestamp_ntz, end_timestamp timestamp_ntz, severity double, affected_measurement string"


def span(df: DataFrame, timestamp: str, start: datetime, steps: int) -> tuple:
    """First and last of the `steps` distinct timestamps from start, fewer at the end of the data."""
    if steps < 1:
        raise ValueError("steps must be positive")
    row = df.select(timestamp).where(F.col(timestamp) >= F.lit(start).cast("timestamp_ntz")).distinct().orderBy(timestamp).limit(steps).agg(F.min(timestamp), F.max(timestamp)).first()
    if row[0] is None or row[0] != start:
        raise ValueError("start is not a timestamp of the data")
    return row[0], row[1]


def update(df: DataFrame, entity: str, entity_id: int, timestamp: str, first, last, changes: dict[str, Column]) -> DataFrame:
    """Change columns of one entity's rows from first to last."""
    hit = (F.col(entity) == entity_id) & F.col(timestamp).between(F.lit(first).cast("timestamp_ntz"), F.lit(last).cast("timestamp_ntz"))
    return df.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in changes.items()})


@dataclass
class Injector:
    """Keeps the events of what it injected, with ids from 0. A power spike is recorded under the first of its columns (active
    power), a line overload under the last (loading)."""

    timestamp: str = "timestamp"
    bus: str = "bus_id"
    line: str = "line_id"
    events: list[tuple] = field(default_factory=list)

    def _add(self, df, kind, entity_type, entity_id, start, steps, severity, changes, measure):
        entity = self.bus if entity_type == "bus" else self.line
        if df.where(F.col(entity) == entity_id).isEmpty():
            raise ValueError(f"no {entity_type} {entity_id}")
        first, last = span(df, self.timestamp, start, steps)
        self.events.append((len(self.events), kind, entity_type, entity_id, first, last, float(severity), measure))
        return update(df, entity, entity_id, self.timestamp, first, last, changes)

    def voltage_deviation(self, df: DataFrame, bus_id: int, start: datetime, steps: int, deviation: float, column: str = "voltage_pu") -> DataFrame:
        return self._add(df, "voltage_deviation", "bus", bus_id, start, steps, abs(deviation), {column: F.col(column) - deviation}, column)

    def power_spike(self, df: DataFrame, bus_id: int, start: datetime, steps: int, multiplier: float, columns=("active_power_mw", "reactive_power_mvar")) -> DataFrame:
        return self._add(df, "power_spike", "bus", bus_id, start, steps, abs(multiplier - 1), {c: F.col(c) * multiplier for c in columns}, columns[0])

    def sensor_spike(self, df: DataFrame, bus_id: int, start: datetime, magnitude: float, column: str = "voltage_pu") -> DataFrame:
        return self._add(df, "sensor_spike", "bus", bus_id, start, 1, abs(magnitude), {column: F.col(column) + magnitude}, column)

    def line_overload(self, df: DataFrame, line_id: int, start: datetime, steps: int, multiplier: float, columns=("current_from_ka", "current_to_ka", "loading_percent")) -> DataFrame:
        return self._add(df, "line_overload", "line", line_id, start, steps, abs(multiplier - 1), {c: F.col(c) * multiplier for c in columns}, columns[-1])

    def ground_truth(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.events, EVENT_SCHEMA)

    def reset(self) -> None:
        self.events.clear()


def scenario(bus: DataFrame, line: DataFrame, day: datetime) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The scripted five events of an evening, with 15-minute steps: (bus, line, events). Nothing is before 19:00."""
    at = lambda h, m: day.replace(hour=h, minute=m, second=0, microsecond=0)
    i = Injector()
    bus = i.voltage_deviation(bus, 17, at(19, 0), 4, 0.1)
    bus = i.power_spike(bus, 14, at(20, 0), 3, 1.5)
    bus = i.sensor_spike(bus, 29, at(21, 0), 0.2)
    line = i.line_overload(line, 1, at(19, 30), 4, 1.5)
    line = i.line_overload(line, 5, at(22, 0), 3, 1.4)
    if min(e[4] for e in i.events) < at(19, 0):
        raise ValueError("an event is before the test period")
    return bus, line, i.ground_truth(bus.sparkSession)
