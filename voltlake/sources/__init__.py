"""Table catalogue, scans and sinks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import require_rows

#: Table schemas of the measurement data.
SCHEMAS = {
    "profiles": "timestamp timestamp_ntz, load_mw double, load_pu double, solar_mw double, solar_pu double",
    "bus": "timestamp timestamp_ntz, bus_id int, voltage_pu double, angle_deg double, active_power_mw double, reactive_power_mvar double",
    "line": "timestamp timestamp_ntz, line_id int, current_from_ka double, current_to_ka double, loading_percent double",
    "bus_processed": "timestamp timestamp_ntz, bus_id int, voltage_pu double, angle_deg double, active_power_mw double, reactive_power_mvar double, hour double, day_of_week int, day_of_year int, hour_sin double, hour_cos double, day_of_week_sin double, day_of_week_cos double",
    "topology": "line_id int, from_bus int, to_bus int, in_service boolean",
    "ground_truth": "event_id int, anomaly_type string, entity_type string, entity_id int, start_timestamp timestamp_ntz, end_timestamp timestamp_ntz, severity double, affected_measurement string",
    "measurement_record": "timestamp timestamp_ntz, entity_type string, entity_id long, measurement string, value double, source string, metadata map<string,string>",
}
ANOMALY_TYPES = ("normal", "voltage_deviation", "power_spike", "sensor_spike", "line_overload")


@dataclass(frozen=True)
class Catalog:
    """Where tables are: root/name.format. A table is read with its declared schema, if it has one; a CSV must have one."""

    root: str
    format: str = "parquet"

    def path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}.{self.format}"

    def load(self, spark: SparkSession, name: str, schema: str | None = None, check: bool = True) -> DataFrame:
        known = schema or SCHEMAS.get(name)
        if not known and self.format == "csv":  # a CSV needs one: that of the measurement, as in bus_test
            known = SCHEMAS.get(name.split("_")[0])
        df = scan(spark, self.path(name), self.format, known)
        if check:
            require_rows(df, name)
        return df

    def load_split(self, spark: SparkSession, name: str, split: str) -> DataFrame:
        """One split of a keyed table that was written with split as its partition: only its files are read."""
        return spark.read.parquet(self.path(name)).where(F.col("split") == split)

    def load_splits(self, spark: SparkSession, names: list[str], split: str) -> dict[str, DataFrame]:
        """One split of several tables, cut at the same times; it is an error if their times differ."""
        out = {name: self.load_split(spark, name, split) for name in names}
        spans = {tuple(df.agg(F.min("timestamp"), F.max("timestamp")).first()) for df in out.values()}
        if len(spans) > 1:
            raise ValueError(f"the tables' {split} splits aren't aligned")
        return out

    def load_all(self, spark: SparkSession) -> dict[str, DataFrame]:
        """The processed bus table and the raw line table."""
        return {"bus": self.load(spark, "bus_processed"), "line": self.load(spark, "line")}

    def save(self, df: DataFrame, name: str, partition_by: list[str] | None = None) -> str:
        sink(df, self.path(name), self.format, partition_by)
        return self.path(name)


def scan(spark: SparkSession, path: str, format: str = "parquet", schema: str | None = None) -> DataFrame:
    reader = spark.read
    if format == "csv":
        if not schema:
            raise ValueError("a CSV needs a schema")
        return reader.schema(schema).option("header", True).csv(path)
    if format == "json":
        return (reader.schema(schema) if schema else reader).json(path)
    return (reader.schema(schema) if schema else reader).format(format).load(path)


def sink(df: DataFrame, path: str, format: str = "parquet", partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite").partitionBy(*(partition_by or []))
    (writer.option("header", True).csv if format == "csv" else writer.format(format).save)(path)


def save_model(spark: SparkSession, model, path: str) -> None:
    """A fitted model's JSON, as a one-row text table."""
    spark.createDataFrame([(model.to_json(),)], "value string").write.mode("overwrite").text(path)


def load_model(spark: SparkSession, kind, path: str):
    return kind.from_json(spark.read.text(path, wholetext=False).first()[0])
