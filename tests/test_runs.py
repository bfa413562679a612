"""Sources, whole runs and streams: schemas, splits, round trips, dataset build, detection."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltlake import plans, sources, streaming
from voltlake.operators import clean, electrical, forest, quality, scale, select, split


def _bus(spark, steps=96, buses=3):
    rng = np.random.default_rng(0)
    rows = [(datetime(2026, 1, 1) + timedelta(minutes=15 * i), b, float(1 + 0.02 * rng.normal()), float(rng.normal()), float(5 + rng.normal()), float(2 + rng.normal())) for i in range(steps) for b in range(buses)]
    return spark.createDataFrame(rows, sources.SCHEMAS["bus"])


@pytest.mark.parametrize("format", ["csv", "parquet", "json"])
def test_round_trip_with_declared_schemas(spark, tmp_path, format):
    at, bus = sources.Catalog(str(tmp_path), format), _bus(spark, 8)
    at.save(bus, "bus")
    got = at.load(spark, "bus")
    assert got.dtypes == bus.dtypes and sorted(got.collect()) == sorted(bus.collect())
    processed = clean.time_features(bus)
    at.save(processed, "bus_processed")
    at.save(spark.createDataFrame([(datetime(2026, 1, 1), 1, 0.1, 0.1, 50.0)], sources.SCHEMAS["line"]), "line")
    both = at.load_all(spark)
    assert both["bus"].dtypes == processed.dtypes and {tuple(map(str, r)) for r in both["bus"].collect()} == {tuple(map(str, r)) for r in processed.collect()}
    assert both["line"].first()["loading_percent"] == 50.0
    with pytest.raises(ValueError):
        at.save(bus.limit(0), "bus_none")
        at.load(spark, "bus_none", sources.SCHEMAS["bus"])


def test_parquet_takes_a_declared_schema(spark, tmp_path):
    _bus(spark, 4).write.parquet(f"{tmp_path}/x.parquet")
    assert sources.scan(spark, f"{tmp_path}/x.parquet", "parquet", "bus_id int, voltage_pu double").columns == ["bus_id", "voltage_pu"]
    with pytest.raises(ValueError):
        sources.scan(spark, "x.csv", "csv")


def test_splits_read_only_their_files_and_are_aligned(spark, tmp_path):
    at, parts = sources.Catalog(str(tmp_path)), split.temporal_split(_bus(spark), "timestamp")
    at.save(parts, "bus_split", ["split"])
    at.save(parts.withColumnRenamed("bus_id", "line_id"), "line_split", ["split"])
    both = at.load_splits(spark, ["bus_split", "line_split"], "test")
    assert {k: v.count() for k, v in both.items()} == {"bus_split": 60, "line_split": 60}
    assert "PartitionFilters: [isnotnull(split" in both["bus_split"]._jdf.queryExecution().toString()
    at.save(parts.where("timestamp <> timestamp '2026-01-01 23:45:00'"), "late_split", ["split"])
    with pytest.raises(ValueError, match="aligned"):
        at.load_splits(spark, ["bus_split", "late_split"], "test")


def test_models_and_selectors_survive_a_round_trip(spark, tmp_path):
    df = _bus(spark)
    for kind, model in ((scale.ScalerModel, scale.fit(df, "standard", ["voltage_pu"])), (forest.ForestModel, forest.fit(df, ["voltage_pu", "angle_deg"], ["timestamp", "bus_id"], trees=5))):
        sources.save_model(spark, model, f"{tmp_path}/{kind.__name__}")
        assert sources.load_model(spark, kind, f"{tmp_path}/{kind.__name__}").to_json() == model.to_json()
    with pytest.raises(TypeError):
        sources.load_model(spark, forest.ForestModel, f"{tmp_path}/ScalerModel")
    assert select.fit(df, ["voltage_pu", "angle_deg"]).features == ["voltage_pu", "angle_deg"]


def test_dataset_build(spark):
    bus = _bus(spark).withColumn("n", F.monotonically_increasing_id())
    out = plans.build_dataset(bus, "n", window=8, stride=4)
    assert out["issues"].isEmpty() and {r["split"]: r["count"] for r in out["split"].groupBy("split").count().collect()} == {"train": 171, "validation": 57, "test": 60}
    train = out["scaled"].where("split = 'train'").agg(F.avg("voltage_pu").alias("m"), F.stddev_pop("voltage_pu").alias("s")).first()
    assert train["m"] == pytest.approx(0, abs=1e-9) and train["s"] == pytest.approx(1)
    assert {k: out[f"windows_{k}"].count() for k in split.NAMES} == {"train": 3 * 13, "validation": 3 * 3, "test": 3 * 4}
    with pytest.raises(ValueError, match="validation"):
        plans.build_dataset(bus.union(bus.limit(1)), "n")


def test_features_and_detection(spark):
    bus = _bus(spark)
    odd = bus.withColumn("voltage_pu", F.when((F.col("bus_id") == 1) & (F.col("timestamp") == F.lit("2026-01-01 22:00:00").cast("timestamp_ntz")), 3.0).otherwise(F.col("voltage_pu")))
    features = plans.entity_features(odd, "bus_id", ["voltage_pu", "active_power_mw"], "bus", spectra=False)
    assert features.count() == bus.count() and features.columns.count("voltage_pu") == 1
    scored, fitted = plans.detect(features, ["timestamp", "bus_id"], trees=40)
    assert {r["split"] for r in scored.select("split").distinct().collect()} == set(split.NAMES) and scored.where("anomaly_score is null").isEmpty()
    worst = scored.where("split = 'test'").orderBy(F.col("anomaly_score").desc()).limit(3).collect()
    assert any(r["bus_id"] == 1 and r["timestamp"] >= datetime(2026, 1, 1, 22) for r in worst)
    assert scored.where(F.col("anomaly_score") >= fitted["threshold"]).count() == scored.where("prediction = 1").count() > 0
    summary = {r["split"]: r for r in plans.detection_summary(scored, fitted, "bus").collect()}
    assert summary["test"]["rows"] == 60 and summary["test"]["features"] == len(fitted["selector"].features) and summary["test"]["trees"] == 40
    listed = plans.selected_features(spark, fitted["selector"])
    assert [r["feature"] for r in listed.where("place is not null").orderBy("place").collect()] == fitted["selector"].features
    assert listed.where("removed_by is not null").count() == sum(map(len, fitted["selector"].removed.values()))
    assert summary["validation"]["anomalies"] == pytest.approx(57 * 0.05, abs=1.5)


def test_streams_give_the_rows_of_the_batch(spark, tmp_path):
    bus = _bus(spark, 12)
    bus.write.parquet(f"{tmp_path}/in")
    model = forest.fit(bus, ["voltage_pu", "angle_deg"], ["timestamp", "bus_id"], trees=5)
    steps = [electrical.bus_features, lambda df: scale.fit(bus, "minmax", ["angle_deg"]).transform(df), model.score]
    stream = streaming.apply(spark, f"{tmp_path}/in", sources.SCHEMAS["bus"], steps)
    query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination(120)
    want = bus
    for step in steps:
        want = step(want)
    got = spark.read.parquet(f"{tmp_path}/out").select(*want.columns)
    assert got.count() == 36 and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    with pytest.raises(ValueError):
        streaming.apply(spark, f"{tmp_path}/in", sources.SCHEMAS["bus"], [lambda df: bus])


def test_validation_of_faults(spark):
    bus = _bus(spark, 8).withColumn("n", F.monotonically_increasing_id())
    rules = quality.Rules("timestamp", "bus_id", quality.BUS_RULES.numeric, quality.BUS_RULES.ranges, "n")
    late = bus.withColumn("timestamp", F.when(F.col("n") == bus.agg(F.max("n")).first()[0], F.lit("2025-01-01").cast("timestamp_ntz")).otherwise(F.col("timestamp")))
    found = {r["category"]: r["count"] for r in quality.validate(late, rules).collect()}
    assert found == {"timestamp_order": 1}


def test_no_local_folder_on_a_cluster(monkeypatch):
    from voltlake import session

    class Context:
        master, applicationId = "spark://somewhere", "app"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError, match="checkpoint"):
        session.shared_dir(Session())
    Context.getCheckpointDir = lambda self: "hdfs://x/y/"
    assert session.shared_dir(Session()) == "hdfs://x/y"
