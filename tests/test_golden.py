"""Fixed expectations: published feature values of the 33-bus network, hand fixtures, invariants."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voltlake.operators import clean, forest, fuse, generate, graph, inject, labels, quality, rolling, scale, select, spectral, split, windows

#: The benchmark network's lines.
LINES = [(i, i + 1) for i in range(17)] + [(1, 18), (18, 19), (19, 20), (20, 21), (2, 22), (22, 23), (23, 24), (5, 25)] + [(i, i + 1) for i in range(25, 32)] + [(20, 7), (8, 14), (11, 21), (17, 32), (24, 28)]


def test_centralities_of_the_benchmark_network(spark):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(LINES)], "line_id int, from_bus int, to_bus int")
    g = graph.edges(df, ("from_bus", "to_bus"))
    node = {r["node"]: r for r in graph.node_features(g).collect()}
    names = ("betweenness_centrality", "closeness_centrality", "eigenvector_centrality", "pagerank")
    assert [node[0][c] for c in names] == pytest.approx([0.0, 0.1711229946524064, 0.04492358308338522, 0.016280866353495422], rel=1e-6)
    assert [node[1][c] for c in names] == pytest.approx([0.167002688172043, 0.20512820512820512, 0.10976760835637119, 0.041417951292413505], rel=1e-6)
    assert (node[0]["node_degree"], node[1]["node_degree"]) == (1, 3)
    edge = {(r["src"], r["dst"]): r["edge_betweenness_centrality"] for r in graph.edge_features(g).collect()}
    assert edge[0, 1] == pytest.approx(0.06060606060606061) and edge[1, 2] == pytest.approx(0.15688131313131312)
    far = {r["node"]: r["closeness_centrality"] for r in graph.closeness(g).collect()}
    assert far[1] == pytest.approx(0.20512820512820512)
    assert {r["component"] for r in graph.connected_components(g).collect()} == {0}
    features = g.withColumn("x", F.lit(1))
    assert fuse.join_edge_features(df, features, canonical=False).where("x is null").count() == 1
    assert fuse.join_edge_features(df, features).where("x is null").count() == 0


def test_profiles(spark):
    noise = np.random.default_rng(42).normal(0, 0.03, 96)
    grid = spark.createDataFrame([(datetime(2026, 1, 1) + timedelta(minutes=15 * i), float(x)) for i, x in enumerate(noise)], "timestamp timestamp_ntz, e double")
    first = generate.profiles(grid, "e").orderBy("timestamp").first()
    assert first["load_pu"] == pytest.approx(0.6526248675948686, abs=1e-9) and first["solar_pu"] == 0.0


def test_split_of_a_day(spark):
    rows = generate.time_grid(spark, "2026-01-01 00:00:00", 96)
    out = {r["split"]: r for r in split.summarize(split.temporal_split(rows, "timestamp"), "timestamp").collect()}
    assert [out[s]["timestamps"] for s in split.NAMES] == [57, 19, 20]
    assert out["validation"]["first"] == datetime(2026, 1, 1, 14, 15) and out["test"]["first"] == datetime(2026, 1, 1, 19, 0)
    with pytest.raises(ValueError):
        split.temporal_split(rows.limit(2), "timestamp")


def test_rolling_moments_with_gaps(spark):
    x = [1.0, 1.0, 1.0, 1.0, 1.0, 2.0, 5.0, None, 3.0]
    df = spark.createDataFrame(list(enumerate(x)), "i int, x double")
    out = rolling.rolling_statistics(df, ["x"], ["i"]).orderBy("i").collect()
    skew, kurt = [r["x_rolling_skewness"] for r in out], [r["x_rolling_kurtosis"] for r in out]
    assert skew[:2] == [None, None] and skew[2:] == pytest.approx([0, 0, 0, 2, 1.658524, 1.293343, 0.935220], abs=1e-6)
    assert [k is None for k in kurt] == [True] * 3 + [False] * 4 + [True] * 2 and kurt[3:7] == pytest.approx([-3, -3, 4, 2.615468], abs=1e-6)


def test_interpolation_ends(spark):
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate([None, 2.0, None, None, 8.0, None])], "e int, i int, x double")
    got = lambda s: [r["x"] for r in clean.interpolate(df, ["x"], ["e"], ["i"], s).orderBy("i").collect()]
    assert got("linear") == [2, 2, 4, 6, 8, 8] and got("forward_fill") == [None, 2, 2, 2, 8, 8]


def _day(spark):
    v = {0: (1.00, 10.0, 2.0), 1: (0.98, 20.0, 4.0), 2: (1.02, 15.0, 3.0)}
    rows = [(datetime(2026, 1, 1) + timedelta(minutes=15 * i), b, *v[b]) for i in range(10) for b in v]
    return spark.createDataFrame(rows, "timestamp timestamp_ntz, bus_id long, voltage_pu double, active_power_mw double, reactive_power_mvar double")


def test_injection_and_labels(spark):
    df, i = _day(spark), inject.Injector()
    out = i.voltage_deviation(df, 1, datetime(2026, 1, 1, 1, 0), 3, 0.1)
    low = out.where("bus_id = 1 and voltage_pu < 0.9").orderBy("timestamp").collect()
    assert [r["timestamp"].minute + 60 * r["timestamp"].hour for r in low] == [60, 75, 90] and low[0]["voltage_pu"] == pytest.approx(0.88)
    i.sensor_spike(df, 1, datetime(2026, 1, 1, 1, 15), 0.2)
    marked = labels.label(out, labels.check_events(i.ground_truth(spark)), "bus_id", "timestamp", "bus").where("is_anomaly = 1").orderBy("timestamp")
    assert [r["anomaly_event_id"] for r in marked.collect()] == [0, 1, 0]  # the later event wins
    summary = {r["anomaly_event_id"]: r["number_of_rows"] for r in labels.event_summary(marked, "bus_id", "timestamp").collect()}
    assert summary == {0: 2, 1: 1}


def test_scaling_round_trip_and_guard(spark):
    df = spark.createDataFrame([(float(i), 7.0) for i in range(9)], "a double, b double")
    for method in scale.METHODS:
        model, out = scale.fit_transform(df, method, ["a", "b"])
        assert model.scale["b"] == 1.0
        back = model.inverse_transform(out).orderBy("a").collect()
        assert [r["a"] for r in back] == pytest.approx(list(range(9)))
        assert scale.ScalerModel.from_json(model.to_json()) == model
    with pytest.raises(ValueError):
        scale.fit(df.union(spark.createDataFrame([(None, 1.0)], df.schema)), "standard", ["a"])


def test_correlation_chain_drops_both(spark):
    rng = np.random.default_rng(0)
    a = rng.normal(size=400)
    b = a + rng.normal(size=400) * 0.28
    c = b + rng.normal(size=400) * 0.28
    pdf = pd.DataFrame({"a": a, "b": b, "c": c, "flat": 1.0, "empty": np.nan})
    r = pdf.corr()
    assert r.loc["a", "b"] > 0.95 and r.loc["b", "c"] > 0.95 and r.loc["a", "c"] < 0.95
    model = select.fit(spark.createDataFrame(pdf), ["a", "b", "c", "flat", "empty"])
    assert model.features == ["a"] and model.removed == {"missing": ["empty"], "variance": ["flat"], "correlation": ["b", "c"]}


def test_windows_and_empty(spark):
    df = _day(spark)
    out = windows.sliding_windows(df, ["voltage_pu"], "bus_id", "timestamp", 4, 2)
    assert out.count() == 3 * ((10 - 4) // 2 + 1)
    assert windows.sliding_windows(df, ["voltage_pu"], "bus_id", "timestamp", 60).count() == 0


def test_spectra_agree(spark):
    rng = np.random.default_rng(1)
    x = np.sin(np.arange(48) / 3) + rng.normal(size=48) * 0.1
    df = spark.createDataFrame([(datetime(2026, 1, 1) + timedelta(minutes=15 * i), float(v)) for i, v in enumerate(x)], "t timestamp_ntz, value double")
    declared = spectral.series_features(df, "value", "t", 900.0).first()
    direct = spectral.window_features(x, 900.0)
    assert list(declared) == pytest.approx(list(direct), rel=1e-9)


def test_validation(spark):
    df = _day(spark).withColumn("n", F.monotonically_increasing_id())
    rules = quality.Rules("timestamp", "bus_id", ("voltage_pu",), {"voltage_pu": (0.0, 1.0)}, "n")
    found = {(r["category"], r["count"]) for r in quality.validate(df.union(df.limit(1)), rules).collect()}
    assert ("duplicate", 2) in found and ("range", 10) in found
    assert quality.validate(df.limit(0), rules).first()["category"] == "structure"


def test_forest_finds_the_odd(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame(rng.normal(size=(500, 2)), columns=["a", "b"]).assign(i=range(500))
    pdf.loc[499, ["a", "b"]] = 12.0
    df = spark.createDataFrame(pdf)
    model = forest.fit(df, ["a", "b"], ["i"], trees=50)
    assert model.score(df).orderBy(F.col("anomaly_score").desc()).first()["i"] == 499
    again = forest.ForestModel.from_json(model.to_json())
    assert np.allclose(again.score_array(pdf[["a", "b"]].to_numpy()), model.score_array(pdf[["a", "b"]].to_numpy()))
