"""Hot values, outliers, text orders and long events: the same results as the plain definition."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voltlake.operators import correlation, forest, labels, spectral
from voltlake.operators.ordered import over_order


def test_spearman_with_hot_values_and_an_outlier(spark):
    rng = np.random.default_rng(0)
    a = np.where(rng.random(3000) < 0.5, 7.0, rng.normal(size=3000))
    pdf = pd.DataFrame({"a": a, "b": a**3 + rng.normal(size=3000), "c": np.where(rng.random(3000) < 0.1, np.nan, rng.integers(0, 3, 3000).astype(float))})
    pdf.loc[0, "b"] = 1e300
    want = pdf.rank().corr()
    for ranges in (256, 3):
        got = {(r["feature_1"], r["feature_2"]): r["r"] for r in correlation.spearman(spark.createDataFrame(pdf), ["a", "b", "c"], ranges).collect()}
        assert len(got) == 6 and all(got[k] == pytest.approx(want.loc[k], abs=1e-9) for k in got)


@pytest.mark.parametrize("block", [256, 4, 1])
def test_entity_correlation_in_blocks(spark, block):
    rng = np.random.default_rng(1)
    rows = [(t, f"e{e:02}", float(rng.normal() * 10 + 1e6)) for t in range(30) for e in range(11) if rng.random() < 0.7] + [(t, "flat", 5.0) for t in range(30)] + [(99, "alone", 1.0), (3, "null", None)]
    pdf = pd.DataFrame(rows, columns=["t", "e", "x"])
    wide = pdf.pivot_table(index="t", columns="e", values="x", aggfunc="mean", dropna=False)
    want = wide.corr(min_periods=2)
    got = {(r["entity_1"], r["entity_2"]): r["r"] for r in correlation.entity_correlation(spark.createDataFrame(rows, "t int, e string, x double"), "e", "t", "x", block).collect()}
    met = pdf.assign(n=1).pivot_table(index="t", columns="e", values="n", aggfunc="max", fill_value=0)
    pairs = {(a, b) for a in met for b in met if a <= b and (met[a] * met[b]).sum()}
    assert got.keys() == pairs
    for a, b in pairs:
        w = want.loc[a, b] if a in want and b in want else np.nan
        assert got[a, b] is None if np.isnan(w) or "flat" in (a, b) else got[a, b] == pytest.approx(w, abs=1e-6)


def test_labels_of_an_entity_with_many_and_long_events(spark):
    start = datetime(2026, 1, 1)
    rng = np.random.default_rng(2)
    events = [(i, "x", "bus", 1, start + timedelta(minutes=int(a)), start + timedelta(minutes=int(a + b)), float(i), "v") for i, (a, b) in enumerate(zip(rng.integers(0, 50_000, 3000), rng.integers(0, 30, 3000)))]
    events += [(5000, "x", "bus", 1, start, start + timedelta(days=20), 1.0, "v"), (5001, "x", "bus", 1, start + timedelta(days=9), start + timedelta(days=9), 2.0, "v"), (1, "x", "line", 1, start, start + timedelta(days=90), 1.0, "v"), (5002, "x", "bus", 2, start, start + timedelta(days=300), 3.0, "v")]
    frame = spark.createDataFrame(events, "event_id int, anomaly_type string, entity_type string, entity_id long, start_timestamp timestamp_ntz, end_timestamp timestamp_ntz, severity double, affected_measurement string")
    rows = [(b, start + timedelta(minutes=int(m))) for b in (1, 2, 3) for m in range(0, 50_100, 97)] + [(1, None), (None, start)]
    out = labels.label(spark.createDataFrame(rows, "bus_id long, t timestamp_ntz"), frame, "bus_id", "t", "bus").collect()
    assert len(out) == len(rows)
    for r in out:
        own = [e[0] for e in events if e[2] == "bus" and e[3] == r["bus_id"] and r["t"] is not None and e[4] <= r["t"] <= e[5]]
        assert r["anomaly_event_id"] == (max(own) if own else -1) and r["is_anomaly"] == bool(own)
    assert labels.label(spark.createDataFrame(rows, "bus_id long, t timestamp_ntz"), frame.limit(0), "bus_id", "t").where("is_anomaly = 1").isEmpty()


def test_order_by_text_and_hot_first_column(spark):
    rng = np.random.default_rng(3)
    rows = [("hot" if i % 3 else f"n{i:04}", int(rng.integers(0, 50)), i) for i in range(600)] + [(None, None, 600 + i) for i in range(40)]
    df = spark.createDataFrame(rows, "name string, t int, i long").repartition(6)
    shifted = lambda x, by: x.withColumn("back", F.lag("i", 2).over(by))
    order = ["name", "t", "i"]
    want = sorted(map(str, over_order(df, order, 2, shifted).collect()))
    assert sorted(map(str, over_order(df, order, 2, shifted, block_rows=23).collect())) == want


def test_transform_of_a_long_series(spark):
    n = 20_000
    x = np.sin(np.arange(n) / 7) + np.arange(n) % 3
    df = spark.createDataFrame(pd.DataFrame({"t": np.arange(n)[::-1], "v": x[::-1]}))
    for hann in (False, True):
        got = spectral.dft(df, "v", "t", hann).orderBy("k").toPandas()
        want = np.fft.rfft((x - x.mean()) * (np.hanning(n) if hann else 1.0))
        assert np.allclose(got["re"], want.real, atol=1e-6) and np.allclose(got["im"], want.imag, atol=1e-6) and (got["n"] == n).all()
    assert spectral.dft(df.limit(0), "v", "t").count() == 0


def test_windows_of_many_lengths_at_once():
    rng = np.random.default_rng(4)
    windows = [rng.normal(size=n) for n in (3, 4, 9, 32, 9, 96, 32)] + [np.full(8, 2.0)]
    intervals = np.array([900.0, 900, 60, 900, 900, 1, 0, 900])
    got = spectral.features_of(windows, intervals)
    for w, i, row in zip(windows, intervals, got):
        one = spectral.window_features(w, i)
        assert np.isnan(row).all() if one is None else row == pytest.approx(one)
    assert [bool(np.isnan(r[0])) for r in got] == [True, False, False, False, False, False, True, True]


def test_forest_against_walking_each_tree():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 3))
    trees = [forest._tree(x[rng.choice(1500, 64, replace=False)], rng, 6) for _ in range(20)] + [forest._tree(np.zeros((1, 3)), rng, 6)]
    model = forest.ForestModel(["a", "b", "c"], trees, 64)

    def depth(t, row):
        at = 0
        while t["feature"][at] >= 0:
            at = t["left"][at] if row[t["feature"][at]] <= t["cut"][at] else t["right"][at]
        return t["depth"][at]

    some = [*range(0, 1500, 37), 1499]
    want = [2 ** (-np.mean([depth(t, x[i]) for t in trees]) / float(forest.path_length(64))) - 0.5 for i in some]
    assert model.score_array(x)[some] == pytest.approx(want)
