"""Queries and operators do the whole job, not a part of it."""

from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from voltlake import queries
from voltlake.operators import correlation, forest, graph, spectral

DIR = Path("/root/testdata/sf0.001")
needs_tables = pytest.mark.skipif(not DIR.exists(), reason="no test tables")


@needs_tables
def test_correlation_between_all_users(spark):
    events = pd.read_parquet(DIR / "events.parquet", columns=["user_id", "ts", "value"])
    wide = events.assign(t=events["ts"].dt.floor("D")).pivot_table(index="t", columns="user_id", values="value", aggfunc="mean")
    want = wide.corr(min_periods=2)
    got = {(r["entity_1"], r["entity_2"]): r["r"] for r in queries.QUERIES["entity_correlation_users"](spark, str(DIR)).collect()}
    together = wide.notna().astype(int)
    together = together.T @ together
    pairs = [(a, b) for a in want for b in want if a <= b and together.loc[a, b]]
    assert len(want) > 10 and got.keys() == set(pairs)
    for a, b in pairs:
        assert got[a, b] is None if np.isnan(want.loc[a, b]) else got[a, b] == pytest.approx(want.loc[a, b], abs=1e-5)


def test_correlation_deals_no_cell_to_each_block(spark):
    def written():
        context, gateway = spark.sparkContext._jsc.sc(), spark.sparkContext._gateway
        context.listenerBus().waitUntilEmpty()
        none = gateway.jvm.java.util.ArrayList()
        stages = context.statusStore().stageList(none, False, False, gateway.new_array(gateway.jvm.double, 0), none)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    n, times = 300, 12
    df = spark.range(n * times).selectExpr("id % 300 as e", "id div 300 as t", "sin(id) as x")
    before = written()
    assert correlation.entity_correlation(df, "e", "t", "x", 8).count() == n * (n + 1) // 2
    assert written() - before < 4 * n * times


def test_correlation_without_a_time_or_entity_in_common(spark):
    rows = [(1, "a", 1.0), (2, "a", 2.0), (2, "b", 4.0), (3, "b", 3.0), (4, "c", 5.0), (None, "a", 9.0), (None, "c", 9.0), (1, None, 9.0)]
    for block in (256, 1):
        got = correlation.entity_correlation(spark.createDataFrame(rows, "t int, e string, x double"), "e", "t", "x", block).collect()
        assert sorted((r["entity_1"], r["entity_2"], r["r"] and round(r["r"], 9)) for r in got) == [("a", "a", 1.0), ("a", "b", None), ("b", "b", 1.0), ("c", "c", None)]


def test_correlation_of_series_longer_than_a_matrix(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3, 50)) + 100
    df = spark.createDataFrame([(t, e, float(x[e, t])) for e in range(3) for t in range(50)], "t int, e int, x double")
    monkeypatch.setattr(correlation, "MATRIX_TIMES", 7)
    pack = correlation._packed(df.toArrow().append_column("b", [[0] * 150]))["cells"][0].as_buffer()
    cells = pa.ipc.open_stream(pack).read_all()
    times = cells["t"].combine_chunks().dictionary
    a = correlation._Pack(cells, times)
    r, met = correlation._correlations(a, a, range(3), range(3), len(times))
    assert met.all() and r == pytest.approx(np.corrcoef(x))


def _path(spark, names):
    return graph.edges(spark.createDataFrame([(int(a), int(b)) for a, b in zip(names, names[1:])], "a long, b long"), ("a", "b"))


@pytest.mark.parametrize("kind", ["from both ends", "random"])
def test_components_of_long_feeders(spark, kind):
    n = 200
    names = np.random.default_rng(1).permutation(n).tolist() if kind == "random" else [*range(0, n, 2), *range(n - 1, 0, -2)]
    other = graph.edges(spark.createDataFrame([(1000, 1001)], "a long, b long"), ("a", "b"))
    got = {r["node"]: r["component"] for r in graph.connected_components(_path(spark, names).union(other)).collect()}
    assert got == {**{i: 0 for i in range(n)}, 1000: 1000, 1001: 1000}


def test_closeness_beyond_64_hops(spark):
    n = 70
    got = {r["node"]: r["closeness_centrality"] for r in graph.closeness(_path(spark, list(range(n)))).collect()}
    assert got == pytest.approx({i: (n - 1) / sum(abs(i - j) for j in range(n)) for i in range(n)})


def test_centralities_on_executors(spark, monkeypatch):
    g = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (3, 0), (2, 4), (5, 6)], "src long, dst long")
    read = lambda: (sorted(map(tuple, graph.node_features(g).collect())), sorted(map(tuple, graph.edge_features(g).collect())))
    want = read()
    monkeypatch.setattr(graph, "DRIVER_EDGES", 3)
    for a, b in zip(read(), want):
        assert len(a) == len(b) and all(x == pytest.approx(y) for x, y in zip(a, b))


@pytest.mark.skipif(not (DIR.parent / "sf0.1").exists(), reason="no test tables")
def test_tsne_keeps_all_suppliers(spark):
    out = queries.QUERIES["tsne_embedding"](spark, str(DIR.parent / "sf0.1")).toPandas()
    want = pd.read_parquet(DIR.parent / "sf0.1" / "supplier.parquet", columns=["s_suppkey"])
    assert sorted(out["s_suppkey"]) == sorted(want["s_suppkey"]) and len(out) == 1000
    assert np.isfinite(out[["x", "y"]].to_numpy()).all()


@needs_tables
def test_forest_and_spectra_at_the_operators_sizes(spark, monkeypatch):
    used, fit = [], forest.fit
    monkeypatch.setattr(forest, "fit", lambda *a, **k: used.append(fit(*a, **k)) or used[-1])
    assert queries.QUERIES["isolation_forest_scores"](spark, str(DIR)).where("anomaly_score is null").isEmpty()
    assert len(used[0].trees) == 300
    events = pd.read_parquet(DIR / "events.parquet", columns=["event_id", "user_id", "ts", "value"]).sort_values(["user_id", "ts"])
    few = set(events[events.groupby("user_id").cumcount() < spectral.SpectralConfig().min_periods - 1]["event_id"])
    out = queries.QUERIES["rolling_spectral_features"](spark, str(DIR)).toPandas().set_index("event_id")
    found = out.notna().any(axis=1)
    assert 8 < len(few) < len(out) == len(events) and not found[list(few)].any() and found.any()
