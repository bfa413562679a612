"""The benchmark feeder: power flow, tables, and the scripted evening against the published events."""

from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltlake.operators import dimensionality, generate, inject, labels


def _at(spark, loads):
    rows = [(datetime(2026, 1, 1, i), float(x), 0.0) for i, x in enumerate(loads)]
    return spark.createDataFrame(rows, "timestamp timestamp_ntz, load_pu double, solar_pu double")


def test_base_case(spark):
    """Published results of the feeder's base case: losses of 202.7 kW and 0.9131 pu at the end of the long branch."""
    net = generate.benchmark_network()
    bus, line = generate.power_flow(_at(spark, [1.0]), net)
    v = {r["bus_id"]: r for r in bus.collect()}
    assert v[17]["voltage_pu"] == pytest.approx(0.9131, abs=1e-4) == min(r["voltage_pu"] for r in v.values())
    assert -v[0]["active_power_mw"] - net.summary()["load_mw"] == pytest.approx(0.2027, abs=2e-4)
    assert net.summary() | {"load_mw": 0, "load_mvar": 0} == {"buses": 33, "lines": 37, "lines_in_service": 32, "loads": 32, "load_mw": 0, "load_mvar": 0}
    flows = {r["line_id"]: r["current_from_ka"] for r in line.collect()}
    assert len(flows) == 37 and all(flows[i] == 0 for i in range(32, 37)) and flows[0] == max(flows.values())


def test_meshed_network_keeps_kirchhoff(spark):
    """All ties closed: the currents at each bus add up to its load."""
    net = generate.benchmark_network()
    net = generate.Network(net.lines, net.loads)
    bus, _ = generate.power_flow(_at(spark, [1.0]), net)
    rows = {r["bus_id"]: r for r in bus.collect()}
    v = {b: r["voltage_pu"] * np.exp(1j * np.radians(r["angle_deg"])) for b, r in rows.items()}
    assert min(map(abs, v.values())) > 0.93
    for b, r in rows.items():
        drawn = sum((v[b] - v[o]) * net.kv**2 / complex(x[3], x[4]) for x in net.lines for a, o in ((x[1], x[2]), (x[2], x[1])) if a == b)
        assert v[b] * np.conj(-drawn) == pytest.approx(complex(r["active_power_mw"], r["reactive_power_mvar"]), abs=1e-7)


def test_no_solution(spark):
    net, profile = generate.benchmark_network(), _at(spark, [1.0, 40.0, 0.5])
    with pytest.raises(Exception, match="no power flow at 2026-01-01 01:00:00"):
        generate.power_flow(profile, net)[0].collect()
    bus, line = generate.power_flow(profile, net, strict=False)
    for df in (bus, line):
        assert {r["timestamp"].hour for r in df.where(F.col(df.columns[2]).isNull()).collect()} == {1}


def test_network_tables(spark, tmp_path):
    net = generate.benchmark_network().with_solar(17, 0.5)
    net.save(spark, str(tmp_path / "net"))
    again = generate.Network.load(spark, str(tmp_path / "net"))
    assert again == net
    with pytest.raises(ValueError):
        net.with_solar(99, 0.5)
    with pytest.raises(ValueError):
        generate.Network(net.lines, net.loads, out=frozenset([0])).validate()


def test_scenario_is_as_published(spark):
    profile = generate.profiles(generate.time_grid(spark, "2026-01-01 00:00:00", 96))
    bus, line = generate.power_flow(profile, generate.benchmark_network().with_solar(17, 0.5))
    changed_bus, changed_line, events = inject.scenario(bus, line, datetime(2026, 1, 1))
    at = lambda h, m: datetime(2026, 1, 1, h, m)
    want = [
        (0, "voltage_deviation", "bus", 17, at(19, 0), at(19, 45), 0.1, "voltage_pu"), (1, "power_spike", "bus", 14, at(20, 0), at(20, 30), 0.5, "active_power_mw"), (2, "sensor_spike", "bus", 29, at(21, 0), at(21, 0), 0.2, "voltage_pu"),
        (3, "line_overload", "line", 1, at(19, 30), at(20, 15), 0.5, "loading_percent"), (4, "line_overload", "line", 5, at(22, 0), at(22, 30), 0.4, "loading_percent"),
    ]
    for got, expected in zip(events.orderBy("event_id").collect(), want, strict=True):
        assert tuple(got)[:6] == expected[:6] and got["severity"] == pytest.approx(expected[6]) and got["affected_measurement"] == expected[7]
    both = bus.alias("o").join(changed_bus.alias("c"), ["timestamp", "bus_id"]).where("o.voltage_pu <> c.voltage_pu or o.active_power_mw <> c.active_power_mw")
    assert both.count() == 4 + 3 + 1
    marked = labels.label(changed_line, labels.check_events(events), "line_id", "timestamp", "line").where("is_anomaly = 1")
    assert marked.groupBy("anomaly_event_id").count().orderBy("anomaly_event_id").collect() == [(3, 4), (4, 3)]


def test_principal_components_by_population_spread(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(10, 3)) @ rng.normal(size=(3, 3))
    df = spark.createDataFrame([(i, *map(float, r), 5.0) for i, r in enumerate(x)], "i long, a double, b double, c double, flat double")
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    _, s, vt = np.linalg.svd(z, full_matrices=False)
    got = np.array([r["scores"][:3] for r in dimensionality.scores(df, ["a", "b", "c", "flat"], ["i"]).orderBy("i").collect()])
    assert np.abs(got) == pytest.approx(np.abs(z @ vt.T), abs=1e-9)
    assert [r[1] for r in dimensionality.explained(df, ["a", "b", "c"]).collect()] == pytest.approx(list(s**2 / (s**2).sum()))
    with pytest.raises(ValueError):
        dimensionality.explained(df.limit(0), ["a"])
