"""Generated inputs: time grids, load and solar profiles, networks and simulated measurements."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import require_columns
from ..session import ship


def time_grid(spark: SparkSession, start: str, periods: int, minutes: int = 15) -> DataFrame:
    return spark.range(periods).select((F.lit(start).cast("timestamp_ntz") + F.make_dt_interval(mins=(F.col("id") * minutes).cast("int"))).alias("timestamp"))


def _hours(t: Column) -> Column:
    return F.hour(t) + F.minute(t) / 60.0


def load_profile(grid: DataFrame, base_mw: float = 1.0, noise: str | None = None) -> DataFrame:
    """load_pu: daily peaks at 8, 13 and 19 over a base, noise from a column, at least 0.1, divided by its maximum."""
    h = _hours(F.col("timestamp"))
    bump = lambda size, at, width: size * F.exp(-0.5 * ((h - at) / width) * ((h - at) / width))
    raw = F.greatest(0.72 + bump(0.20, 8.0, 2.0) + bump(0.35, 19.0, 3.0) + bump(0.08, 13.0, 4.0) + (F.col(noise) if noise else 0.0), F.lit(0.1))
    rows = grid.withColumn("__raw", raw)
    top = rows.agg(F.max("__raw").alias("__top"))
    rows = rows.crossJoin(F.broadcast(top)).withColumn("load_pu", F.col("__raw") / F.col("__top"))  # one row beside
    return rows.select("timestamp", (F.col("load_pu") * base_mw).alias("load_mw"), "load_pu")


def solar_profile(grid: DataFrame, rated_mw: float = 1.0, noise: str | None = None) -> DataFrame:
    """solar_pu: a half sine from 6 to 18, to the power 1.5; noise by day only; from 0 to 1."""
    h = _hours(F.col("timestamp"))
    day = (h >= 6.0) & (h <= 18.0)
    sun = F.pow(F.greatest(F.sin(math.pi * (h - 6.0) / 12.0), F.lit(0.0)), F.lit(1.5))
    pu = F.when(day, F.greatest(F.lit(0.0), F.least(F.lit(1.0), sun + (F.col(noise) if noise else 0.0)))).otherwise(0.0)
    return grid.select("timestamp", (pu * rated_mw).alias("solar_mw"), pu.alias("solar_pu"))


def profiles(grid: DataFrame, load_noise: str | None = None, solar_noise: str | None = None) -> DataFrame:
    return load_profile(grid, noise=load_noise).join(solar_profile(grid, noise=solar_noise), "timestamp")


def check_profiles(df: DataFrame) -> DataFrame:
    """The profiles, if columns, rows and times are right."""
    require_columns(df, ["timestamp", "load_pu", "solar_pu"])
    n, distinct = df.agg(F.count("*"), F.countDistinct("timestamp")).first()
    if not n or n != distinct:
        raise ValueError("profiles are empty or repeat a timestamp")
    return df


def scaled_loads(loads: DataFrame, profile: DataFrame) -> DataFrame:
    """(timestamp, bus_id, p_mw, q_mvar): each load's base at each time. The rows asked for are this product; the smaller side
    is sent to the other only if it is small."""
    return profile.select("timestamp", "load_pu").crossJoin(loads).select(
        "timestamp", "bus_id", (F.col("p_mw") * F.col("load_pu")).alias("p_mw"), (F.col("q_mvar") * F.col("load_pu")).alias("q_mvar"))


def collect_results(wide: DataFrame, ids: list[int], names: dict[str, str], entity: str) -> DataFrame:
    """Wide results (prefix_id columns) as long rows: names maps a prefix to a column."""
    rows = F.array(*(F.struct(F.lit(i).alias(entity), *(F.col(f"{p}_{i}").alias(c) for p, c in names.items())) for i in ids))
    return wide.select("timestamp", F.explode(rows).alias("r")).select("timestamp", "r.*")


@dataclass(frozen=True)
class Network:
    """Lines (line_id, from_bus, to_bus, r_ohm, x_ohm, max_ka), base loads by bus, the slack bus `root`, the solar bus, and
    the ids of lines that are out of service. Radial or meshed."""

    lines: list[tuple[int, int, int, float, float, float]]
    loads: dict[int, tuple[float, float]]
    root: int = 0
    kv: float = 12.66
    solar_bus: int | None = None
    solar_mw: float = 0.0
    out: frozenset[int] = frozenset()

    @property
    def buses(self) -> list[int]:
        return sorted({b for x in self.lines for b in x[1:3]})

    @property
    def in_service(self) -> list[tuple[int, int, int, float, float, float]]:
        return [x for x in self.lines if x[0] not in self.out]

    def validate(self) -> None:
        """Ends, loads and the solar bus are buses, line ids don't repeat, and the lines in service connect all buses."""
        buses = set(self.buses)
        if not self.lines or self.root not in buses or not set(self.loads) <= buses or (self.solar_bus is not None and self.solar_bus not in buses):
            raise ValueError("a load, the solar bus or the root is not a bus")
        if len({x[0] for x in self.lines}) != len(self.lines):
            raise ValueError("a line id is repeated")
        seen, near = {self.root}, {b: [] for b in buses}
        for x in self.in_service:
            near[x[1]].append(x[2])
            near[x[2]].append(x[1])
        left = [self.root]
        while left:
            new = [b for b in near[left.pop()] if b not in seen]
            seen.update(new)
            left += new
        if seen != buses:
            raise ValueError("the network isn't connected")

    def summary(self) -> dict[str, float]:
        return {"buses": len(self.buses), "lines": len(self.lines), "lines_in_service": len(self.in_service), "loads": len(self.loads), "load_mw": sum(p for p, _ in self.loads.values()), "load_mvar": sum(q for _, q in self.loads.values())}

    def with_solar(self, bus: int, mw: float) -> Network:
        if bus not in self.buses:
            raise ValueError("the solar bus is not a bus")
        return replace(self, solar_bus=bus, solar_mw=mw)

    def tables(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        """(nodes, edges)."""
        nodes = [(b, *map(float, self.loads.get(b, (0.0, 0.0))), b == self.root, float(self.kv), self.solar_mw if b == self.solar_bus else None) for b in self.buses]
        edges = [(x[0], x[1], x[2], *map(float, x[3:]), x[0] not in self.out) for x in self.lines]
        return spark.createDataFrame(nodes, NODE_SCHEMA), spark.createDataFrame(edges, EDGE_SCHEMA)

    @staticmethod
    def from_tables(nodes: DataFrame, edges: DataFrame) -> Network:
        """A network is small: its tables come to the driver."""
        n, e = nodes.collect(), sorted(edges.collect(), key=lambda r: r["line_id"])
        solar = next((r for r in n if r["solar_mw"] is not None), None)
        lines = [(r["line_id"], r["from_bus"], r["to_bus"], r["r_ohm"], r["x_ohm"], r["max_ka"]) for r in e]
        loads = {r["bus_id"]: (r["p_mw"], r["q_mvar"]) for r in sorted(n) if r["p_mw"] or r["q_mvar"]}
        return Network(lines, loads, next(r["bus_id"] for r in n if r["is_root"]), n[0]["kv"], solar and solar["bus_id"], solar["solar_mw"] if solar else 0.0, frozenset(r["line_id"] for r in e if not r["in_service"]))

    def save(self, spark: SparkSession, path: str) -> None:
        for name, table in zip(("nodes", "edges"), self.tables(spark)):
            table.coalesce(1).write.mode("overwrite").parquet(f"{path}/{name}")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Network:
        return Network.from_tables(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"))


NODE_SCHEMA = "bus_id int, p_mw double, q_mvar double, is_root boolean, kv double, solar_mw double"
EDGE_SCHEMA = "line_id int, from_bus int, to_bus int, r_ohm double, x_ohm double, max_ka double, in_service boolean"

#: The 33-bus distribution feeder of Baran and Wu (1989), 12.66 kV, buses from 0: (from, to, r, x) in ohm of each
#: line, the last five of them normally open, and the load (kW, kvar) of buses 1 to 32.
FEEDER_LINES = (
    (0, 1, 0.0922, 0.0470), (1, 2, 0.4930, 0.2511), (2, 3, 0.3660, 0.1864), (3, 4, 0.3811, 0.1941), (4, 5, 0.8190, 0.7070), (5, 6, 0.1872, 0.6188), (6, 7, 0.7114, 0.2351), (7, 8, 1.0300, 0.7400),
    (8, 9, 1.0440, 0.7400), (9, 10, 0.1966, 0.0650), (10, 11, 0.3744, 0.1238), (11, 12, 1.4680, 1.1550), (12, 13, 0.5416, 0.7129), (13, 14, 0.5910, 0.5260), (14, 15, 0.7463, 0.5450), (15, 16, 1.2890, 1.7210),
    (16, 17, 0.7320, 0.5740), (1, 18, 0.1640, 0.1565), (18, 19, 1.5042, 1.3554), (19, 20, 0.4095, 0.4784), (20, 21, 0.7089, 0.9373), (2, 22, 0.4512, 0.3083), (22, 23, 0.8980, 0.7091), (23, 24, 0.8960, 0.7011),
    (5, 25, 0.2030, 0.1034), (25, 26, 0.2842, 0.1447), (26, 27, 1.0590, 0.9337), (27, 28, 0.8042, 0.7006), (28, 29, 0.5075, 0.2585), (29, 30, 0.9744, 0.9630), (30, 31, 0.3105, 0.3619), (31, 32, 0.3410, 0.5302),
    (20, 7, 2.0, 2.0), (8, 14, 2.0, 2.0), (11, 21, 2.0, 2.0), (17, 32, 0.5, 0.5), (24, 28, 0.5, 0.5),
)
FEEDER_LOADS = (
    (100, 60), (90, 40), (120, 80), (60, 30), (60, 20), (200, 100), (200, 100), (60, 20), (60, 20), (45, 30), (60, 35), (60, 35), (120, 80), (60, 10), (60, 20), (60, 20),
    (90, 40), (90, 40), (90, 40), (90, 40), (90, 40), (90, 50), (420, 200), (420, 200), (60, 25), (60, 25), (60, 20), (120, 70), (200, 600), (150, 70), (210, 100), (60, 40),
)


def benchmark_network(max_ka: float = 99_999.0) -> Network:
    """The 33-bus feeder, 37 lines with 32 of them in service; the feeder's lines have no rating."""
    lines = [(i, a, b, r, x, max_ka) for i, (a, b, r, x) in enumerate(FEEDER_LINES)]
    return Network(lines, {i + 1: (p / 1000, q / 1000) for i, (p, q) in enumerate(FEEDER_LOADS)}, out=frozenset(range(32, 37)))


def power_flow(profile: DataFrame, network: Network, rounds: int = 300, tolerance: float = 1e-10, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """(bus rows, line rows) of each time of the profile. Times are solved in batches where they are: the voltages of all buses
    from the currents that they draw, V = W - Z conj(S / V), until no voltage moves by `tolerance`. Where the load is beyond
    what the network can carry there is no solution: an error, or null results if not strict. A null or infinite profile
    value has none either. Lines out of service carry nothing; the slack bus has minus what it supplies."""
    network.validate()
    ship(profile.sparkSession)
    buses = network.buses
    at = {b: i for i, b in enumerate(buses)}
    root, rest = at[network.root], [i for i, b in enumerate(buses) if b != network.root]
    live = network.in_service
    y = {x[0]: network.kv**2 / complex(x[3], x[4]) for x in live}
    admit = np.zeros((len(buses), len(buses)), complex)
    for x in live:
        a, b = at[x[1]], at[x[2]]
        admit[[a, b], [a, b]] += y[x[0]]
        admit[[a, b], [b, a]] -= y[x[0]]
    z = np.linalg.inv(admit[np.ix_(rest, rest)])
    idle = -z @ admit[rest, root]
    base = np.array([complex(*network.loads.get(b, (0.0, 0.0))) for b in buses])

    def solve(load: np.ndarray, solar: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        s = load[:, None] * base[None, :]
        if network.solar_bus is not None:
            s[:, at[network.solar_bus]] -= solar * network.solar_mw
        v = np.ones_like(s)
        v[:, rest] = idle
        going = np.isfinite(load) & np.isfinite(solar)
        solved = np.zeros(len(load), bool)
        for _ in range(rounds):
            with np.errstate(all="ignore"):
                new = idle - np.conj(s[np.ix_(going, rest)] / v[np.ix_(going, rest)]) @ z.T
                moved = np.abs(new - v[np.ix_(going, rest)]).max(axis=1, initial=0.0)
            v[np.ix_(going, rest)] = new
            here = np.flatnonzero(going)
            solved[here[moved < tolerance]] = True
            going[here[~np.isfinite(moved) | (moved < tolerance)]] = False
            if not going.any():
                break
        v[~solved] = np.nan
        s[:, root] = -np.conj(((v @ admit.T)[:, root])) * v[:, root]
        s[~solved] = np.nan
        return v, s, solved

    def run(kind: str):
        def of(batches):
            for df in batches:
                v, s, solved = solve(df["load_pu"].to_numpy(float), df["solar_pu"].to_numpy(float))
                t = df["timestamp"]
                if strict and not solved.all():
                    raise ValueError(f"no power flow at {t[~solved].iloc[0]}")
                if kind == "bus":
                    for b in buses:
                        own = v[:, at[b]], s[:, at[b]]
                        yield pd.DataFrame({"timestamp": t, "bus_id": b, "voltage_pu": np.abs(own[0]), "angle_deg": np.degrees(np.angle(own[0])), "active_power_mw": own[1].real, "reactive_power_mvar": own[1].imag})
                else:
                    for x in network.lines:
                        current = np.abs((v[:, at[x[1]]] - v[:, at[x[2]]]) * y.get(x[0], 0.0))
                        ka = current / (math.sqrt(3) * network.kv)
                        yield pd.DataFrame({"timestamp": t, "line_id": x[0], "current_from_ka": ka, "current_to_ka": ka, "loading_percent": 100 * ka / x[5]})

        return of

    rows = profile.select("timestamp", "load_pu", "solar_pu")
    bus = rows.mapInPandas(run("bus"), "timestamp timestamp_ntz, bus_id int, voltage_pu double, angle_deg double, active_power_mw double, reactive_power_mvar double")
    line = rows.mapInPandas(run("line"), "timestamp timestamp_ntz, line_id int, current_from_ka double, current_to_ka double, loading_percent double")
    null = lambda df: df.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c, k in df.dtypes if k == "double"})
    return (bus, line) if strict else (null(bus), null(line))
