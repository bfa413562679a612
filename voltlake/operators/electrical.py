"""Row-wise electrical features of nodes (buses) and edges (lines): plain projections."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import flag, numeric, require_columns


@dataclass(frozen=True)
class Limits:
    nominal_voltage: float = 1.0
    voltage_min: float = 0.95
    voltage_max: float = 1.05
    thermal_percent: float = 100.0
    epsilon: float = 1e-8

    def __post_init__(self):
        if self.nominal_voltage <= 0 or self.voltage_min >= self.voltage_max or self.thermal_percent <= 0 or self.epsilon <= 0:
            raise ValueError("limits out of order")


def bus_features(df: DataFrame, limits: Limits = Limits(), voltage="voltage_pu", active="active_power_mw", reactive="reactive_power_mvar") -> DataFrame:
    require_columns(df, [voltage, active, reactive])
    v, p, q, m = numeric(voltage), numeric(active), numeric(reactive), limits
    s = F.sqrt(p * p + q * q)
    return df.withColumns({
        "voltage_deviation_pu": v - m.nominal_voltage, "absolute_voltage_deviation_pu": F.abs(v - m.nominal_voltage), "relative_voltage_deviation": (v - m.nominal_voltage) / m.nominal_voltage,
        "lower_voltage_margin_pu": v - m.voltage_min, "upper_voltage_margin_pu": m.voltage_max - v,
        "undervoltage": flag(v < m.voltage_min), "overvoltage": flag(v > m.voltage_max), "voltage_violation": flag((v < m.voltage_min) | (v > m.voltage_max)),
        "apparent_power_mva": s, "power_factor": F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.abs(p) / (s + m.epsilon))),
        "power_factor_angle_deg": F.degrees(F.atan2(q, p)), "pq_ratio": p / (F.abs(q) + m.epsilon), "pq_magnitude": s,
    })


def line_features(df: DataFrame, limits: Limits = Limits(), current_from="current_from_ka", current_to="current_to_ka", loading="loading_percent") -> DataFrame:
    require_columns(df, [current_from, current_to, loading])
    a, b, x, m = F.abs(numeric(current_from)), F.abs(numeric(current_to)), numeric(loading), limits
    return df.withColumns({
        "absolute_current_from_ka": a, "absolute_current_to_ka": b, "mean_current_ka": (a + b) / 2, "current_difference_ka": a - b, "absolute_current_difference_ka": F.abs(a - b),
        "current_imbalance": F.abs(a - b) / (F.greatest(a, b) + m.epsilon), "loading_margin_percent": m.thermal_percent - x, "loading_ratio": x / m.thermal_percent,
        "thermal_overload": flag(x > m.thermal_percent), "loading_above_90": flag(x >= 90.0), "loading_above_95": flag(x >= 95.0),
    })


def flow_features(df: DataFrame, limits: Limits = Limits(), current_from="current_from_ka", current_to="current_to_ka", loading="loading_percent") -> DataFrame:
    """The same formulas under the names that graph features use."""
    require_columns(df, [current_from, current_to, loading])
    a, b, x = F.abs(numeric(current_from)), F.abs(numeric(current_to)), numeric(loading)
    return df.withColumns({
        "mean_edge_current_ka": (a + b) / 2, "edge_current_difference_ka": F.abs(a - b), "edge_current_imbalance": F.abs(a - b) / (F.greatest(a, b) + limits.epsilon),
        "edge_loading_ratio": x / 100.0, "edge_stress": x / 100.0, "edge_overloaded": flag(x > 100.0),
    })
