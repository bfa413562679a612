"""Joins of feature tables by keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import require_columns


def join_node_features(df: DataFrame, features: DataFrame, entity: str = "bus_id", node: str = "node") -> DataFrame:
    return df.join(features.withColumnRenamed(node, entity), entity, "left")


def join_topology(df: DataFrame, topology: DataFrame, line: str = "line_id", check: bool = True) -> DataFrame:
    """Left join, many to one: topology has one row a line, and every line is mapped, else an error."""
    one = topology.dropDuplicates()
    if check:
        if not one.groupBy(line).count().where("count > 1").isEmpty():
            raise ValueError("a line has more than one row in the topology")
        if not df.select(line).distinct().join(one, line, "left_anti").isEmpty():
            raise ValueError("a line is not in the topology")
    return df.join(one, line, "left")


def join_edge_features(df: DataFrame, features: DataFrame, ends: tuple[str, str] = ("from_bus", "to_bus"), canonical: bool = True) -> DataFrame:
    """features has src and dst. canonical: in either direction; otherwise (a, b) doesn't meet (b, a)."""
    a, b = F.col(ends[0]), F.col(ends[1])
    keyed = df.withColumns({"src": F.least(a, b), "dst": F.greatest(a, b)} if canonical else {"src": a, "dst": b})
    own = features.withColumns({"src": F.least("src", "dst"), "dst": F.greatest("src", "dst")}) if canonical else features
    return keyed.join(own, ["src", "dst"], "left").drop("src", "dst")


def fuse(base: DataFrame, families: list[DataFrame], keys: list[str]) -> DataFrame:
    """A chain of left joins; of columns in more than one table the first stays."""
    for f in families:
        require_columns(f, keys)
        base = base.join(f.select(*keys, *(c for c in f.columns if c not in base.columns)), keys, "left")
    return base


#: The key columns that go with features.
METADATA = {"bus": ("timestamp", "bus_id"), "line": ("timestamp", "line_id", "from_bus", "to_bus", "in_service", "edge_in_operational_graph")}


def extract_metadata(df: DataFrame, kind: str) -> DataFrame:
    names = METADATA[kind]
    require_columns(df, names[:2])
    typed = {"timestamp": F.col("timestamp").cast("timestamp_ntz")} | {c: F.col(c).cast("long") for c in names if c in ("bus_id", "line_id", "from_bus", "to_bus")}
    return df.select(*(typed.get(c, F.col(c)).alias(c) for c in names if c in df.columns))
