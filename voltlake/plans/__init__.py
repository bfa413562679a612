"""Whole runs: dataset build, features, detection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clean, electrical, forest, fuse, quality, rolling, scale, spectral, split, windows
from ..operators import select as selection

FREE = ("split", "timestamp", "bus_id", "line_id", "from_bus", "to_bus", "in_service")


def build_dataset(bus: DataFrame, ordinal: str, config: split.SplitConfig = split.SplitConfig(), method: str = "standard", window: int = 60, stride: int = 1, validate: bool = True) -> dict[str, DataFrame]:
    """validate, preprocess, split by time, scale by training rows, cut windows of each split."""
    rules = quality.Rules("timestamp", "bus_id", quality.BUS_RULES.numeric, quality.BUS_RULES.ranges, ordinal)
    issues = quality.validate(bus, rules)
    if validate and not quality.passed(issues):
        raise ValueError("the measurements fail validation")
    rows = clean.preprocess(bus, "bus_id", ordinal, clean.BUS_COLUMNS).drop(ordinal)
    parts = split.temporal_split(rows, "timestamp", config)
    features = list(quality.BUS_RULES.numeric)
    model, scaled = scale.scale_split(parts, method, features)
    cut = {s: windows.sliding_windows(scaled.where(F.col("split") == s), features, "bus_id", "timestamp", window, stride) for s in split.NAMES}
    return {"issues": issues, "processed": rows, "split": parts, "scaled": scaled, **{f"windows_{s}": w for s, w in cut.items()}}


def entity_features(df: DataFrame, entity: str, signals: list[str], kind: str, spectra: bool = True) -> DataFrame:
    """Statistical, electrical and spectral families of a measurement table, fused by (timestamp, entity)."""
    keys = ["timestamp", entity]
    electric = electrical.bus_features(df) if kind == "bus" else electrical.line_features(df)
    families = [electric]
    if spectra:
        families += [spectral.rolling_features(df, s, [entity], "timestamp") for s in signals]
    return fuse.fuse(rolling.rolling_statistics(df, signals, ["timestamp"], [entity]), [f.drop(*signals) for f in families], keys)


def detect(features: DataFrame, keys: list[str], config: split.SplitConfig = split.SplitConfig(), q: float = 0.95, trees: int = 300) -> tuple[DataFrame, dict]:
    """Split, select and impute by training rows, fit the forest, threshold on validation scores: (scored rows, what was fitted)."""
    parts = split.temporal_split(features, "timestamp", config)
    train = parts.where("split = 'train'")
    columns = [c for c in scale.numeric_columns(parts) if c not in FREE]
    chosen = selection.fit(train, columns)
    ready = chosen.transform(parts, [*keys, "split"])
    model = forest.fit(ready.where("split = 'train'"), chosen.features, keys, trees)
    scored = model.score(ready.select(*keys, "split", *chosen.features))
    cut = forest.threshold(scored.where("split = 'validation'"), q=q)
    return forest.predict(scored, cut), {"selector": chosen, "forest": model, "threshold": cut}


def detection_summary(scored: DataFrame, fitted: dict, entity_type: str) -> DataFrame:
    """A row for each split: its rows, mean score, anomalies and their share, and what was fitted."""
    rows = forest.score_summary(scored)
    more = {"entity_type": entity_type, "threshold": float(fitted["threshold"]), "features": len(fitted["selector"].features), "trees": len(fitted["forest"].trees), "sample": fitted["forest"].sample}
    return rows.select("*", *(F.lit(v).alias(k) for k, v in more.items()))


def selected_features(spark: SparkSession, selector: selection.SelectorModel) -> DataFrame:
    """(feature, place, removed_by): the features in order, and those that were left out with the filter that did it."""
    kept = [(c, i, None) for i, c in enumerate(selector.features)]
    return spark.createDataFrame(kept + [(c, None, why) for why, columns in selector.removed.items() for c in columns], "feature string, place int, removed_by string")
