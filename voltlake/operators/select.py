"""Feature selection fitted on training rows."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numeric, require_columns
from .correlation import pearson
from .scale import numeric_columns


@dataclass(frozen=True)
class SelectorConfig:
    max_missing: float = 0.30
    min_variance: float = 1e-8
    max_correlation: float = 0.95

    def __post_init__(self):
        if not 0 <= self.max_missing <= 1 or self.min_variance < 0 or not 0 < self.max_correlation <= 1:
            raise ValueError("thresholds out of range")


def column_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, missing, variance, mean): one pass."""
    cells = F.array(*(F.struct(F.lit(c).alias("feature"), F.avg(numeric(c).isNull().cast("double")).alias("missing"), F.var_samp(numeric(c)).alias("variance"), F.avg(numeric(c)).alias("mean")) for c in columns))
    return df.agg(cells.alias("r")).select(F.explode("r").alias("r")).select("r.*")


def missing_filter(df: DataFrame, columns: list[str], most: float = 0.30) -> DataFrame:
    return column_profile(df, columns).select("feature", "missing", (F.col("missing") <= most).alias("kept"))


def variance_filter(df: DataFrame, columns: list[str], least: float = 1e-8) -> DataFrame:
    return column_profile(df, columns).select("feature", "variance", F.coalesce(F.col("variance") > least, F.lit(False)).alias("kept"))


def correlation_prune(df: DataFrame, columns: list[str], most: float = 0.95) -> DataFrame:
    """Columns that correlate beyond `most` with any earlier column, itself dropped or not."""
    return pearson(df, columns).where((F.col("feature_1") != F.col("feature_2")) & (F.abs("r") > most)).select(F.col("feature_2").alias("feature")).distinct()


@dataclass(frozen=True)
class SelectorModel:
    """Kept columns in order, their training means, and what went why."""

    features: list[str]
    means: dict[str, float]
    removed: dict[str, list[str]] = field(default_factory=dict)

    def transform(self, df: DataFrame, keys: list[str] = ()) -> DataFrame:
        """keys and the kept columns, nulls filled with training means."""
        require_columns(df, self.features)
        return df.select(*keys, *(F.coalesce(numeric(c), F.lit(self.means[c])).alias(c) for c in self.features))

    def summary(self) -> dict:
        return {"initial_features": len(self.features) + sum(map(len, self.removed.values())), "final_features": len(self.features), **{f"removed_{k}": len(v) for k, v in self.removed.items()}}

    def to_json(self) -> str:
        return json.dumps({"kind": "selector", **asdict(self)})

    @staticmethod
    def from_json(text: str) -> SelectorModel:
        data = json.loads(text)
        if data.pop("kind", None) != "selector":
            raise TypeError("not a selector")
        return SelectorModel(**data)


def fit(train: DataFrame, columns: list[str] | None = None, config: SelectorConfig = SelectorConfig()) -> SelectorModel:
    """Drop by missing share, then by variance, then by correlation with an earlier column."""
    columns = columns or numeric_columns(train)
    profile = {r["feature"]: r for r in column_profile(train, columns).collect()}  # a row for each column
    missing = [c for c in columns if profile[c]["missing"] is None or profile[c]["missing"] > config.max_missing]
    rest = [c for c in columns if c not in missing]
    flat = [c for c in rest if not (profile[c]["variance"] or 0) > config.min_variance]
    rest = [c for c in rest if c not in flat]
    close = {r["feature"] for r in correlation_prune(train, rest, config.max_correlation).collect()} if len(rest) > 1 else set()
    kept = [c for c in rest if c not in close]
    return SelectorModel(kept, {c: profile[c]["mean"] for c in kept}, {"missing": missing, "variance": flat, "correlation": [c for c in rest if c in close]})
