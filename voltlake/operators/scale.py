"""Scaling with parameters fitted on training rows."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import require_columns
from .quantiles import exact_quantiles

METHODS = ("standard", "minmax", "robust")
#: Columns that are keys, flags or time features and are never scaled.
EXCLUDED = ("timestamp", "bus_id", "line_id", "from_bus", "to_bus", "in_service", "hour", "day_of_week", "day_of_year", "hour_sin", "hour_cos", "day_of_week_sin", "day_of_week_cos", "is_anomaly")


@dataclass(frozen=True)
class ScalerModel:
    """Center and scale by column."""

    method: str
    center: dict[str, float]
    scale: dict[str, float]

    def transform(self, df: DataFrame, check: bool = True) -> DataFrame:
        require_columns(df, self.center)
        bad = lambda c: F.raise_error(F.lit(f"null in {c}")).cast("double")
        x = lambda c: F.coalesce(F.col(c).cast("double"), bad(c)) if check else F.col(c).cast("double")
        return df.withColumns({c: (x(c) - self.center[c]) / self.scale[c] for c in self.center})

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        require_columns(df, self.center)
        return df.withColumns({c: F.col(c) * self.scale[c] + self.center[c] for c in self.center})

    def to_json(self) -> str:
        return json.dumps({"kind": "scaler", **asdict(self)})

    @staticmethod
    def from_json(text: str) -> ScalerModel:
        data = json.loads(text)
        if data.pop("kind", None) != "scaler":
            raise TypeError("not a scaler")
        return ScalerModel(**data)


def numeric_columns(df: DataFrame, excluded=EXCLUDED) -> list[str]:
    return [c for c, k in df.dtypes if k.split("(")[0] in ("double", "float", "int", "bigint", "smallint", "tinyint", "decimal") and c not in excluded]


def fit(train: DataFrame, method: str = "standard", columns: list[str] | None = None) -> ScalerModel:
    """One aggregate over the training rows, and for 'robust' their exact quartiles. Nulls and infinities are errors; a scale
    below 1e-12 becomes 1."""
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    columns = columns or numeric_columns(train)
    require_columns(train, columns)
    of = []
    for c in columns:
        x = F.col(c).cast("double")
        a, b = (F.min(x), F.max(x) - F.min(x)) if method == "minmax" else (F.avg(x), F.stddev_pop(x))
        of += [F.struct(a.alias("a"), b.alias("b"), F.count_if(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))).alias("bad"), F.count("*").alias("n")).alias(c)]
    row = train.agg(*of).first()
    for c in columns:
        if row[c]["bad"] or not row[c]["n"]:
            raise ValueError(f"{c} has {row[c]['bad']} missing or infinite values of {row[c]['n']}")
    center, spread = {c: row[c]["a"] for c in columns}, {c: row[c]["b"] for c in columns}
    if method == "robust":
        quartiles = exact_quantiles(train, columns, [0.25, 0.5, 0.75])
        center, spread = {c: quartiles[c][1] for c in columns}, {c: quartiles[c][2] - quartiles[c][0] for c in columns}
    return ScalerModel(method, center, {c: v if abs(v) >= 1e-12 else 1.0 for c, v in spread.items()})


def fit_transform(train: DataFrame, method: str = "standard", columns: list[str] | None = None) -> tuple[ScalerModel, DataFrame]:
    model = fit(train, method, columns)
    return model, model.transform(train)


def scale_split(split: DataFrame, method: str = "standard", columns: list[str] | None = None) -> tuple[ScalerModel, DataFrame]:
    """Fit on the rows of split 'train', apply to all."""
    model = fit(split.where("split = 'train'").drop("split"), method, columns)
    return model, model.transform(split)
