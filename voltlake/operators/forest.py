"""Isolation forest: trees on small samples, scores as a batch function of the whole table."""

from __future__ import annotations

import functools
import json
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import require_columns
from ..session import ship
from .quantiles import exact_quantiles


def path_length(n: np.ndarray | float) -> np.ndarray:
    """Expected depth of an unsuccessful search among n."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass(frozen=True)
class ForestModel:
    """Trees as arrays: feature (-1: leaf), cut, left, right and depth + correction of leaves."""

    columns: list[str]
    trees: list[dict]
    sample: int

    @functools.cached_property
    def _steps(self) -> list[tuple]:
        """Of each tree: feature, cut, both children in turn, depth, and its levels. A leaf is its own child."""
        out = []
        for t in self.trees:
            leaf, own, levels, at = t["feature"] < 0, np.arange(len(t["feature"])), 0, np.zeros(1, int)
            while (at := at[~leaf[at]]).size:
                at, levels = np.concatenate([t["left"][at], t["right"][at]]), levels + 1
            child = np.stack([np.where(leaf, own, t["left"]), np.where(leaf, own, t["right"])], axis=1).ravel()
            out.append((np.where(leaf, 0, t["feature"]), np.where(leaf, np.inf, t["cut"]), child, t["depth"], levels))
        return out

    def score_array(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-E[depth] / c) - 0.5: the larger, the odder. All rows go down a tree together, level by level, without a
        look at which have arrived."""
        n, total = len(x), np.zeros(len(x))
        values, row = np.ascontiguousarray(np.asarray(x, float).T).ravel(), np.arange(n)
        for feature, cut, child, depth, levels in self._steps if n else []:
            column, at = feature * n, np.zeros(n, np.intp)
            for _ in range(levels):
                right = values.take(column.take(at, mode="clip") + row, mode="clip") > cut.take(at, mode="clip")
                at = child.take(2 * at + right, mode="clip")
            total += depth.take(at)
        return 2.0 ** (-total / len(self.trees) / max(float(path_length(self.sample)), 1e-12)) - 0.5

    def score(self, df: DataFrame, name: str = "anomaly_score") -> DataFrame:
        """df with the score. The trees have at most 2 * sample nodes each, whatever the data's size."""
        require_columns(df, self.columns)
        ship(df.sparkSession)
        shared = df.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("double")
        def of(x: pd.DataFrame) -> pd.Series:
            return pd.Series(shared.value.score_array(x.to_numpy(float)))

        return df.withColumn(name, of(F.struct(*(F.col(c).cast("double").alias(c) for c in self.columns))))

    def to_json(self) -> str:
        return json.dumps({"kind": "forest", "columns": self.columns, "sample": self.sample, "trees": [{k: v.tolist() for k, v in t.items()} for t in self.trees]})

    @staticmethod
    def from_json(text: str) -> ForestModel:
        data = json.loads(text)
        if data.pop("kind", None) != "forest":
            raise TypeError("not a forest")
        return ForestModel(data["columns"], [{k: np.array(v) for k, v in t.items()} for t in data["trees"]], data["sample"])


def _tree(x: np.ndarray, rng: np.random.Generator, limit: int) -> dict:
    feature, cut, left, right, depth = [], [], [], [], []

    def grow(rows: np.ndarray, d: int) -> int:
        me = len(feature)
        feature.append(-1), cut.append(0.0), left.append(-1), right.append(-1), depth.append(d + float(path_length(len(rows))))
        wide = np.flatnonzero(rows.max(axis=0) > rows.min(axis=0)) if len(rows) else []
        if d < limit and len(rows) > 1 and len(wide):
            j = int(rng.choice(wide))
            c = float(rng.uniform(rows[:, j].min(), rows[:, j].max()))
            low = rows[:, j] <= c
            feature[me], cut[me] = j, c
            left[me], right[me] = grow(rows[low], d + 1), grow(rows[~low], d + 1)
        return me

    grow(x, 0)
    return {"feature": np.array(feature), "cut": np.array(cut), "left": np.array(left), "right": np.array(right), "depth": np.array(depth)}


def fit(train: DataFrame, columns: list[str], key: list[str], trees: int = 300, sample: int = 256, seed: int = 42) -> ForestModel:
    """Each tree gets its own sample. The rows come by a hash of `key` (trees * sample of them at most), so the fit is the same on
    every run; values that are missing or infinite are errors."""
    require_columns(train, columns)
    bad = sum((F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf"))) for c in columns), F.lit(0))
    n, wrong = train.agg(F.count("*"), bad).first()
    if wrong or not n:
        raise ValueError("training rows must be there, without missing or infinite values")
    want = min(n, trees * sample)
    unit = F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1 << 30)) / float(1 << 30)
    share = min(1.0, 1.2 * want / n + 1e-6)
    rows = train.select(unit.alias("__u"), *(F.col(c).cast("double").alias(c) for c in columns)).where(F.col("__u") <= share).orderBy("__u", *columns).limit(want).toPandas()
    x, rng = rows[columns].to_numpy(float), np.random.default_rng(seed)
    size = min(sample, len(x))
    limit = max(1, math.ceil(math.log2(max(size, 2))))
    return ForestModel(list(columns), [_tree(x[rng.choice(len(x), size, replace=False)], rng, limit) for _ in range(trees)], size)


def threshold(validation: DataFrame, score: str = "anomaly_score", q: float = 0.95) -> float:
    """The exact quantile, by linear interpolation, of validation scores."""
    if not 0 < q < 1:
        raise ValueError("q must be between 0 and 1")
    return exact_quantiles(validation, [score], [q])[score][0]


def predict(scored: DataFrame, cut: float, score: str = "anomaly_score", name: str = "prediction") -> DataFrame:
    return scored.withColumn(name, (F.col(score) >= cut).cast("int"))


def score_summary(scored: DataFrame, by: str = "split", score: str = "anomaly_score", predicted: str = "prediction") -> DataFrame:
    return scored.groupBy(by).agg(F.count("*").alias("rows"), F.avg(score).alias("mean_score"), F.sum(predicted).alias("anomalies"), F.avg(predicted).alias("anomaly_fraction"))
