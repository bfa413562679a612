"""Principal components, and a two-dimensional embedding of a sample for display."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numeric


def _complete(df: DataFrame, columns: list[str]) -> DataFrame:
    rows = df.withColumns({c: numeric(c) for c in columns})
    return rows.dropna(subset=columns)


def fit_pca(df: DataFrame, columns: list[str]):
    """(model, rows with the standardised `vector`). Columns are divided by the spread of the population, constant ones by 1.
    Rows with a missing value are left out."""
    rows = _complete(df, columns)
    found = rows.agg(*(f(c).alias(f"{k}_{i}") for i, c in enumerate(columns) for k, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    if found["m_0"] is None:
        raise ValueError("no row without a missing value")
    spread = [found[f"s_{i}"] if found[f"s_{i}"] > 1e-12 else 1.0 for i in range(len(columns))]
    rows = rows.withColumns({f"__z{i}": (F.col(c) - found[f"m_{i}"]) / spread[i] for i, c in enumerate(columns)})
    rows = VectorAssembler(inputCols=[f"__z{i}" for i in range(len(columns))], outputCol="vector").transform(rows).drop(*(f"__z{i}" for i in range(len(columns))))
    return PCA(k=len(columns), inputCol="vector", outputCol="components").fit(rows), rows


def explained(df: DataFrame, columns: list[str]) -> DataFrame:
    """(component, explained_variance_ratio, cumulative)."""
    model, _ = fit_pca(df, columns)
    ratios = model.explainedVariance.toArray()
    spark: SparkSession = df.sparkSession
    return spark.createDataFrame([(i + 1, float(x), float(c)) for i, (x, c) in enumerate(zip(ratios, np.cumsum(ratios)))], "component int, explained_variance_ratio double, cumulative double")


def loadings(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, component, loading), signs as they come."""
    model, _ = fit_pca(df, columns)
    m = model.pc.toArray()
    spark: SparkSession = df.sparkSession
    return spark.createDataFrame([(c, j + 1, float(m[i, j])) for i, c in enumerate(columns) for j in range(m.shape[1])], "feature string, component int, loading double")


def scores(df: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    model, rows = fit_pca(df, columns)
    return model.transform(rows).select(*keys, vector_to_array("components").alias("scores"))


def tsne(df: DataFrame, columns: list[str], keys: list[str], rows: int = 3000, perplexity: float = 30.0, steps: int = 250, seed: int = 42) -> DataFrame:
    """(keys, x, y) of a sample of at most `rows` rows (by a hash of the keys), on the driver: a picture, not statistics."""
    picked = _complete(df, columns).orderBy(F.xxhash64(F.lit(seed), *keys), *keys).limit(rows).select(*keys, *columns).toPandas()
    x = picked[columns].to_numpy(float)
    x = (x - x.mean(axis=0)) / np.where(x.std(axis=0) > 1e-12, x.std(axis=0), 1.0)
    n = len(x)
    perplexity = max(1.0, min(perplexity, (n - 1) / 3))
    d = ((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2) if n <= 1000 else np.maximum((x**2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * x @ x.T, 0)
    low, high, beta = np.zeros(n), np.full(n, np.inf), np.ones(n)
    for _ in range(50):
        p = np.exp(-d * beta[:, None])
        np.fill_diagonal(p, 0)
        p /= np.maximum(p.sum(axis=1, keepdims=True), 1e-300)
        entropy = -(p * np.log(np.maximum(p, 1e-300))).sum(axis=1)
        up = entropy > np.log(perplexity)
        low, high = np.where(up, beta, low), np.where(up, high, beta)
        beta = np.where(np.isinf(high), beta * 2, (low + high) / 2)
    p = np.maximum((p + p.T) / (2 * n), 1e-12)
    y, move = np.random.default_rng(seed).normal(0, 1e-4, (n, 2)), np.zeros((n, 2))
    for step in range(steps):
        q = 1 / (1 + np.maximum((y**2).sum(1)[:, None] + (y**2).sum(1)[None] - 2 * y @ y.T, 0))
        np.fill_diagonal(q, 0)
        w = (p * (4 if step < 100 else 1) - q / q.sum()) * q
        move = (0.5 if step < 100 else 0.8) * move - 100 * 4 * (w.sum(axis=1)[:, None] * y - w @ y)
        y = y + move
        y -= y.mean(axis=0)
    out = picked[keys].assign(x=y[:, 0], y=y[:, 1])
    return df.sparkSession.createDataFrame(out)
