"""Exact quantiles by narrowing brackets."""

import numpy as np
import pandas as pd
import pytest

from voltlake.operators.quantiles import exact_quantiles


@pytest.mark.parametrize("small", [1, 50, 20_000])
def test_against_sorting(spark, small):
    rng = np.random.default_rng(0)
    n = 30_000
    pdf = pd.DataFrame({
        "even": rng.random(n), "hot": np.where(rng.random(n) < 0.6, 7.0, rng.normal(size=n) * 100), "few": rng.integers(0, 4, n).astype(float), "same": 3.0,
        "far": np.concatenate([rng.random(n - 2), [1e300, -1e300]]), "holes": np.where(rng.random(n) < 0.9, np.nan, rng.normal(size=n)), "none": np.nan, "one": np.concatenate([[5.0], np.full(n - 1, np.nan)]),
    })
    qs = [0.0, 0.25, 0.5, 0.75, 0.95, 1.0]
    got = exact_quantiles(spark.createDataFrame(pdf), list(pdf), qs, small)
    for c in pdf:
        v = pdf[c].dropna()
        assert got[c] == ([None] * len(qs) if v.empty else pytest.approx(np.quantile(v, qs), rel=1e-12, abs=1e-12)), c
    assert exact_quantiles(spark.createDataFrame(pdf.head(0)[["even"]], "even double"), ["even"], [0.5]) == {"even": [None]}


def test_more_columns_than_a_pass_takes(spark):
    df = spark.range(100).selectExpr(*(f"cast(id * {k} as double) as c{k}" for k in range(40)))
    got = exact_quantiles(df, df.columns, [0.5])
    assert got == {f"c{k}": [49.5 * k] for k in range(40)}
