"""The dual of the mix against a plain solver, and the registered query by its constraints."""

import re
from collections import Counter
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voltlake.llm import mixing

DIR = Path("/root/testdata/sf0.01")


def plain_tilt(sizes, target, cap=3.0):
    """The a for which sum(size * min(cap, exp(a * size / mean))) is the target, by bisection."""
    m = np.array(sizes, float)
    m = m[m > 0]
    words = lambda a: (m * np.exp(np.minimum(a * m / m.mean(), np.log(cap)))).sum()
    low, high = -1e4, 1e4
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if words(mid) < target else (low, mid)
    return mid


def classes_of(spark, sources):
    rows = [(i, int(z), 1, float(z / np.mean([x for x in m if x])), float(np.log(max(z, 1)))) for i, m in enumerate(sources) for z in m]
    return spark.createDataFrame(rows, "sid int, size long, n long, u double, z double")


def test_dual_against_bisection(spark):
    rng = np.random.default_rng(4)
    sources = [[int(x) for x in rng.lognormal(5, 1, 300)] + [0], [int(x) for x in rng.lognormal(4, 1.5, 200)] + [20_000], [7] * 50, list(range(1, 90))]
    goals = [(i, sum(m), share * sum(m), float(np.mean([x for x in m if x]))) for i, (m, share) in enumerate(zip(sources, (0.3, 1.9, 2.5, 2.9)))]
    table = spark.createDataFrame(goals, "sid int, source_size long, target double, mean double")
    dual, rounds = mixing.balance(classes_of(spark, sources), table, 3.0, 0.0)
    assert rounds > 3
    for r in dual.collect():
        assert r["b"] == 0 and r["a"] == pytest.approx(plain_tilt(sources[r["sid"]], goals[r["sid"]][2]), rel=1e-6)
    with pytest.raises(RuntimeError, match="not converged"):
        mixing.balance(classes_of(spark, sources), table, 3.0, 0.0, steps=2)


def test_rates_are_tilted(spark):
    """A source with too many words gives up its long documents first: copies follow exp(a * size)."""
    df = spark.createDataFrame([(i, "ab"[i % 5 == 0], 10 + i % 400) for i in range(8000)], "doc_id long, source string, n long")
    out = mixing.mix(df, size=F.col("n"), weights=(1.0, 1.0)).toPandas()
    for _, own in out.groupby("source"):
        a = plain_tilt(own["size"], own["target"].iloc[0])
        rate = np.minimum(3, np.exp(a * own["size"] / own["size"].mean()))
        decile = pd.qcut(own["size"], 10, labels=False)
        assert np.allclose(own["copies"].groupby(decile).mean(), rate.groupby(decile).mean(), atol=0.04) and abs(a) > 0.1
        assert abs(own["taken"].sum() - own["target"].iloc[0]) <= own["size"].min()


def test_many_sources_and_rows_without_ids(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_SOURCES", 10)
    names = [None, "", *(f"d{i:03}.example" for i in range(60)), "é", "Z"]
    rows = [(None if k % 3 else k, names[k % len(names)], f"{'w ' * (1 + k * 7 % 31)}x{k}", "c", 5) for k in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, copies string, sid int")
    out = mixing.mix(df).toPandas()
    sizes = out.groupby("source", dropna=False)["size"].sum()
    order = sorted(names, key=lambda x: (x is None, x or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    by = lambda s: out[out["source"].isna()] if s is None else out[out["source"] == s]
    stopped, size = set(), {s: int(by(s)["size"].sum()) for s in order}
    while True:
        level = (sum(size.values()) - 3 * sum(size[s] for s in stopped)) / sum(weight[s] for s in order if s not in stopped)
        more = {s for s in order if s not in stopped and weight[s] * level > 3 * size[s]}
        if not more:
            break
        stopped |= more
    for s in order:
        own = by(s)
        assert own["target"].iloc[0] == pytest.approx(min(3 * size[s], weight[s] * level)) and abs(own["taken"].sum() - own["target"].iloc[0]) <= own["size"].max()
    assert len(out) == 2000 and sizes.sum() == sum(size.values()) and out["copies"].between(0, 3).all()


@pytest.mark.skipif(not DIR.exists(), reason="no test tables")
def test_registered_query(spark):
    from voltlake.llm import queries

    docs = pd.read_parquet(DIR / "documents.parquet")
    want = Counter((int(r.doc_id), len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in docs.itertuples())
    out = queries.QUERIES["op4_mixing"](spark, str(DIR)).toPandas()
    again = queries.QUERIES["op4_mixing"](spark, str(DIR)).toPandas()
    assert Counter(zip(out["doc_id"], out["size"])) == want and out.sort_values("doc_id").equals(again.sort_values("doc_id").set_axis(out.sort_values("doc_id").index))
    out = out.merge(docs[["doc_id", "source"]], on="doc_id")
    for _, own in out.groupby("source", dropna=False):
        assert (own["source_size"] == own["size"].sum()).all() and abs(own["taken"].sum() - own["target"].iloc[0]) <= own["size"].max()
    assert (out["taken"] <= 3 * out["size"]).all()
