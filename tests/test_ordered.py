"""Frames over a whole table's order, in blocks and in one window."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltlake import queries
from voltlake.operators import stats
from voltlake.operators.ordered import over_order


def shifted(rows, by):
    return rows.withColumns({"back": F.lag("i", 3).over(by), "near": F.sum("i").over(by.rowsBetween(-2, 0))})


@pytest.mark.parametrize("kind", ["even", "hot", "outlier", "null"])
def test_blocks_match_one_window(spark, kind):
    rng = np.random.default_rng(3)
    t = {"even": range(500), "hot": sorted([7] * 200 + [int(x) for x in rng.integers(0, 60, 300)]), "outlier": [0, *range(10**9, 10**9 + 499)], "null": [None, *range(499)]}[kind]
    rows = [(x, i) for i, x in enumerate(t)]
    df = spark.createDataFrame([rows[k] for k in rng.permutation(len(rows))], "t long, i long").repartition(5)
    want = sorted(map(tuple, over_order(df, ["t", "i"], 3, shifted).collect()), key=lambda r: r[1])
    got = sorted(map(tuple, over_order(df, ["t", "i"], 3, shifted, block_rows=17).collect()), key=lambda r: r[1])
    assert got == want and [r[2] for r in got] == [None] * 3 + [*range(497)]


def test_blocks_of_timestamps_and_texts(spark):
    df = spark.range(300).select(F.timestamp_seconds(F.col("id") * 60).cast("timestamp_ntz").alias("t"), F.lpad(F.col("id").cast("string"), 4, "0").alias("name"), F.col("id").alias("i"))
    for order in (["t"], ["name"]):
        assert sorted((r["i"], r["back"]) for r in over_order(df, order, 3, shifted, block_rows=10).collect()) == [(i, i - 3 if i > 2 else None) for i in range(300)]
    assert over_order(df.limit(0), ["t"], 3, shifted).count() == 0


@pytest.mark.parametrize("block_rows", [200_000, 17])
def test_rolling_query_with_events_of_one_time(spark, tmp_path, monkeypatch, block_rows):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"copy (select i as event_id, timestamp '2024-01-01' + to_minutes(i % 50) as ts, i % 3 as user_id, 'view' as event_type, (i * 37 % 101)::double as value from range(300) t(i) order by i * 7919 % 300) to '{tmp_path}/events.parquet' (format parquet)")
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
    sql = queries.ORACLE_SQL["rolling_stats_unpartitioned"].replace("ORDER BY ts", "ORDER BY ts, event_id")
    monkeypatch.setattr(over_order, "__defaults__", (block_rows,))
    got = queries.QUERIES["rolling_stats_unpartitioned"](spark, str(tmp_path)).toPandas().set_index("event_id").sort_index()
    want = con.sql(sql).df().set_index("event_id").sort_index()
    assert len(got) == 300
    assert np.allclose(got.astype(float), want[list(got)].astype(float), atol=1e-5, equal_nan=True)


def test_steps_of_a_series(spark):
    df = spark.createDataFrame([(0.0, 1.0), (10.0, 3.0), (40.0, 0.0)], "s double, value double").select(F.timestamp_seconds("s").alias("t"), "value")
    r = stats.temporal_statistics(df, "t").first()
    assert (r["mean_abs_ramp"], r["max_abs_ramp"]) == (0.25, 0.3)
