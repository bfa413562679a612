"""Filters of line dedup at several sizes, hot lines and rows without ids, and the registered query by plain Python."""

import hashlib
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voltlake.llm import line_dedup as l

DIR = Path("/root/testdata/sf0.001")


@pytest.mark.parametrize("times", [1, 10, 100])
def test_share_suspected_stays_flat(spark, times):
    """Keys that never repeat, 1, 10 and 100 times what a slice is made for: under 1 % are suspected at any size."""
    slice_keys, bits = 1 << 10, 15
    rng, n = np.random.default_rng(times), slice_keys * times
    found = [bytes(x) for x in rng.integers(0, 256, (n, 16), dtype=np.uint8)]
    rows = pd.DataFrame({"holder": range(n), "sub": 0, "digest": found, "hash": np.frombuffer(b"".join(found), "<i8")[::2]})
    again = rows.iloc[: n // 20].assign(holder=lambda r: r["holder"] + n)
    keys = spark.createDataFrame(pd.concat([rows, again]), "holder long, sub long, digest binary, hash long").repartition(7)
    out = l.suspected(keys, len(rows) + len(again), slice_keys, bits, salt_rows=256).toPandas()
    repeated = set(again["digest"].map(bytes))
    hit = out["digest"].map(lambda x: bytes(x) in repeated)
    assert hit.sum() == 2 * len(again) and (~hit).sum() < 0.01 * n
    assert not out.duplicated(["holder"]).any()


def test_filters_keep_their_bits_a_key(spark):
    for n in (100, 5000):
        keys = spark.range(n).select(F.xxhash64("id").alias("hash"))
        made = l.filters(keys, -(-n // 64), 11).collect()
        assert sum(r["n"] for r in made) == n and max(r["n"] for r in made) < 4 * 64


def plain(rows):
    key = lambda x: x.strip(" \t\n\v\f\r").encode().lower().decode()
    holders: dict[str, set] = {}
    me = lambda i: l.NO_ID if i is None else i
    for i, text in rows:
        for x in (text or "").split("\n"):
            holders.setdefault(key(x), set()).add(me(i))
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or len(holders[key(x)]) < 2 or min(holders[key(x)]) == me(i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def test_hot_line_and_many_rows_without_id(spark):
    rows = [(i if i % 3 else None, f"a line that is in all of them\nits own line {i // 2}\n  A LINE that is in all of them\nshort") for i in range(400)] + [(-5, "its own line 7"), (None, None), (1, "x" * 200_000 + "\nits own line 9")]
    df = spark.createDataFrame([(i, t, "q", 9) for i, t in rows], "doc_id long, text string, digest string, n_lines int")
    for salt_rows in (1 << 16, 16):  # 16: every slice and every hot key is split
        out = l.dedup_lines(df, slice_keys=64, filter_bits=11, salt_rows=salt_rows).collect()
        assert sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in out), key=str) == plain(rows)
        assert {r["digest"] for r in out} == {"q"}


@pytest.mark.skipif(not DIR.exists(), reason="no test tables")
def test_registered_query(spark):
    from voltlake.llm import queries

    docs = pd.read_parquet(DIR / "documents.parquet")
    want = [(i, n, k, hashlib.sha256(t.encode()).hexdigest()) for i, n, k, t in plain([(int(r.doc_id), r.text) for r in docs.itertuples()])]
    got = [(r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in queries.QUERIES["op2_line_dedup"](spark, str(DIR)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and any(k for _, _, k, _ in got)
