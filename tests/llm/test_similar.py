"""Near-duplicates by Jaccard likeness of five-word shingle sets, against all pairs."""

import numpy as np
import pytest

from voltlake.llm import simhash


def jaccard(a, b):
    a, b = (set(simhash.shingle_set(x, 5).tolist()) for x in (a, b))
    return len(a & b) / len(a | b) if a | b else 1.0


def groups(rows, similarity):
    root = {i: i for i, _ in rows}

    def find(i):
        return i if root[i] == i else find(root[i])

    for k, (i, a) in enumerate(rows):
        for j, b in rows[:k]:
            if find(i) != find(j) and jaccard(a, b) >= similarity:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i for i in root if find(i) == i}


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    words, out = [f"w{i}" for i in range(3000)], []
    for g in range(60):
        base = list(rng.choice(words, int(rng.integers(30, 400))))
        out.append(base)
        for _ in range(int(rng.integers(0, 5))):
            copy = list(base)
            for _ in range(max(1, int(len(base) * rng.choice([0.005, 0.015, 0.06])))):
                copy[int(rng.integers(len(copy)))] = str(rng.choice(words))
            out.append(copy)
    texts = [" ".join(x) for x in out] + ["", None, " \n", "one two", "one two three four", out[0][0]] + [" ".join(out[5]).upper()]
    return [(int(i), t) for i, t in enumerate(texts)]


def test_groups(spark, rows):
    df = spark.createDataFrame([*rows, rows[7]], "doc_id long, text string")
    want = groups(rows, 0.8)
    for tile_rows in (1024, 8):  # 8: many bands of several bits
        got = [r["doc_id"] for r in simhash.drop_similar(df, tile_rows=tile_rows).collect()]
        assert sorted(got) == sorted(want) and len(want) < len(rows) - 50
    assert simhash.drop_similar(df.limit(0)).count() == 0


def test_wide_fingerprints_estimate_likeness():
    rng = np.random.default_rng(0)
    for likeness in (0.6, 0.8, 0.9):
        off = []
        for _ in range(60):
            common, n = int(600 * likeness), 600
            h = rng.integers(0, 1 << 63, 2 * n - common).astype(np.uint64)
            half = (n - common) // 2
            a, b = np.concatenate([h[:common], h[common : common + half]]), np.concatenate([h[:common], h[common + half : common + 2 * half]])
            off.append(int(np.bitwise_count(simhash.wide_simhash(a) ^ simhash.wide_simhash(b)).sum()))
        assert np.mean(off) / 512 == pytest.approx(simhash.wide_radius(likeness, 512)[0], abs=0.02)


def test_forest_of_least_distances():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 63, (40, 8)).astype(np.uint64)
    x = np.concatenate([x, x ^ (np.uint64(1) << rng.integers(0, 63, x.shape).astype(np.uint64)), x[:5]])
    a, b = simhash.nearest_forest(x, 20)
    off = np.bitwise_count(x[:, None] ^ x[None]).sum(axis=2)
    assert (off[a, b] <= 20).all() and len(a) == 45 and len({*a.tolist(), *b.tolist()}) == 85
    assert sorted(off[a, b].tolist()) == [0] * 5 + [8] * 40
