"""Baum-Welch counts over whole texts against plain recursion, and scores end to end by plain counting."""

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltlake.llm import lm_score as l
from voltlake.llm.common import remainder


def test_counts_of_whole_texts():
    rng, k = np.random.default_rng(0), l.STATES
    emit, move = rng.random((l.SYMBOLS, k)), rng.random((k, k)) + 3 * np.eye(k)
    model = l.Model(np.full(k, 1 / k), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))
    texts, want = [rng.integers(0, 40, n).astype(np.uint16) for n in (1, 2, 5, 3, 9, 64, 65, 130, 300)], np.zeros((l.ROWS, k))
    for text in texts:
        a, scale, b = [], [], np.ones(k)
        for i, x in enumerate(text):
            now = (a[-1] @ model.move if i else model.start) * model.emit[x]
            scale.append(now.sum())
            a.append(now / scale[-1])
        for i in range(len(text) - 1, -1, -1):
            want[text[i]] += a[i] * b
            if i:
                onward = model.emit[text[i]] * b / scale[i]
                want[l.SYMBOLS : l.SYMBOLS + k] += np.outer(a[i - 1], onward) * model.move
                b = model.move @ onward
        want[l.SYMBOLS + k] += a[0] * b
        want[-1] += np.log(scale).sum()
    got = l.sum_counts(model, texts)
    assert got == pytest.approx(want, abs=1e-3)
    assert got[l.SYMBOLS : l.SYMBOLS + k].sum() == pytest.approx(sum(len(t) - 1 for t in texts), rel=1e-5)  # no move is left out


def test_training_raises_the_likelihood():
    rng = np.random.default_rng(1)
    texts = [(rng.integers(0, 200, int(n)) + 200 * (i % 4)).astype(np.uint16) for i, n in enumerate(rng.integers(5, 200, 60))]
    base = np.bincount(np.concatenate(texts), minlength=l.SYMBOLS) + 1.0
    model, seen = l.begin(texts, base / base.sum(), rounds=1), []
    for _ in range(5):
        counts = l.sum_counts(model, texts)
        seen.append(counts[-1, 0])
        model = l.Model.from_counts(counts, base / base.sum(), prior=1e-6)
    assert all(b > a for a, b in zip(seen, seen[1:]))


def test_scores_end_to_end(spark):
    """Whole queries' rows: the model is the operator's own, its likelihood and the shares of rare words are counted here."""
    rng = np.random.default_rng(2)
    common, rare = [f"w{i}" for i in range(40)], [f"rare{i}x{i % 7}" for i in range(90)]
    texts = [" ".join([*rng.choice(common[:20] if i % 2 else common[20:], int(rng.integers(1, 60))), *rng.choice(rare, 2)]) for i in range(120)]
    rows = [(i, t, "q") for i, t in enumerate(texts)] + [(500, None, "q"), (501, "", "q"), (None, "W1 w2", "q"), (3, texts[3], "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = sorted(((r["doc_id"], r["held_out"], round(r["score"], 4)) for r in l.score_documents(df, remainder("doc_id", 7) == 2).collect()), key=str)

    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    counts = Counter(w for i, t, _ in rows if not held(i) for w in (t or "").lower().split())
    docs = sum(not held(i) for i, _, _ in rows)
    head = {w for w in counts if counts[w] >= l.LEAST}
    seen = df.select(F.col("doc_id").alias("__id"), (remainder("doc_id", 7) == 2).alias("held_out"), (F.pmod(F.xxhash64(F.lit("sample"), F.xxhash64("doc_id")), F.lit(1 << 30)) / float(1 << 30)).alias("pick"), "text")
    vocab = l.vocabulary(l.count_words(seen.where("not held_out")), docs)
    assert {l.word_hash(w) for w in head} == set(vocab.head) and vocab.total == counts.total() + docs and vocab.distinct == len(counts) + 1
    encoded = l.encode(seen, vocab, "text").withColumn("row", F.monotonically_increasing_id())
    model = l.train(encoded.where("not held_out"), vocab)
    of = {h: i + 1 for i, h in enumerate(vocab.head)}
    want = []
    for i, text, _ in rows:
        words = (text or "").lower().split()
        symbols = [of[l.word_hash(w)] if w in head else l.HEAD + 1 + l.word_class(w) for w in words] + [0]
        a, total = model.start * model.emit[symbols[0]], 0.0
        for x in symbols[1:]:
            a = (a @ model.move) * model.emit[x]
            total, a = total + np.log10(a.sum()), a / a.sum()
        if len(symbols) == 1:
            total = np.log10(a.sum())
        for w in words:
            if w not in head:
                own = [c for c in counts if c not in head and l.word_class(c) == l.word_class(w)]
                total += np.log10((counts[w] + 1) / (sum(counts[c] for c in own) + len(own) + 1))
        want.append((i, held(i), round(float(total), 4)))
    assert [x[:2] for x in got] == [x[:2] for x in sorted(want, key=str)]
    assert [x[2] for x in got] == pytest.approx([x[2] for x in sorted(want, key=str)], rel=1e-4)
    assert len({x[2] for x in want}) > 100
