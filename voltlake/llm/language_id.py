"""Language identification.

Sparse multinomial logistic regression on TF-IDF of character n-grams (letters in lower case, other characters one
space, n of 1 to 3, hashed to DIM buckets). Document frequencies are counted over all documents that may be learned
from; the weights are fitted on a sample of at most about SAMPLE_ROWS of them (by a hash of the id, equal shares for
the languages) with follow-the-regularised-leader and an elastic net. A fifth of the sample is kept out to fit
the temperature that calibrates the scores.

Edge cases: null texts and texts without letters are `und` with score 0; rows without a language are predicted and
not learned from; a null id counts as empty text in the folds; without a row to learn from all is `und`; ties go to
the smaller language; repeated rows are judged alike; columns named lang_pred or score are replaced; an empty table
gives no rows.
"""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import PARTS, array_parts, cut, map_arrow, read, remainder, summed

DIM, ORDERS, SAMPLE_ROWS, LEAST_ROWS, EPOCHS = 1 << 15, (1, 2, 3), 4000, 50, 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.05, 0.01


@functools.cache
def _letters() -> np.ndarray:
    """Of each code point whether it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts) of the n-grams of a whole text; none if it has no letter."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(_letters()[codes], codes, np.uint32(32))
    codes = np.concatenate([[np.uint32(32)], codes, [np.uint32(32)]])
    codes = codes[1:][(codes[1:] != 32) | (codes[:-1] != 32)]
    if not (codes != 32).any():
        return np.zeros(0, np.int64), np.zeros(0)
    codes = np.concatenate([[np.uint32(32)], codes]) if codes[0] != 32 else codes
    total, rolled = np.zeros(DIM, np.int64), np.zeros(len(codes), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        if len(codes) < n:
            break
        rolled = rolled[: len(codes) - n + 1] * np.uint32(0x9E3779B1) + codes[n - 1 :] + np.uint32(n)
        if n in ORDERS:
            mixed = rolled ^ (rolled >> np.uint32(15))
            total += np.bincount((mixed * np.uint32(0x85EBCA6B)) >> np.uint32(32 - 15), minlength=DIM)
    at = np.flatnonzero(total)
    return at, total[at]


@dataclass(frozen=True)
class Model:
    """langs in order, weights (DIM + 1, langs; the last row is the bias), idf and temperature."""

    langs: tuple[str, ...]
    weights: np.ndarray
    idf: np.ndarray
    temperature: float = 1.0

    def features(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts) * self.idf[at]
        return x / max(1e-12, math.sqrt(float(x @ x)))

    def logits(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.features(at, counts) @ self.weights[at] + self.weights[DIM]

    def predict(self, text: str | None) -> tuple[str, float]:
        at, counts = grams(text)
        if not len(at) or not self.langs:
            return "und", 0.0
        p = softmax(self.logits(at, counts) / self.temperature)
        best = int(p.argmax())
        return self.langs[best], float(p[best])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, epochs: int = EPOCHS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2, seed: int = 0) -> np.ndarray:
    """Per-coordinate follow-the-regularised-leader (proximal) for the multinomial logistic loss."""
    z, n = np.zeros((DIM + 1, classes)), np.zeros((DIM + 1, classes))

    def solve(zs: np.ndarray, ns: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zs) <= l1, 0.0, -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(ns)) / alpha + l2))

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, x, label = rows[i]
            w = solve(z[at], n[at])
            p = softmax(x @ w)
            p[label] -= 1
            g = x[:, None] * p[None, :]
            grown = n[at] + g * g
            z[at] += g - (np.sqrt(grown) - np.sqrt(n[at])) / alpha * w
            n[at] = grown
    return solve(z, n)


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, by golden section on its logarithm. The labels are smoothed by one row in
    as many as there are, so that a sample without errors doesn't claim certainty."""
    if not len(labels) or logits.shape[1] < 2:
        return 1.0
    doubt = 1 / (len(labels) + 1)

    def loss(t: float) -> float:
        x = logits / math.exp(t)
        x = x - x.max(axis=1, keepdims=True)
        x = x - np.log(np.exp(x).sum(axis=1, keepdims=True))
        own = x[np.arange(len(labels)), labels]
        return -float(((1 - doubt) * own + doubt * (x.sum(axis=1) - own) / (x.shape[1] - 1)).mean())

    a, b, r = math.log(0.05), math.log(20.0), (math.sqrt(5) - 1) / 2
    for _ in range(50):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) <= loss(d) else (c, b)
    return math.exp((a + b) / 2)


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learn from all rows of df that have a text and a language."""
    rows = df.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(F.col(lang_col)).count().collect()}
    langs = tuple(sorted(counts, key=lambda x: x.encode()))
    if not langs:
        return Model((), np.zeros((DIM + 1, 0)), np.ones(DIM))
    share = max(LEAST_ROWS, sample_rows // len(langs))
    unit = F.pmod(F.xxhash64(F.lit("sample"), id_col), F.lit(1 << 30)) / float(1 << 30)
    rate = F.get(F.lit([min(1.0, share / counts[x]) for x in langs]), F.array_position(F.lit(list(langs)), F.col(lang_col)).cast("int") - 1)
    picked = rows.select(F.col(text_col), F.when(unit < rate, F.col(lang_col)).alias("lang"), (F.pmod(F.xxhash64(F.lit("fold"), id_col), F.lit(5)) == 0).alias("aside"), F.xxhash64(id_col).alias("at"))

    def run(batches):
        df_counts, seen = np.zeros((DIM, 1)), 0
        for batch in batches:
            out = []
            for text, lang, aside, place in zip(*batch.columns):
                at, n = grams(text.as_py())
                if not len(at):
                    continue
                df_counts[at] += 1
                seen += 1
                if lang.as_py() is not None:
                    out.append((lang.as_py(), aside.as_py(), place.as_py(), at.astype("<u2").tobytes(), n.astype("<u4").tobytes()))
            kinds = (pa.string(), pa.bool_(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.nulls(len(out), pa.int64()), pa.nulls(len(out), pa.int64()), pa.nulls(len(out), pa.binary()), *(pa.array([x[i] for x in out], k) for i, k in enumerate(kinds))], names=["part", "slice", "data", "lang", "aside", "at", "grams", "counts"])
        if seen:
            for part in array_parts([df_counts], TaskContext.get().partitionId()):
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.nulls(1, k) for k in kinds)], names=["part", "slice", "data", "lang", "aside", "at", "grams", "counts"])

    found = cut(map_arrow(picked, run, PARTS + ", lang string, aside boolean, at long, grams binary, counts binary"), "grams")
    (frequency,) = summed(found.where("data is not null").select("part", "slice", "data"), rows.rdd.getNumPartitions(), [1], DIM)
    total = sum(counts.values())
    blank = Model(langs, np.zeros((DIM + 1, len(langs))), np.log((1 + total) / (1 + frequency[:, 0])) + 1)
    sample = sorted(found.where("lang is not null").select("lang", "aside", "at", "grams", "counts").collect(), key=lambda r: (r["at"], r["lang"], r["grams"]))
    train, aside = [], []
    for r in sample:
        at, n = np.frombuffer(r["grams"], "<u2").astype(np.int64), np.frombuffer(r["counts"], "<u4").astype(float)
        x = np.append(blank.features(at, n), 1.0)
        (aside if r["aside"] else train).append((np.append(at, DIM), x, langs.index(r["lang"])))
    weights = ftrl(train or aside, len(langs))
    logits = np.array([x @ weights[at] for at, x, _ in aside]).reshape(len(aside), len(langs))
    return Model(langs, weights.astype(np.float32), blank.idf, fit_temperature(logits, np.array([y for _, _, y in aside], int)))


def identify(df: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of df (all by default) with lang_pred and score, from the text alone. The model's size is fixed
    by DIM and the languages."""
    keep = [c for c in keep or df.columns if c not in ("lang_pred", "score")]
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        predict = shared.value.predict
        for batch in batches:
            found = [predict(x.as_py()) for x in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=[*keep, "lang_pred", "score"])

    return map_arrow(df.select(*keep, F.col(text_col).alias("__text")), run, "lang_pred string, score double", keep)


def held_out(id_col: str = "doc_id") -> Column:
    return remainder(id_col, 4) == 2


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out()).select("doc_id", "text", "lang"))
    return identify(docs.withColumn("held_out", held_out()), model, keep=["doc_id", "held_out"])
