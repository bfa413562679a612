"""Language-model scoring with a hidden Markov model.

Words are counted over all training documents. The model's symbols are the end of a text, the HEAD most frequent
words, and classes of all other words by their last letters; a word of a class has the share (c + 1) / (n + v + 1)
of it, where c is its own count, n the class's words, v its distinct words, and unknown words share the last 1. So
the model is a distribution over texts, and the counts of all words enter it. Baum-Welch trains the states: each
task sums expected counts over all its training documents, each whole; the sums, of a size fixed by symbols and states, are merged in steps and the model sent out again. It starts from a few iterations on a small sample. The
scaled forward recursion over the whole text is the exact likelihood. Words outside of HEAD meet their counts in a
join by hash.

Edge cases: null, empty and blank texts are the end alone; a null id counts as empty text in the folds; without
training documents all symbols are equally likely; words are known by 64-bit hashes; repeated rows are scored alike;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import PARTS, array_parts, cut, lower_ascii, map_arrow, read, remainder, split_words, summed

CLASSES, SYMBOLS, STATES, BATCH = 512, 1 << 15, 8, 1 << 17
HEAD = SYMBOLS - CLASSES - 1
#: Words found less often stay in their class, so that classes have seen rare words on small inputs too.
LEAST = 3
ROUNDS, SAMPLE_TOKENS, SAMPLE_TEXTS, SAMPLE_ROUNDS, PRIOR = 2, 1 << 18, 4096, 25, 500.0
#: Words that a task keeps in memory at once.
KEPT_WORDS = 400_000


def word_hash(word: str) -> int:
    h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def word_class(word: str) -> int:
    return zlib.crc32(word[-3:].encode("utf-8", "surrogatepass")) % CLASSES


def count_words(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(h, cls, n) of each distinct word."""

    def run(batches):
        counts: dict[str, int] = {}

        def rows():
            out = [pa.array([word_hash(w) for w in counts], pa.int64()), pa.array([word_class(w) for w in counts], pa.int32()), pa.array(list(counts.values()), pa.int64())]
            counts.clear()
            return pa.RecordBatch.from_arrays(out, names=["h", "cls", "n"])

        for batch in batches:
            for text in batch.column(0):
                for w in split_words(lower_ascii(text.as_py() or "")):
                    counts[w] = counts.get(w, 0) + 1
                if len(counts) > KEPT_WORDS:
                    yield rows()
        yield rows()

    return map_arrow(df.select(text_col), run, "h long, cls int, n long").groupBy("h").agg(F.min("cls").alias("cls"), F.sum("n").alias("n"))


@dataclass(frozen=True)
class Vocabulary:
    """hashes of the head words (symbol i + 1), counts by symbol, and by class log10(n + v + 1). total: N; distinct: V."""

    head: tuple[int, ...]
    counts: np.ndarray
    class_mass: np.ndarray
    total: int
    distinct: int


def vocabulary(words: DataFrame, documents: int) -> Vocabulary:
    """Of the counts of words, and the number of texts (each has an end)."""
    by_class = {r["cls"]: r for r in words.groupBy("cls").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}
    # the least count that HEAD words at most reach, to an eighth of a power of two: a sum of under 600 rows, no global sort
    step = F.floor(8 * F.log2("n")).alias("step")
    least, reached = 64 * 8, 0
    for r in sorted(words.where(F.col("n") >= LEAST).groupBy(step).agg(F.count("*").alias("v")).collect(), reverse=True):
        if (reached := reached + r["v"]) > HEAD:
            break
        least = r["step"]
    head = words.where((F.col("n") >= LEAST) & (step >= least)).collect()
    head.sort(key=lambda r: (-r["n"], r["h"]))
    counts, n, v = np.zeros(SYMBOLS, np.int64), np.zeros(CLASSES), np.zeros(CLASSES)
    counts[0] = documents
    for c, r in by_class.items():
        n[c], v[c] = r["n"], r["v"]
    total, distinct = int(n.sum()) + documents, int(v.sum()) + bool(documents)
    for i, r in enumerate(head):
        counts[i + 1] = r["n"]
        n[r["cls"]] -= r["n"]
        v[r["cls"]] -= 1
    counts[HEAD + 1 :] = n
    return Vocabulary(tuple(r["h"] for r in head), counts, np.log10(n + v + 1), total, distinct)


class Codes(dict):
    """word -> symbol; `tail` has the hashes of words outside of the head. Forgets when large."""

    def __init__(self, head: tuple[int, ...]):
        self.head, self.tail = {h: i + 1 for i, h in enumerate(head)}, {}

    def __missing__(self, word: str) -> int:
        h = word_hash(word)
        symbol = self.head.get(h)
        if symbol is None:
            self.tail[word] = h
            symbol = HEAD + 1 + word_class(word)
        self[word] = symbol
        return symbol

    def encode(self, text: str | None) -> tuple[np.ndarray, list[int]]:
        """(symbols with the end, hashes of the words outside of the head)."""
        if len(self) > KEPT_WORDS:
            self.clear()
            self.tail.clear()
        found = split_words(lower_ascii(text or ""))
        symbols = np.fromiter(map(self.__getitem__, found), np.uint16, len(found))
        tail = self.tail
        return np.append(symbols, np.uint16(0)), [tail[found[i]] for i in np.flatnonzero(symbols > HEAD).tolist()]


def encode(df: DataFrame, vocab: Vocabulary, text_col: str) -> DataFrame:
    """df without text_col, with symbols (uint16 bytes) and tail (hashes)."""
    head = df.sparkSession.sparkContext.broadcast(vocab.head)  # HEAD longs at most
    columns = [c for c in df.columns if c != text_col]

    def run(batches):
        codes = Codes(head.value)
        for batch in batches:
            found = [codes.encode(x.as_py()) for x in batch.column(len(columns))]
            offsets = np.cumsum([0, *(len(t) for _, t in found)])
            tail = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array([h for _, t in found for h in t], pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([s.tobytes() for s, _ in found], pa.binary()), tail], names=[*columns, "symbols", "tail"])

    return map_arrow(df.select(*columns, text_col), run, "symbols binary, tail array<bigint>", columns)


# --- the model


@dataclass(frozen=True)
class Model:
    """start (K), move (K, K) and emit (SYMBOLS, K)."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray

    def forward(self, texts: list[np.ndarray]) -> np.ndarray:
        """The natural logarithm of the likelihood of each text, which has one symbol at least."""
        sizes = np.array([len(t) for t in texts])
        order = np.argsort(-sizes, kind="stable")
        sizes, flat = sizes[order], np.concatenate([texts[i] for i in order]) if len(texts) else np.zeros(0, np.uint16)
        at, out, alpha = np.cumsum(sizes) - sizes, np.zeros(len(texts)), None
        alive = len(sizes) - np.searchsorted(sizes[::-1], np.arange(sizes[0] if len(sizes) else 0), "right")
        for t, n in enumerate(alive.tolist()):
            seen = self.emit[flat[at[:n] + t]]
            alpha = self.start * seen if alpha is None else (alpha[:n] @ self.move) * seen
            scale = alpha.sum(axis=1)
            alpha /= scale[:, None]
            out[:n] += np.log(scale)
        back = np.empty_like(out)
        back[order] = out
        return back

    def expect(self, texts: list[np.ndarray]) -> np.ndarray:
        """Expected counts over whole texts: rows of emissions by symbol, then of moves, then of starts, and the log
        likelihood. All texts go on in step, longest first; a text that has ended is in no later step."""
        k, texts = len(self.start), sorted(texts, key=len, reverse=True)
        sizes = np.array([len(t) for t in texts])
        steps, n = int(sizes[0]), len(texts)
        symbols = np.zeros((steps, n), np.intp)
        for i, t in enumerate(texts):
            symbols[: len(t), i] = t
        active = np.searchsorted(-sizes, -np.arange(steps), "left")  # texts longer than t
        move, seen = self.move.astype(np.float32), self.emit.astype(np.float32)[symbols]
        alpha, onward, scale = np.zeros_like(seen), np.zeros_like(seen), np.ones((steps, n), np.float32)
        now = self.start.astype(np.float32) * seen[0]
        for t, m in enumerate(active.tolist()):
            if t:
                now = (now[:m] @ move) * seen[t, :m]
            scale[t, :m] = own = now.sum(axis=1)
            now = now / own[:, None]
            alpha[t, :m] = now
        seen /= scale[:, :, None]
        beta, gamma, back = np.ones((n, k), np.float32), np.zeros_like(seen), np.ascontiguousarray(move.T)
        for t in range(steps - 1, -1, -1):
            m = active[t]
            gamma[t, :m] = alpha[t, :m] * beta[:m]
            if t:
                onward[t, :m] = ahead = seen[t, :m] * beta[:m]
                beta[:m] = ahead @ back
        moved = sum((a.T.astype(np.float64) @ b for a, b in zip(np.array_split(alpha[:-1].reshape(-1, k), 64), np.array_split(onward[1:].reshape(-1, k), 64))), np.zeros((k, k))) * self.move
        flat = symbols.ravel()
        emitted = np.stack([np.bincount(flat, gamma[:, :, j].ravel(), SYMBOLS) for j in range(k)], axis=1)
        return np.concatenate([emitted, moved, gamma[0].sum(axis=0, dtype=float)[None], np.full((1, k), np.log(scale).sum(dtype=float))])

    @staticmethod
    def from_counts(total: np.ndarray, base: np.ndarray, prior: float = PRIOR) -> Model:
        """The M-step, with `prior` tokens of the base distribution in each state."""
        k = total.shape[1]
        emit = total[:SYMBOLS] + prior * base[:, None]
        move, start = total[SYMBOLS : SYMBOLS + k] + 0.01, total[SYMBOLS + k] + 0.01
        return Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


ROWS = SYMBOLS + STATES + 2


def sum_counts(model: Model, texts) -> np.ndarray | None:
    """Expected counts over the symbols of many texts, in batches of about BATCH tokens whose lengths differ by less than 2."""
    total, held, sizes = None, {}, {}

    def add(own: list[np.ndarray]) -> None:
        nonlocal total
        counts = model.expect(own)
        total = counts if total is None else np.add(total, counts, out=total)

    for text in texts:
        k = len(text).bit_length()
        held.setdefault(k, []).append(text)
        sizes[k] = sizes.get(k, 0) + len(text)
        if sizes[k] >= BATCH:
            sizes[k] = 0
            add(held.pop(k))
    for own in held.values():
        add(own)
    return total


def base_distribution(vocab: Vocabulary) -> np.ndarray:
    return (vocab.counts + 1) / (vocab.counts.sum() + SYMBOLS)


def begin(texts: list[np.ndarray], base: np.ndarray, states: int = STATES, rounds: int = SAMPLE_ROUNDS) -> Model:
    """A first model from a sample: states that hardly change, each near some texts far from one another; then Baum-Welch."""
    counts = [np.bincount(t, minlength=SYMBOLS).astype(float) for t in texts[:512]]
    sharp = [np.sqrt(c / c.sum()) for c in counts] or [np.sqrt(base)]
    seeds = [int(np.argmax([len(t) for t in texts[:512]]))] if texts else []
    while texts and len(seeds) < min(states, len(sharp)):
        near = np.max([[float(sharp[s] @ x) for x in sharp] for s in seeds], axis=0)
        seeds.append(int(np.argmin(near - 1e-9 * np.array([len(t) for t in texts[:512]]))))
    rng = np.random.default_rng(7)
    emit = np.stack([base * (1 + 0.2 * rng.random(SYMBOLS)) + (0.5 * counts[seeds[j]] / counts[seeds[j]].sum() if j < len(seeds) else 0) for j in range(states)], axis=1)
    move = np.full((states, states), 0.02 / states) + 0.98 * np.eye(states)
    model = Model(np.full(states, 1 / states), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))
    for _ in range(rounds if texts else 0):
        model = Model.from_counts(sum_counts(model, texts), base, PRIOR)
    return model


def train(encoded: DataFrame, vocab: Vocabulary, rounds: int = ROUNDS) -> Model:
    """Baum-Welch over all rows of `encoded` (symbols, and pick: a uniform hash for the sample that begins it)."""
    base = base_distribution(vocab)
    some = encoded.where(F.col("pick") < min(1.0, SAMPLE_TOKENS / max(1, vocab.total))).select("pick", "symbols").orderBy("pick", "symbols").limit(SAMPLE_TEXTS).collect()
    model = begin([np.frombuffer(r["symbols"], np.uint16) for r in some], base)
    texts = encoded.select("symbols")
    for _ in range(rounds if vocab.total else 0):
        shared = texts.sparkSession.sparkContext.broadcast(model)  # SYMBOLS x STATES numbers

        def run(batches):
            total = sum_counts(shared.value, (np.frombuffer(x.as_py(), np.uint16) for b in batches for x in b.column(0)))
            if total is not None:
                yield from array_parts([total], TaskContext.get().partitionId())

        (total,) = summed(map_arrow(texts, run, PARTS), texts.rdd.getNumPartitions(), [STATES], ROWS)
        model = Model.from_counts(total, base)
        shared.unpersist()
    return model


def score(encoded: DataFrame, model: Model, vocab: Vocabulary) -> DataFrame:
    """encoded without symbols and tail, with n_tokens, n_head (known without the tail), head_logs (sum of log10(c + 1) of the
    end and head words) and model_score (log10 likelihood but for the counts of tail words)."""
    shared = encoded.sparkSession.sparkContext.broadcast((model, vocab.counts, vocab.class_mass))
    columns = [c for c in encoded.columns if c not in ("symbols", "tail", "pick")]

    def run(batches):
        model, counts, mass = shared.value
        head = np.zeros(SYMBOLS)
        head[: HEAD + 1] = np.log10(counts[: HEAD + 1] + 1)
        known, tail = np.zeros(SYMBOLS, np.int64), np.zeros(SYMBOLS)
        known[: HEAD + 1] = counts[: HEAD + 1] > 0
        tail[HEAD + 1 :] = mass
        for batch in batches:
            texts = [np.frombuffer(x.as_py(), np.uint16) for x in batch.column(len(columns))]
            logs = model.forward(texts) / np.log(10) - np.array([tail[t].sum() for t in texts])
            more = [np.array([len(t) for t in texts], np.int64), np.array([known[t].sum() for t in texts], np.int64), np.array([head[t].sum() for t in texts], float), logs]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *map(pa.array, more)], names=[*columns, "n_tokens", "n_head", "head_logs", "model_score"])

    return map_arrow(encoded.select(*columns, "symbols"), run, "n_tokens long, n_head long, head_logs double, model_score double", columns)


def score_documents(df: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, held_out, n_tokens, n_known, train_tokens, base_score and score of each row; learns where held_out is false."""
    docs = df.select(F.col(id_col).alias("__id"), held_out.alias("held_out"), F.xxhash64(id_col).alias("__hash"), F.col(text_col))
    learn = docs.where("not held_out")
    words = cut(count_words(learn, text_col), "words")
    vocab = vocabulary(words, learn.count())
    unit = (F.pmod(F.xxhash64(F.lit("sample"), "__hash"), F.lit(1 << 30)) / float(1 << 30)).alias("pick")
    encoded = cut(encode(docs.select("__id", "held_out", unit, text_col), vocab, text_col).withColumn("row", F.monotonically_increasing_id()), "encoded")
    model = train(encoded.where("not held_out"), vocab)
    scored = score(encoded, model, vocab)
    met = encoded.select("row", F.explode("tail").alias("h")).join(words.select("h", "n"), "h", "left")
    tail = met.groupBy("row").agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + 1)).alias("tail_logs"), F.count("n").alias("n_tail"))
    both = scored.join(tail, "row", "left").withColumns({"tail_logs": F.coalesce("tail_logs", F.lit(0.0)), "n_tail": F.coalesce("n_tail", F.lit(0))})
    lost = float(np.log10(vocab.total + vocab.distinct + 1))
    return both.select(
        F.col("__id").alias(id_col), "held_out", "n_tokens", (F.col("n_head") + F.col("n_tail")).alias("n_known"), F.lit(vocab.total).cast("long").alias("train_tokens"),
        (F.col("head_logs") + F.col("tail_logs") - F.col("n_tokens") * F.lit(lost)).alias("base_score"), (F.col("model_score") + F.col("tail_logs")).alias("score"),
    )


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(read(spark, sf_dir, "documents"), remainder("doc_id", 7) == 2)
