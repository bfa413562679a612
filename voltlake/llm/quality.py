"""Quality rules learned from labelled statistics.

Text statistics are DataFrame expressions. A decision list is learned by sequential covering: rules are conjunctions
of thresholds that grow by information gain on two thirds of the labelled rows, are pruned on the rest, and are
kept while they are precise there. All labelled rows count: they are summed by the cells that the thresholds cut
(at most (cuts + 1) ** features of them, which alone reach the driver). The list becomes one conditional expression.

Edge cases: null and empty texts have no words and fail the base rules; rows without a label, with a null label or
with a null id are judged but not learned from; equal ids count once for each pair of row and label; without labels
of both kinds the list is empty; columns with the names of the statistics, base_failed or kept are replaced; an
empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, cut, let, read, words

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
#: What thresholds are set on, from the statistics.
FEATURES = {
    "words": "cast(n_words as double)", "word_length": "try_divide(word_chars, n_words)", "symbols_per_word": "try_divide(n_symbols, n_words)",
    "dup_line_share": "try_divide(n_dup_lines, n_lines)", "repeat_share": "try_divide(n_repeat_words, n_words)",
}
QUANTILES = (0.02, 0.1, 0.5, 0.9, 0.98)
MIN_PRECISION, MIN_ROWS, MAX_TERMS, MAX_RULES, RUN = 0.9, 5, 3, 12, 5


def repeat_words(w: Column, run: int = RUN) -> Column:
    """The words that are in a window of `run` words found twice or more."""

    def covered(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = lambda s: F.filter(s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]))
        places = let(ordered, lambda s: F.sort_array(F.transform(F.coalesce(twice(s), F.array()), lambda x: x["i"])))
        return let(places, lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(run), F.coalesce(F.get(p, k + 1) - x, F.lit(run)))), F.lit(0), lambda a, b: a + b))

    hashes = F.transform(F.sequence(F.lit(0), F.size(w) - run), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(run))))
    of = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))
    return F.when(F.size(w) > run, of).otherwise(F.lit(0))


def with_stats(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with STATS and base_failed, all from the whole text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    of_words = let(words(text), lambda w: F.struct(F.size(w).alias("n"), F.char_length(F.array_join(w, "")).alias("chars"), repeat_words(w).alias("repeats")))
    of_lines = let(F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD)), lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dups")))
    out = df.drop(*STATS, "base_failed", "kept", "__w", "__l").withColumns({"__w": of_words, "__l": of_lines, "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long")})
    out = out.withColumns({"n_words": F.col("__w.n").cast("long"), "word_chars": F.col("__w.chars").cast("long"), "n_dup_lines": F.col("__l.dups").cast("long"), "n_repeat_words": F.col("__w.repeats").cast("long"), "n_lines": F.col("__l.n").cast("long")}).drop("__w", "__l")
    return out.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


@dataclass(frozen=True)
class Term:
    """feature > value, or feature <= value."""

    feature: str
    above: bool
    value: float

    def column(self) -> Column:
        x = F.expr(FEATURES[self.feature])
        return x > self.value if self.above else x <= self.value


def learn(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> list[list[Term]]:
    """Rules that reject, in order, from the labelled rows of stats that pass the base rules; label 0 is bad."""
    label = labels.select(F.col(id_col).alias("__id"), (F.col(label_col) == 0).alias("bad")).where("bad is not null")
    rows = stats.where("not base_failed").join(label, F.col(id_col) == F.col("__id")).select("bad", (F.pmod(F.xxhash64("__id"), F.lit(3)) == 0).alias("prune"), *(F.expr(e).alias(f) for f, e in FEATURES.items()))
    rows = cut(rows, "labelled")
    found = rows.groupBy("bad").agg(*(F.percentile_approx(f, list(QUANTILES), 10_000).alias(f) for f in FEATURES)).collect()
    if len(found) < 2:
        return []
    cuts = {f: sorted({v for r in found for v in r[f]}) for f in FEATURES}
    bins = [sum((F.when(F.col(f) > v, 1).otherwise(0) for v in c), F.lit(0)).alias(f) for f, c in cuts.items()]
    cells = rows.groupBy(*bins, "bad", "prune").agg(F.count("*").alias("n")).toPandas()
    x = cells[list(FEATURES)].to_numpy()
    return cover(x, cells["n"].to_numpy().astype(float), cells["bad"].to_numpy(bool), cells["prune"].to_numpy(bool), list(cuts.items()))


def cover(x: np.ndarray, n: np.ndarray, bad: np.ndarray, prune: np.ndarray, cuts: list[tuple[str, list[float]]]) -> list[list[Term]]:
    """Sequential covering over cells: x[i, j] is how many cuts of feature j lie below the rows of cell i."""
    tests = [(j, k, above) for j, (_, c) in enumerate(cuts) for k in range(len(c)) for above in (True, False)]
    masks = [x[:, j] > k if above else x[:, j] <= k for j, k, above in tests]
    left, rules = np.ones(len(n), bool), []

    def counts(mask: np.ndarray, part: np.ndarray) -> tuple[float, float]:
        own = n * (mask & left & part)
        return own[bad].sum(), own[~bad].sum()

    while len(rules) < MAX_RULES:
        mask, terms = np.ones(len(n), bool), []
        while len(terms) < MAX_TERMS:
            p, q = counts(mask, ~prune)
            if not p or not q:
                break
            best = (1e-9, None)
            for t, m in enumerate(masks):
                p1, q1 = counts(mask & m, ~prune)
                if p1 >= MIN_ROWS and (gain := p1 * (np.log2(p1 / (p1 + q1)) - np.log2(p / (p + q)))) > best[0] + 1e-9:
                    best = (gain, t)
            if best[1] is None:
                break
            terms.append(best[1])
            mask = mask & masks[best[1]]
        if not terms:
            break
        worth = []
        for k in range(1, len(terms) + 1):
            own = np.logical_and.reduce([masks[t] for t in terms[:k]])
            p, q = counts(own, prune)
            worth.append(((p - q) / (p + q) if p + q else -1.0, -k))
        terms = terms[: -max(worth)[1]]
        mask = np.logical_and.reduce([masks[t] for t in terms])
        (p, q), (p1, q1) = counts(mask, prune), counts(mask, ~prune)
        if p + p1 < MIN_ROWS or p + p1 < MIN_PRECISION * (p + p1 + q + q1) or p < MIN_PRECISION * (p + q):
            break
        rule = []
        for j, k, above in (tests[t] for t in terms):
            name, c = cuts[j]
            # a cut lies on a row's value: between two cuts there is room for rows just beyond the good ones
            rule.append(Term(name, above, (c[k] + c[k + 1]) / 2 if above and k + 1 < len(c) else c[k]))
        rules.append(rule)
        left = left & ~mask
    return rules


def verdict(rules: list[list[Term]]) -> Column:
    """true to keep: the ordered conditional expression of the list, after the base rules."""
    out = F.when(F.col("base_failed"), F.lit(False))
    for rule in rules:
        hit = rule[0].column()
        for term in rule[1:]:
            hit = hit & term.column()
        out = out.when(hit, F.lit(False))
    return out.otherwise(F.lit(True))


def judge(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """df with STATS, base_failed and kept."""
    stats = cut(with_stats(df, text_col), "stats")
    return stats.withColumn("kept", verdict(learn(stats, labels, id_col, label_col)))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = cut(with_stats(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"), "stats")
    rules = learn(stats, read(spark, sf_dir, "labels"))
    return stats.withColumn("kept", verdict(rules)).select("doc_id", *STATS[:5], "base_failed", "kept")
