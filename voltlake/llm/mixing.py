"""Mixing sources to target weights by entropy balancing.

Units are documents: each has rate r, 1 before the mix, and among the rates that meet a source's constraints entropy
balancing takes those of least relative entropy to 1. With the token constraint sum(size * r) = target these are tilted
exponentially, r = exp(a * u) with u = size over the source's mean size, at most `cap`: a source with too many words
loses its long documents first, one with too few repeats them first. A `length_shift` adds a second constraint, that
the words taken have a mean logarithm of length larger by so much than the source's, and a second tilt,
r = exp(a * u + b * u * (z - length_shift)) with z the logarithm less its mean. (a, b) solves the convex dual
sum(phi(tilt)) - a * target / mean. Newton iterations start at 0 for all sources at once; gradient, curvature and the
dual at several lengths of the last step are sums over all documents, by classes of equal (source, size), whose rates
are equal, and the length with the least dual is kept. It is an error if they do not converge. Rates are rounded to
whole copies along descending lengths (cumulated rates are rounded, so a source is off by less than its longest
document), then single copies mend what is left.

Edge cases: a null text has size 0; a null source is a source of its own, last in order; documents without words
take none; a source whose target is `cap` times its size takes all its documents so often; rows with equal ids, sources
and sizes are taken alike, and so are rows without id if their texts are equal too; columns named size, source_size,
target, copies, taken are replaced; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, cut, read

WEIGHTS, CAP, SALTS, STEPS, MENDS = (5.0, 2.0, 1.0), 3, 256, 60, 4
#: Sources a task ranks; shares of a Newton step that are tried at once; how far from its target, in proportion, a source may be.
RANGE_SOURCES, LENGTHS, TOLERANCE = 100_000, (1.0, 0.5, 0.25, 1 / 16, 1 / 256), 1e-9
#: Where cumulated rates are rounded: no simple fraction, so no rate of a few digits falls on a boundary.
PHASE = 0.41421356


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """Of (source, source_size): sid, weight and target. Weights repeat in code point order, null last; a target stops at
    cap times its source's size and the excess is shared again: target = min(cap * size, weight * level). Sources are
    ranked by ranges, the level is a sum over all of them, once for each time that more sources stop."""
    ranges = max(1, -(-sources.count() // RANGE_SOURCES))
    order = F.col("source").asc_nulls_last()
    dealt = sources if ranges == 1 else sources.repartitionByRange(ranges, order)
    dealt = cut(dealt.withColumn("range", F.spark_partition_id() if ranges > 1 else F.lit(0)), "sources")
    before = F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    starts = dealt.groupBy("range").agg(F.count("*").alias("n")).select("range", F.coalesce(before, F.lit(0)).alias("start"))  # a row a range
    ranked = dealt.join(starts, "range").withColumn("sid", F.col("start") + F.row_number().over(Window.partitionBy("range").orderBy(order)))
    turn = F.pmod(F.col("sid") - 1, F.lit(len(weights))).cast("int")
    ranked = cut(ranked.select("source", "source_size", "sid", F.get(F.array(*map(F.lit, weights)), turn).alias("weight")), "ranked")
    level, stopped, most = 0.0, -1, cap * F.col("source_size").cast("double")
    while True:
        stops = F.col("weight") * level > most
        total, full, open_weight, now = ranked.agg(F.sum("source_size"), F.sum(F.when(stops, most)), F.sum(F.when(~stops, F.col("weight"))), F.count_if(stops)).first()
        if now == stopped:
            return ranked.withColumn("target", F.least(most, F.col("weight") * level))
        stopped, level = now, ((total or 0) - (full or 0.0)) / open_weight if open_weight else 0.0


def balance(classes: DataFrame, goals: DataFrame, cap: float, length_shift: float, steps: int = STEPS) -> tuple[DataFrame, int]:
    """(sid, a, b) of the dual, and after how many sums over all classes (sid, size, n, u, z); goals: (sid, source_size, target, mean)."""
    some = (F.col("target") > 0) & (F.col("target") < cap * F.col("source_size") * (1 - 1e-12))
    goal, zero = F.col("target") / F.col("mean"), F.lit(0.0)
    dual = cut(goals.where(some).select("sid", goal.alias("goal"), zero.alias("a"), zero.alias("b"), zero.alias("step_a"), zero.alias("step_b")), "dual")
    top = float(np.log(cap))
    tilt = F.col("a") * F.col("u") + F.col("b") * F.col("v")
    inside = F.col("x") < top
    rate = F.exp(F.least(F.col("x"), F.lit(top)))
    sums = {
        "phi": F.when(inside, rate).otherwise(cap * (F.col("x") - top + 1)), "g": rate * F.col("u"), "k": rate * F.col("v"),
        "gg": F.when(inside, rate * F.col("u") * F.col("u")).otherwise(0.0), "gk": F.when(inside, rate * F.col("u") * F.col("v")).otherwise(0.0), "kk": F.when(inside, rate * F.col("v") * F.col("v")).otherwise(0.0),
    }
    rows = classes.where("size > 0").withColumn("v", F.col("u") * (F.col("z") - length_shift) if length_shift else F.lit(0.0)).select("sid", "n", "u", "v")
    for k in range(1, steps + 1):
        lengths = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(t).alias("t")) for i, t in enumerate(LENGTHS if k > 1 else (0.0,))))
        tried = dual.withColumn("l", F.explode(lengths)).select("sid", "goal", (F.col("a") - F.col("l.t") * F.col("step_a")).alias("a"), (F.col("b") - F.col("l.t") * F.col("step_b")).alias("b"), "l.i")
        summed = rows.join(tried, "sid").withColumn("x", tilt).groupBy("sid", "goal", "a", "b", "i").agg(*(F.sum(F.col("n") * v).alias(c) for c, v in sums.items()))
        best = F.min_by(F.struct("goal", "a", "b", *sums), F.struct(F.col("phi") - F.col("a") * F.col("goal"), F.col("i"))).alias("s")
        at = summed.groupBy("sid").agg(best).select("sid", "s.*").withColumn("g", F.col("g") - F.col("goal"))
        off = F.greatest(F.abs("g"), F.abs("k")) / F.col("goal")
        det = F.col("gg") * F.col("kk") - F.col("gk") * F.col("gk")
        flat = F.coalesce(F.try_divide("g", "gg"), F.signum("g"))  # only the token constraint bends
        both = det > 1e-12 * F.col("gg") * F.col("kk")
        step_a = F.when(both, (F.col("g") * F.col("kk") - F.col("k") * F.col("gk")) / det).otherwise(flat)
        step_b = F.when(both, (F.col("k") * F.col("gg") - F.col("g") * F.col("gk")) / det).otherwise(0.0)
        dual = cut(at.select("sid", "goal", "a", "b", step_a.alias("step_a"), step_b.alias("step_b"), off.alias("off")), "dual")
        if (dual.agg(F.max("off")).first()[0] or 0.0) <= TOLERANCE:
            return dual.select("sid", "a", "b"), k
    raise RuntimeError(f"the dual has not converged after {steps} Newton iterations")


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", size: Column | None = None, weights=WEIGHTS, cap: int = CAP, length_shift: float = 0.0, salts: int = SALTS, tie: Column | None = None) -> DataFrame:
    """df with size (the words of text_col, or `size`), source_size, target, copies and taken = copies * size. tie: a hash
    that tells apart rows without id, by default that of text_col if df has it."""
    size = word_count(text_col) if size is None else size
    tie = F.xxhash64(text_col) if tie is None and text_col in df.columns else tie
    pick = F.xxhash64(id_col) if tie is None else F.when(F.col(id_col).isNull(), F.xxhash64(F.lit(0), tie)).otherwise(F.xxhash64(id_col))
    keys = {"__source": F.col(source_col), "__size": size, "__salt": F.pmod(pick, F.lit(salts)).cast("int"), "__pick": pick}
    rows = cut(df.select(*(v.alias(k[2:]) for k, v in keys.items())), "rows")
    counts = rows.groupBy("source", "size").agg(F.count("*").alias("n"))
    goals = cut(targets(counts.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")), weights, cap), "goals")
    salted = rows.groupBy("source", "size", "salt").agg(F.count("*").alias("n"))
    named = goals.select(F.col("source").alias("__source"), "sid", "source_size")
    salted = cut(salted.join(named, F.col("source").eqNullSafe(F.col("__source"))).select("sid", "size", "salt", "n", "source_size"), "salted")
    classes = salted.groupBy("sid", "size").agg(F.sum("n").alias("n"))
    log = F.log(F.greatest("size", F.lit(1)))
    words = F.col("n") * F.col("size")
    means = classes.groupBy("sid").agg(F.try_divide(F.sum(words * log), F.sum(words)).alias("log_mean"), F.try_divide(F.sum(words).cast("double"), F.sum(F.when(F.col("size") > 0, F.col("n")))).alias("mean"))
    means = cut(means, "means")
    scaled = classes.join(means, "sid").withColumns({"u": F.col("size") / F.coalesce("mean", F.lit(1.0)), "z": log - F.coalesce("log_mean", F.lit(0.0))})
    classes = cut(scaled.drop("mean", "log_mean"), "classes", salted.count())
    n_classes = classes.count()
    dual, _ = balance(classes, goals.join(means, "sid"), cap, length_shift)

    tilted = F.exp(F.least(F.col("a") * F.col("u") + F.col("b") * F.col("u") * (F.col("z") - length_shift), F.lit(float(np.log(cap)))))
    rate = F.when((F.col("size") == 0) | (F.col("target") <= 0), 0.0).otherwise(F.coalesce(tilted, F.lit(float(cap))))  # no dual: all that may be taken
    upto = F.sum(F.col("n") * F.col("r")).over(Window.partitionBy("sid").orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, 0))
    goal = goals.select("sid", "target")
    rounded = classes.join(goal, "sid").join(dual, "sid", "left").withColumn("r", rate).withColumn("c", upto)
    k = F.floor(F.col("c") + PHASE) - F.floor(F.col("c") - F.col("n") * F.col("r") + PHASE)
    chosen = cut(rounded.select("sid", "size", "n", F.greatest(F.lit(0), F.least(cap * F.col("n"), k)).cast("long").alias("k")), "chosen", n_classes)
    for _ in range(MENDS):  # one copy more or less of one document whose length is nearest to what a source is off
        left = chosen.groupBy("sid").agg(F.sum(F.col("k") * F.col("size")).alias("got")).join(goal, "sid").select("sid", (F.col("target") - F.col("got")).alias("left"))
        can = F.when(F.col("left") > 0, F.col("k") < cap * F.col("n")).otherwise(F.col("k") > 0)
        near = F.abs(F.abs(F.col("left")) - F.col("size"))
        best = chosen.join(left, "sid").where(can & (near < F.abs(F.col("left")))).groupBy("sid").agg(F.min_by(F.struct("size", F.signum("left").cast("long").alias("by")), F.struct(near, F.col("size"))).alias("best")).select("sid", "best.size", "best.by")
        chosen = cut(chosen.join(best, ["sid", "size"], "left").select("sid", "size", "n", (F.col("k") + F.coalesce("by", F.lit(0))).alias("k")), "chosen", n_classes)

    before = F.coalesce(F.sum("n").over(Window.partitionBy("sid", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    plan = salted.withColumn("before", before).join(chosen.select("sid", "size", F.floor(F.col("k") / F.col("n")).alias("base"), (F.col("k") % F.col("n")).alias("extra")), ["sid", "size"])
    plan = plan.join(goals.select("sid", "source", "target"), "sid").withColumn("here", F.greatest(F.lit(0), F.least(F.col("n"), F.col("extra") - F.col("before"))))
    # the k copies of a class: `base` of each document, one more of the first `extra` by salt and hash
    some = plan.where((F.col("here") > 0) & (F.col("here") < F.col("n"))).select(F.col("source").alias("s"), F.col("size").alias("z"), F.col("salt").alias("t"), "here")
    rank = F.row_number().over(Window.partitionBy("s", "z", "t").orderBy("pick"))
    last = rows.join(some, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")) & (F.col("salt") == F.col("t"))).withColumn("rank", rank)
    last = last.where("rank = here").select("s", "z", "t", F.col("pick").alias("last"))
    plan = plan.join(last, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")) & (F.col("salt") == F.col("t")), "left")
    upto_pick = F.when(F.col("here") == 0, F.lit(None)).when(F.col("here") == F.col("n"), F.lit((1 << 63) - 1)).otherwise(F.col("last"))
    plan = cut(plan.select(F.col("source").alias("__s"), F.col("size").alias("__z"), F.col("salt").alias("__t"), F.col("source_size").alias("__all"), F.col("target").alias("__goal"), F.col("base").alias("__base"), upto_pick.alias("__last")), "plan")
    joined = df.withColumns(keys).join(plan.hint("merge"), F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__size") == F.col("__z")) & (F.col("__salt") == F.col("__t")))
    copies = (F.col("__base") + F.when(F.col("__pick") <= F.col("__last"), 1).otherwise(0)).cast("int")
    put = {"size": F.col("__size"), "source_size": F.col("__all"), "target": F.col("__goal"), "copies": copies, "taken": copies * F.col("__size")}
    return joined.withColumns(put).select(*(c for c in df.columns if c not in put), *put)


def repeat(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mix itself: each document as often as it is taken."""
    return mixed.where("copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), "copies"))).select(*columns)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", word_count("text").alias("size"), F.when(F.col("doc_id").isNull(), F.xxhash64("text")).alias("tie"))
    return mix(cut(docs, "sizes"), size=F.col("size"), tie=F.col("tie")).select("doc_id", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"))
