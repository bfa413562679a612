"""Trailing frames over the order of a whole table, without one task that holds it.

Rows go to ranges of the order columns and a hash of their content, whose bounds come from a sample by hash; row counts
of the ranges turn a place within a range into a place in the table. So a value that many rows share is split too, and
texts are ordered as numbers are. Rows are then dealt to blocks of places, and the last rows of a block go to the next
one too, where frames see them and results leave them out. Any bounds give the same result. A table of one block is
one window.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Rows of a block, ranges at most (beyond, a range grows and its sort spills), and rows sampled a range.
BLOCK_ROWS, MAX_RANGES, RANGE_SAMPLE = 200_000, 4096, 32


def last_within(bounds: list, key: Column, literal: Callable = F.lit) -> Column:
    """The last place in sorted bounds whose value is no larger than key, by bisection; 0 if there is none."""
    values, top = F.array(*map(literal, bounds)), 1 << max(0, len(bounds) - 1).bit_length()
    steps = F.array(*(F.lit(top >> i) for i in range(top.bit_length())))
    return F.aggregate(steps, F.lit(0), lambda lo, s: F.when((lo + s < len(bounds)) & (F.get(values, lo + s) <= key), lo + s).otherwise(lo))


def over_order(df: DataFrame, order: list[str], before: int, compute: Callable[[DataFrame, WindowSpec], DataFrame], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """compute(rows, window), whose frames reach back `before` rows at most; it has to keep the rows' columns."""
    block_rows, n = max(block_rows, before, 1), df.count()
    if n <= block_rows:
        return compute(df, Window.partitionBy().orderBy(*order))
    # rows that tie are told apart by their content, so that a range computed anew has the same places
    tie = F.xxhash64(*(F.col(c) for c, kind in df.dtypes if "map<" not in kind and kind != "variant"))
    ranges, kinds = min(MAX_RANGES, -(-n // block_rows)), dict(df.dtypes)
    unit = F.pmod(F.xxhash64(F.lit(1), tie), F.lit(1 << 30)) / float(1 << 30)
    sampled = df.where(unit < RANGE_SAMPLE * ranges / n).select(*order, tie.alias("__tie")).collect()
    sampled.sort(key=lambda r: [(v is not None, v) for v in r])
    bounds = sorted({i * len(sampled) // ranges for i in range(ranges)}) if sampled else []
    literal = lambda r: F.struct(*(F.lit(v).cast(kinds.get(c, "bigint")).alias(c) for c, v in zip((*order, "__tie"), r)))
    part = last_within([sampled[i] for i in bounds], F.struct(*order, F.col("__tie")), literal) if bounds else F.lit(0)
    rows = df.withColumn("__tie", tie).withColumn("__range", part)
    counts = rows.groupBy("__range").count()
    starts = counts.select("__range", F.coalesce(F.sum("count").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__start"))
    place = F.col("__start") + F.row_number().over(Window.partitionBy("__range").orderBy(*order, "__tie")) - 1
    placed = rows.join(F.broadcast(starts), "__range").withColumn("__place", place)  # MAX_RANGES rows at most
    block = F.floor(F.col("__place") / block_rows)
    own, next_one = (F.struct(b.alias("block"), F.lit(ghost).alias("ghost")) for b, ghost in ((block, False), (block + 1, True)))
    late = F.col("__place") % block_rows >= block_rows - before
    dealt = placed.withColumn("__to", F.explode(F.when(late, F.array(own, next_one)).otherwise(F.array(own)))).select(*df.columns, "__place", F.col("__to.block").alias("__block"), F.col("__to.ghost").alias("__ghost"))
    return compute(dealt, Window.partitionBy("__block").orderBy("__place")).where("not __ghost").drop("__place", "__block", "__ghost")
