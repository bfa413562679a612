"""Exact quantiles of whole columns, without one task that holds all their values.

A first pass brackets each quantile by approximate ones beside it; a second counts what lies below and within; values are
gathered only where a bracket holds few of them, and a bracket that holds more is narrowed again, some thousand times at
a pass. A bracket of one value needs no gathering.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numeric

#: Values gathered for a quantile; the sketch's accuracy; columns of one pass.
SMALL, ACCURACY, CHUNK = 20_000, 10_000, 32


def exact_quantiles(df: DataFrame, columns: list[str], qs: list[float], small: int = SMALL) -> dict[str, list[float | None]]:
    """Of each column the quantiles by linear interpolation between order statistics; missing values and infinities are left
    out, and a column without values has None."""
    out: dict[str, list[float | None]] = {}
    for a in range(0, len(columns), CHUNK):
        out |= _quantiles(df, columns[a : a + CHUNK], qs, small)
    return out


def _quantiles(df: DataFrame, columns: list[str], qs: list[float], small: int) -> dict[str, list[float | None]]:
    rows = df.select(*(numeric(c).alias(f"x{i}") for i, c in enumerate(columns)))
    x, margin = [F.col(f"x{i}") for i in range(len(columns))], 2.0 / ACCURACY
    clip = lambda p: min(1.0, max(0.0, p))
    beside = [clip(q + s) for q in qs for s in (-margin, margin)]
    first = rows.agg(*(F.struct(F.count(v).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.percentile_approx(v, beside, ACCURACY).alias("at")).alias(f"s{i}") for i, v in enumerate(x))).first()
    n = [first[f"s{i}"]["n"] for i in range(len(columns))]
    rank = lambda i, j: (n[i] - 1) * qs[j]
    # (column, quantile) -> (lo, hi, rows below lo, rows within)
    todo = [(i, j) for i in range(len(columns)) if n[i] for j in range(len(qs))]
    held = {(i, j): (first[f"s{i}"]["lo"], first[f"s{i}"]["hi"], 0, n[i]) for i, j in todo}
    tried = {(i, j): (first[f"s{i}"]["at"][2 * j], first[f"s{i}"]["at"][2 * j + 1]) for i, j in todo}
    done: set[tuple[int, int]] = set()
    while True:
        wide = [k for k in todo if k not in done and held[k][3] > small and held[k][0] < held[k][1]]
        if not wide:
            break
        counted = rows.agg(*(F.struct(F.count_if(x[i] < F.lit(tried[i, j][0])).alias("below"), F.count_if(x[i].between(*tried[i, j])).alias("within")).alias(f"c{i}_{j}") for i, j in wide)).first()
        for i, j in wide:
            below, within = counted[f"c{i}_{j}"]
            before = held[i, j]
            if below <= math.floor(rank(i, j)) and math.ceil(rank(i, j)) < below + within:
                held[i, j] = (*tried[i, j], below, within)
            if held[i, j] == before:  # no progress: gather what is left
                done.add((i, j))
        wide = [k for k in wide if k not in done and held[k][3] > small and held[k][0] < held[k][1]]
        if wide:
            def near(i, j):
                lo, hi, below, within = held[i, j]
                p = ((math.floor(rank(i, j)) - below) / within, (math.ceil(rank(i, j)) - below + 1) / within)
                return F.percentile_approx(F.when(x[i].between(lo, hi), x[i]), [clip(p[0] - margin), clip(p[1] + margin)], ACCURACY)

            found = rows.agg(*(near(i, j).alias(f"c{i}_{j}") for i, j in wide)).first()
            tried |= {(i, j): tuple(found[f"c{i}_{j}"]) for i, j in wide}
    open_ = [k for k in todo if held[k][0] < held[k][1]]
    values: dict[tuple[int, int], list[tuple[float, int]]] = {(i, j): [(held[i, j][0], held[i, j][3])] for i, j in todo if (i, j) not in open_}
    if open_:
        met = F.array(*(F.when(x[i].between(*held[i, j][:2]), F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), x[i].alias("v"))) for i, j in open_))
        gathered = rows.select(F.explode(F.filter(met, lambda r: r.isNotNull())).alias("r")).groupBy("r.i", "r.j", "r.v").count().collect()
        for r in gathered:
            values.setdefault((r["i"], r["j"]), []).append((r["v"], r["count"]))

    def order_statistic(k: tuple[int, int], place: int) -> float:
        left = place - held[k][2]
        for v, count in values[k]:
            if left < count:
                return v
            left -= count
        raise AssertionError("a bracket doesn't hold its quantile")

    out: dict[str, list[float | None]] = {c: [None] * len(qs) for c in columns}
    for i, j in todo:
        values[i, j].sort()
        at = rank(i, j)
        low, high = order_statistic((i, j), math.floor(at)), order_statistic((i, j), math.ceil(at))
        out[columns[i]][j] = low + (high - low) * (at - math.floor(at))
    return out
