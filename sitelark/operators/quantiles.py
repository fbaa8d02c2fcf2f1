"""Exact quantiles of columns of any size.

Like values are counted and written once; all wanted ranks are bracketed by sampled quantiles of the distinct values, counted, and bracketed again,
until few values are left. (Spark's exact percentile keeps every distinct value in one place; few_distinct tells where that is harmless.)
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import places
from ..shared import dropped, written

MOST_DISTINCT, MOST_LEFT, CUTS = 1_000_000, 100_000, 2000


def few_distinct(df: DataFrame, column: str, group: Sequence[str] = ()) -> bool:
    counts = df.groupBy(*group).agg(F.approx_count_distinct(column).alias("d"))
    return (counts.agg(F.max("d")).first()[0] or 0) <= MOST_DISTINCT


def values_at(df: DataFrame, column: str, ranks: Sequence[int], size: int, weight: str | None = None) -> list[float]:
    """The values at 0-based ranks among size values, all in the same few passes; weight: how often a row's value counts (1 without).

    Each round cuts the values by CUTS sampled quantiles, counts what lies on and between the cuts, and goes on with the pieces that hold a
    wanted rank. Values that equal a cut are a piece of their own and settle their ranks. Cuts decide on the number of rounds only.
    """
    wanted = sorted(set(ranks))
    times = F.col(weight) if weight else F.lit(1)
    if size <= MOST_LEFT or (weight and df.count() <= MOST_LEFT):
        found = sorted((r[0], r[1]) for r in df.select(column, times).toLocalIterator())  # at most MOST_LEFT values
        ends = list(accumulate(n for _, n in found))
        return [found[bisect_right(ends, r)][0] for r in ranks]
    cuts = sorted(set(df.stat.approxQuantile(column, [k / CUTS for k in range(CUTS + 1)], 0.5 / CUTS)))
    v = F.col(column)
    at = places(v, cuts)
    on_cut = F.coalesce(F.get(F.array(*(F.lit(float(c)) for c in cuts)), at - 1) == v, F.lit(False))
    df = df.withColumn("_piece", 2 * at - F.when(on_cut, 1).otherwise(0))  # odd: the cut itself
    counts = {r["_piece"]: r["n"] for r in df.groupBy("_piece").agg(F.sum(times).alias("n")).collect()}  # at most 2 * CUTS + 3 rows
    begin, kept, left, settled, moved = 0, [], 0, {}, {}
    for piece in sorted(counts):
        inside = [r for r in wanted if begin <= r < begin + counts[piece]]
        if piece % 2:
            settled |= {r: cuts[piece // 2] for r in inside}
        elif inside:
            moved |= {r: left + r - begin for r in inside}
            kept.append(piece)
            left += counts[piece]
        begin += counts[piece]
    if moved:
        rest = df.where(F.col("_piece").isin(kept)).select(column, *([weight] if weight else []))
        deeper = values_at(rest, column, list(moved.values()), left, weight)
        settled |= dict(zip(moved, deeper, strict=True))
    return [settled[r] for r in ranks]


def quantile_values(df: DataFrame, column: str, points: Sequence[float], weight: str | None = None) -> list[float] | None:
    """Quantiles with linear interpolation between neighbouring ranks; null and NaN are left out, None without a value. weight: how often a row counts.

    Beyond few rows like values are put together first and the ranks are found among the written distinct values.
    """
    times = F.col(weight) if weight else F.lit(1)
    df = df.select(F.col(column).cast("double").alias(column), times.cast("bigint").alias("_n")).where(F.col(column).isNotNull() & ~F.isnan(column))
    held = written(df.groupBy(column).agg(F.sum("_n").alias("_n")), "values")
    try:
        n = held.agg(F.sum("_n")).first()[0] or 0
        if not n:
            return None
        low = [math.floor(p * (n - 1)) for p in points]
        found = values_at(held, column, [*low, *(min(k + 1, n - 1) for k in low)], n, "_n")
        return [a + (p * (n - 1) - k) * (b - a) for p, k, a, b in zip(points, low, found[: len(low)], found[len(low) :], strict=True)]
    finally:
        dropped(held)
