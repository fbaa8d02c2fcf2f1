"""Sums, least and greatest values of windows of fixed width around positions, without a row for any pair of site and point.

Points are summed up by position first, then the positions are cut into blocks as wide as a window. A window is the end of one block and the
beginning of the next, so its sum is one running sum backwards and one forwards, each within its block: everything is added, nothing subtracted,
and only points inside the window take part. Work grows with positions, however many points lie in a window.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def covering(marks: DataFrame, spans: DataFrame, on: Sequence[str], at: str, span: tuple[str, str], sums: Sequence[str] = (), least: Sequence[str] = (), most: Sequence[str] = ()) -> DataFrame:
    """on, at and the sums, least and greatest values of the columns of all spans [start, end) that cover a place, a row for each distinct place with any.

    A span is cut into at most two aligned pieces of each power of two, like pieces are summed up, and a place looks up one piece of each size: the work
    grows with spans plus places, not with their pairs.
    """
    on = list(on)
    aggs = [f(c).alias(c) for f, names in ((F.sum, sums), (F.min, least), (F.max, most)) for c in names]
    s, e = F.col(span[0]).cast("bigint"), F.col(span[1]).cast("bigint")
    cut = spans.dropna(subset=[*on, *span]).where(e > s).select(*on, s.alias("_s"), e.alias("_e"), *sums, *least, *most)
    cut = cut.withColumn("_level", F.explode(F.sequence(F.lit(0), F.length(F.bin(F.col("_e") - F.col("_s"))) - 1)))
    low, high = F.expr("shiftright(_s + shiftleft(1L, _level) - 1, _level)"), F.expr("shiftright(_e, _level)")
    odd = lambda c: c.bitwiseAND(F.lit(1)) == 1
    pieces = F.array(F.when((low < high) & odd(low), low), F.when((low < high) & odd(high), high - 1))
    nodes = cut.withColumn("_node", F.explode(F.array_compact(pieces))).groupBy(*on, "_level", "_node").agg(*aggs)
    levels = cut.select("_level").distinct()  # at most 63 rows
    asked = marks.select(*on, F.col(at).cast("bigint").alias(at)).dropna().distinct().crossJoin(F.broadcast(levels))
    return asked.withColumn("_node", F.expr(f"shiftright(`{at}`, _level)")).join(nodes, [*on, "_level", "_node"]).groupBy(*on, at).agg(*aggs)


def window_sums(
    sites: DataFrame, points: DataFrame, on: Sequence[str], pos: str, windows: Mapping[str, Sequence[tuple[int, int]]], start: str, sums: Mapping[str, Column],
    least: Mapping[str, Column] | None = None, most: Mapping[str, Column] | None = None, end: str | None = None,
) -> DataFrame:
    """on, pos and a column MEASURE_WINDOW for each measure and window, a row for each distinct place of sites with a point in any window.

    windows: ranges [pos + lo, pos + hi) by name; those of one name are added. sums: what a point adds (null: nothing); least and most: values of which
    the smallest or greatest counts. With ``end`` a point is a run [start, end) of like bases, and each base in a window adds. Sums
    are null without a value, as in any aggregation. A null key or position is nowhere.
    """
    least, most, on = dict(least or {}), dict(most or {}), list(on)
    named = [(name, lo, hi) for name, spans in windows.items() for lo, hi in spans if hi > lo]
    parts = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(lo).cast("bigint").alias("lo"), F.lit(hi - lo).cast("bigint").alias("w")) for k, (_, lo, hi) in enumerate(named)))
    a = F.col(start).cast("bigint")
    live = points.dropna(subset=[*on, start, *([end] if end else [])])
    live = live.where(F.col(end) > F.col(start)) if end else live
    measures = [F.sum(c).alias(n) for n, c in sums.items()] + [F.min(c).alias(n) for n, c in least.items()] + [F.max(c).alias(n) for n, c in most.items()]
    flat = live.groupBy(*on, a.alias("_a"), (F.col(end).cast("bigint") if end else a + 1).alias("_b")).agg(F.count(F.lit(1)).alias("_any"), *measures)
    added, extremes = ["_any", *sums], [*least, *most]

    w, block = F.col("_p.w"), F.col("_block")
    first, last = F.col("_a") - F.pmod("_a", w), F.col("_b") - 1 - F.pmod(F.col("_b") - 1, w)
    spread = flat.withColumn("_p", F.explode(parts))
    # a run's first and last blocks; those between are covered whole
    placed = spread.withColumn("_block", F.explode(F.array_distinct(F.array(first, last))) if end else first)
    # of a block's bases from its begin (side 0) or its end (side 1): a piece takes those from _from up to _to
    lo, hi = F.greatest("_a", block) - block, F.least(F.col("_b"), block + w) - block
    event = lambda side, f, t, kind, at: F.struct(F.lit(side).alias("side"), f.alias("f"), t.alias("t"), F.lit(kind).alias("kind"), at.alias("at"))
    both = [(0, lo, hi), (1, w - hi, w - lo)]
    whole = F.array(*(event(s, f, t, 0, t) for s, f, t in both))
    if end:  # a longer piece counts by its length once it has ended; between its first base and its end it grows
        long = F.array(*(event(s, f, t, k, f + 1 if k == 1 else t) for s, f, t in both for k in (1, 2)))
        whole = F.when(hi - lo > 1, long).otherwise(whole)
    events = placed.withColumn("_e", F.explode(whole))
    kind, size = F.col("_e.kind"), F.col("_e.t") - F.col("_e.f")
    columns = [F.when(kind != 1, F.col(c) * size).alias(f"_done_{c}") if end else F.col(c).alias(f"_done_{c}") for c in added]
    if end:
        turn = lambda x: F.when(kind == 1, x).when(kind == 2, -x)
        columns += [turn(F.col(c)).alias(f"_slope_{c}") for c in added] + [turn(-F.col(c) * F.col("_e.f")).alias(f"_base_{c}") for c in added]
    columns += [F.when(kind != 2, F.col(c)).alias(f"_ext_{c}") for c in extremes]
    key = [*on, F.col("_p.k").alias("_k"), F.col("_e.side").alias("_side"), "_block", F.col("_e.at").alias("_at")]
    events = events.select(*key, F.lit(None).cast("bigint").alias("_pos"), *columns)

    begin = F.col("_pos") + F.col("_p.lo")
    ahead = F.pmod(begin, w)
    marks = sites.select(*on, F.col(pos).cast("bigint").alias("_pos")).dropna().distinct().withColumn("_p", F.explode(parts))
    asked = F.array(F.struct(F.lit(1).alias("side"), (begin - ahead).alias("block"), (w - ahead).alias("at")), F.struct(F.lit(0).alias("side"), (begin - ahead + w).alias("block"), ahead.alias("at")))
    marks = marks.withColumn("_e", F.explode(asked)).select(*on, F.col("_p.k").alias("_k"), F.col("_e.side").alias("_side"), F.col("_e.block").alias("_block"), F.col("_e.at").alias("_at"), "_pos")

    held = events.unionByName(marks, allowMissingColumns=True)
    so_far = Window.partitionBy(*on, "_k", "_side", "_block").orderBy("_at", F.asc_nulls_first("_pos")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = {c: (F.min if c.removeprefix("_ext_") in least else F.max)(c).over(so_far) if c.startswith("_ext_") else F.sum(c).over(so_far) for c in held.columns if c.startswith(("_done_", "_slope_", "_base_", "_ext_"))}
    found = held.select(*on, "_k", "_block", "_at", "_pos", *(v.alias(c) for c, v in running.items())).where(F.col("_pos").isNotNull())
    if end:
        inner = spread.where(last - first >= 2 * w).select(*on, F.col("_p.k").alias("_k"), (first + w).alias("_s"), last.alias("_e"), w.alias("_w"), *added, *extremes)
        width = F.element_at(F.array(*(F.lit(hi - lo).cast("bigint") for _, lo, hi in named)), F.col("_k") + 1)
        index = lambda c: F.expr(f"{c} div _w")
        inner = inner.withColumns({"_s": index("_s"), "_e": index("_e")})
        found = found.withColumn("_w", width).withColumn("_i", index("_block")).drop("_w")
        least_in, most_in = [c for c in extremes if c in least], [c for c in extremes if c in most]
        full = covering(found.select(*on, "_k", "_i"), inner, [*on, "_k"], "_i", ("_s", "_e"), added, least_in, most_in)
        found = found.join(full, [*on, "_k", "_i"], "left")
        taken = {f"_ext_{c}": (F.least if c in least else F.greatest)(F.col(f"_ext_{c}"), F.when(F.col("_at") > 0, F.col(c))) for c in extremes}
        found = found.withColumns(taken) if taken else found

    def value(c: str) -> Column:
        if not end:
            return F.col(f"_done_{c}")
        pieces = [F.col(f"_done_{c}"), F.col(f"_slope_{c}") * F.col("_at") + F.col(f"_base_{c}"), F.when(F.col("_at") > 0, F.col(c) * F.col("_at"))]
        return F.when(F.coalesce(*pieces).isNotNull(), sum((F.coalesce(x, F.lit(0)) for x in pieces[1:]), F.coalesce(pieces[0], F.lit(0))))

    out = []
    for name in windows:
        here = F.col("_k").isin([k for k, (n, _, _) in enumerate(named) if n == name])
        out += [F.sum(F.when(here, value(c))).alias(f"{c}_{name}") for c in added]
        out += [(F.min if c in least else F.max)(F.when(here, F.col(f"_ext_{c}"))).alias(f"{c}_{name}") for c in extremes]
    some = sum((F.coalesce(F.col(f"_any_{name}"), F.lit(0)) for name in windows), F.lit(0)) > 0
    return found.groupBy(*on, F.col("_pos").alias(pos)).agg(*out).where(some).drop(*(f"_any_{name}" for name in windows))


def moments(name: str, n: Column, centre: Column, d: Column, dd: Column, lo: Column, hi: Column) -> list[Column]:
    """n_, mean_ and var_NAME from the number of values, their sums and sums of squares from a centre, and their least and greatest.

    Equal values have variance 0 exactly. Otherwise its relative error is about 1e-16 times the square of (distance of the values from the centre / their deviation).
    """
    same = (lo == hi) & ~F.isnan(lo)
    mean = F.when(same, lo).otherwise(centre + d / n)
    var = F.when(same, F.lit(0.0)).otherwise(F.greatest(dd / n - (d / n) * (d / n), F.lit(0.0)))
    return [F.coalesce(n, F.lit(0)).alias(f"n_{name}"), F.when(n > 0, mean).alias(f"mean_{name}"), F.when(n > 0, var).alias(f"var_{name}")]


def centred(points: DataFrame, value: str) -> tuple[DataFrame, DataFrame]:
    """The mean of all finite values as a row _c, and points with it, so that squares from it do not cancel."""
    v = F.col(value).cast("double")
    finite = ~F.isnan(v) & (F.abs(v) < F.lit(1e150))
    mean = points.agg(F.coalesce(F.avg(F.when(finite, v)), F.lit(0.0)).alias("_c"))
    return mean, points.crossJoin(F.broadcast(mean))
