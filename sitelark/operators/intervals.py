"""Interval joins by equi-join on bins, nearest-preceding joins by bins of positions, and mapping of sites to transcripts.

Intervals are half-open [start, end). The key columns (chromosome, and strand where it counts) and the bin make the join key, so
a long chromosome spreads over many tasks. Wide intervals have bins of a wider level, so that none is copied to many bins. A pair that
shares several bins is taken in the last of their first bins only.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .windows import covering

#: Bins that an interval is copied to at most; each level's bins are STEP times as wide as those of the level below.
MOST_BINS, STEP = 64, 8


def _bins(start: Column, end: Column, width: int) -> tuple[Column, Column]:
    return F.floor(start / width), F.floor((F.greatest(end, start + 1) - 1) / width)


def _level(start: Column, end: Column, width: int) -> Column:
    n = (F.greatest(end, start + 1) - start) / (width * MOST_BINS) + F.lit(2.0 / MOST_BINS)
    return F.when(n <= 1, 0).otherwise(F.ceil(F.ln(n) / F.ln(F.lit(float(STEP))))).cast("int")


def _binned(df: DataFrame, levels: DataFrame, span: tuple[str, str], width: int, own: str) -> DataFrame:
    """df at its own level and at all higher ones that occur, once for each of its bins there; own names the columns for them."""
    s, e = F.col(span[0]).cast("bigint"), F.col(span[1]).cast("bigint")
    each = df.withColumn(f"{own}_level", _level(s, e, width)).join(F.broadcast(levels), F.col("_level") >= F.col(f"{own}_level"))  # a row a level: at most about 20
    wide = F.pow(F.lit(float(STEP)), F.col("_level")).cast("bigint") * width
    first, last = F.floor(s / wide), F.floor((F.greatest(e, s + 1) - 1) / wide)
    return each.withColumn(f"{own}_first", first).withColumn("_bin", F.explode(F.sequence(first, last)))


def overlap_pairs(left: DataFrame, right: DataFrame, on: Sequence[str], left_span: tuple[str, str], right_span: tuple[str, str], width: int = 1000) -> DataFrame:
    """All pairs that overlap: columns of left, then those of right that are not in ``on``. Other column names must differ.

    An interval that spans more than MOST_BINS bins has a higher level. A pair meets at the higher of its two levels, in one bin.
    """
    (ls, le), (rs, re_) = left_span, right_span
    of = lambda df, s, e: df.select(_level(F.col(s).cast("bigint"), F.col(e).cast("bigint"), width).alias("_level"))
    levels = of(left, ls, le).unionByName(of(right, rs, re_)).distinct()
    a, b = _binned(left, levels, left_span, width, "_l"), _binned(right, levels, right_span, width, "_r")
    touch = (F.col(ls) < F.col(re_)) & (F.col(rs) < F.col(le))
    once = (F.col("_bin") == F.greatest("_l_first", "_r_first")) & (F.col("_level") == F.greatest("_l_level", "_r_level"))
    columns = [*left.columns, *(c for c in right.columns if c not in on)]
    return a.join(b, [*on, "_level", "_bin"]).where(touch & once).select(columns)


def point_pairs(left: DataFrame, points: DataFrame, on: Sequence[str], span: tuple[str, str], point: str, width: int) -> DataFrame:
    """Pairs of left intervals and points inside them; a point has one bin, so no pair comes twice."""
    s, e = F.col(span[0]), F.col(span[1])
    first, last = _bins(s, e, width)
    a = left.withColumn("_bin", F.explode(F.sequence(first, last)))
    b = points.withColumn("_bin", F.floor(F.col(point) / width))
    return a.join(b, [*on, "_bin"]).where((F.col(point) >= s) & (F.col(point) < e)).drop("_bin")


def overlap_facts(left: DataFrame, right: DataFrame, on: Sequence[str], left_span: tuple[str, str], right_span: tuple[str, str], any_of: Mapping[str, Column], most: Mapping[str, Column] | None = None, width: int = 1000) -> DataFrame:
    """left with what overlaps each row: n, how many rows of right; any_of: whether a condition on right holds for one of them; most: the greatest value of an
    expression of both spans. Like spans are put together on either side before pairs are made. Rows that overlap nothing are left out.
    """
    here, most = [*on, *left_span], dict(most or {})
    spans = right.groupBy(*on, *right_span).agg(F.count(F.lit(1)).alias("_n"), *(F.bool_or(c).alias(f"_f_{n}") for n, c in any_of.items()))
    pairs = overlap_pairs(left.select(*here).distinct(), spans, on, left_span, right_span, width)
    facts = pairs.groupBy(*here).agg(F.sum("_n").alias("n"), *(F.bool_or(f"_f_{n}").alias(n) for n in any_of), *(F.max(c).alias(n) for n, c in most.items()))
    return left.join(facts, here)


def overlap_join(left: DataFrame, right: DataFrame, on: Sequence[str], left_span: tuple[str, str], right_span: tuple[str, str], how: str = "inner", key: Sequence[str] = (), width: int = 1000) -> DataFrame:
    """inner, left, semi or anti overlap join. All but inner need ``key``: columns that tell the rows of left apart."""
    if how not in ("inner", "left", "semi", "anti"):
        raise ValueError(f"no such overlap join: {how}")
    if how == "inner":
        return overlap_pairs(left, right, on, left_span, right_span, width)
    if not key:
        raise ValueError(f"a {how} overlap join needs the key of the left side")
    # which spans overlap anything is asked of the distinct ones on both sides
    here, there = [*on, *left_span], [*on, *right_span]
    hit = overlap_pairs(left.select(*here).distinct(), right.select(*there).distinct(), on, left_span, right_span, width).select(*here).distinct()
    if how != "left":
        return left.join(hit, here, "left_semi" if how == "semi" else "left_anti").select(*left.columns)
    # pairs are made once and go on as they are; rows without any are added
    pairs, extra = overlap_pairs(left, right, on, left_span, right_span, width), [c for c in right.columns if c not in on]
    lone = left.join(hit, here, "left_anti").select(*left.columns, *(F.lit(None).cast(right.schema[c].dataType).alias(c) for c in extra))
    return pairs.select(*left.columns, *extra).unionByName(lone)


def asof_backward(left: DataFrame, right: DataFrame, on: Sequence[str], left_at: str, right_at: str, take: Sequence[str], width: int = 1 << 16) -> DataFrame:
    """For each row of left the latest row of right that starts at or before it (null without one).

    One union, one sort by key, bin and position, one running last(): no join, and no pair is ever made. Each bin of positions begins with
    the last hit of the bins before it, which runs over a row a bin; so a chromosome spreads over its bins. Of right rows at one position the
    greatest by the taken columns counts. A null key or position finds nothing, as in any join by equality.
    """
    right = right.dropna(subset=[*on, right_at])
    names = list(left.columns)
    hit_type = right.select(F.struct(*take)).schema[0].dataType
    none = F.lit(None).cast(hit_type)
    l = left.select(F.struct(*names).alias("_row"), *on, F.col(left_at).cast("bigint").alias("_at"), F.lit(1).alias("_side"), none.alias("_hit"))  # noqa: E741
    r = right.groupBy(*on, F.col(right_at).cast("bigint").alias("_at")).agg(F.max(F.struct(*take)).alias("_hit")).select(F.lit(None).cast(l.schema["_row"].dataType).alias("_row"), *on, "_at", F.lit(0).alias("_side"), "_hit")
    both = l.unionByName(r).withColumn("_bin", F.floor(F.col("_at") / width))
    ends = both.groupBy(*on, "_bin").agg(F.max(F.when(F.col("_side") == 0, F.struct("_at", "_hit"))).alias("_end"))
    earlier = Window.partitionBy(*on).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("_hit", F.last(F.col("_end._hit"), ignorenulls=True).over(earlier)).where(F.col("_hit").isNotNull())
    carried = carried.select(F.lit(None).cast(l.schema["_row"].dataType).alias("_row"), *on, F.lit(None).cast("bigint").alias("_at"), F.lit(-1).alias("_side"), "_hit", "_bin")
    w = Window.partitionBy(*on, "_bin").orderBy(F.asc_nulls_first("_at"), "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = both.unionByName(carried).withColumn("_last", F.last("_hit", ignorenulls=True).over(w)).where(F.col("_side") == 1)
    return joined.select("_row.*", *(F.col(f"_last.{c}").alias(c) for c in take))


def asof_contains(left: DataFrame, right: DataFrame, on: Sequence[str], left_at: str, right_start: str, right_end: str, take: Sequence[str]) -> DataFrame:
    """asof_backward, kept where the right interval reaches the position (its end included)."""
    wanted = list(dict.fromkeys([*take, right_start, right_end]))
    return asof_backward(left, right, on, left_at, right_start, wanted).where(F.col(left_at) <= F.col(right_end))


def map_to_transcripts(sites: DataFrame, exons: DataFrame, key: str, at: str, on: Sequence[str] = ("chrom", "strand")) -> DataFrame:
    """The transcript that a site's centre falls into, and its offset in transcript direction.

    exons: on, transcript_id, exon_start, exon_end (half-open). Of several transcripts the longest wins, then the smallest id. Sites without
    an exon keep nulls. Adds transcript_id, transcript_start (exon bases before the centre) and transcript_length.
    """
    size = F.col("exon_end") - F.col("exon_start")
    forward = Window.partitionBy(*on, "transcript_id").orderBy("exon_start")  # an id may stand on two chromosomes
    whole = Window.partitionBy(*on, "transcript_id")
    placed = exons.select(*on, "transcript_id", "exon_start", "exon_end", (F.sum(size).over(forward) - size).alias("_before"), F.sum(size).over(whole).alias("transcript_length"))
    # an offset is this number plus the centre, or the length less one less that sum
    shift = F.col("_before") - F.col("exon_start")
    turned = F.col("strand") == "-" if "strand" in on else F.lit(False)
    first = F.struct((-F.col("transcript_length")).alias("a"), F.col("transcript_id").alias("b"), F.when(turned, -shift).otherwise(shift).alias("c"))
    # only the first of all exons over a place counts, so each piece of an exon keeps its first and no pair of site and exon is made
    best = covering(sites, placed.withColumn("_t", first), on, at, ("exon_start", "exon_end"), least=["_t"])
    length = -F.col("_t.a")
    offset = F.when(turned, length - 1 - F.col(at) + F.col("_t.c")).otherwise(F.col("_t.c") + F.col(at))
    own = {c: f"_at{k}" for k, c in enumerate((*on, at))}
    found = best.select(*(F.col(c).alias(n) for c, n in own.items()), F.col("_t.b").alias("transcript_id"), offset.alias("transcript_start"), length.alias("transcript_length"))
    return sites.join(found, [F.col(c) == F.col(n) for c, n in own.items()], "left").drop(*own.values())
