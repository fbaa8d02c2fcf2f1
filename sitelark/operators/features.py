"""Feature columns of sites: lookups, cleaning, scaling and labels."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quantiles import quantile_values


def require_columns(df: DataFrame, names: Sequence[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def lookup_or(left: DataFrame, right: DataFrame, key: str, column: str, default: float = 0.0) -> DataFrame:
    """Left lookup of one column; the default where the key or its value is missing."""
    return left.join(right.select(key, column), key, "left").withColumn(column, F.coalesce(F.col(column), F.lit(default)))


def lookup_or_key(left: DataFrame, right: DataFrame, key: str, column: str) -> DataFrame:
    """Left lookup of one column of names; the key itself where it is missing."""
    return left.join(right.select(key, column), key, "left").withColumn(column, F.coalesce(F.col(column), F.col(key).cast("string")))


def lookup_strict(left: DataFrame, right: DataFrame, key: str, column: str) -> DataFrame:
    """Left lookup of one column; a key that is missing is an error when the rows are read."""
    found = left.join(right.select(key, column), key, "left")
    return found.withColumn(column, F.coalesce(F.col(column), F.raise_error(F.concat(F.lit(f"no {column} for "), F.col(key).cast("string")))))


def is_finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < math.inf)


def model_input(df: DataFrame, features: Sequence[str], score: str, legacy: bool = False) -> DataFrame:
    """Rows that a model can use. A NaN feature counts as missing; with legacy only null and infinite ones do."""
    require_columns(df, [*features, score])
    keep = is_finite(F.col(score))
    for name in features:
        c = F.col(name)
        keep = keep & (c.isNotNull() & (F.isnan(c) | (F.abs(c) < math.inf)) if legacy else is_finite(c))
    return df.where(keep)


def zscored(df: DataFrame, columns: Sequence[str], suffix: str = "_z", by: Sequence[str] = ()) -> DataFrame:
    """(x - mean) / population standard deviation; a constant column becomes 0. One aggregation gives all statistics.

    by: columns of groups that are scaled each by itself; their statistics, a row a group, are joined back. Null groups are left out.
    """
    stats = df.groupBy(*by).agg(*(x for c in columns for x in (F.avg(c).alias(f"_m_{c}"), F.stddev_pop(c).alias(f"_s_{c}"))))
    out = df.join(stats, list(by)) if by else df.crossJoin(F.broadcast(stats))  # without groups it is one row
    scaled = {f"{c}{suffix}": F.when(F.col(f"_s_{c}") > 0, (F.col(c) - F.col(f"_m_{c}")) / F.nullif(F.col(f"_s_{c}"), F.lit(0.0))).otherwise(0.0) for c in columns}
    return out.withColumns(scaled).drop(*(c for c in stats.columns if c not in by))


def zscored_to_unit(df: DataFrame, columns: Sequence[str], suffix: str = "_norm") -> DataFrame:
    """z-score, then (z - min) / (max - min + 1e-12). As scaling is monotone, one aggregation gives all statistics."""
    stats = df.agg(*(x for c in columns for x in (F.avg(c).alias(f"_m_{c}"), F.stddev_pop(c).alias(f"_s_{c}"), F.min(c).alias(f"_lo_{c}"), F.max(c).alias(f"_hi_{c}"))))
    out = df.crossJoin(F.broadcast(stats))
    scaled = {}
    for c in columns:
        s = F.nullif(F.col(f"_s_{c}"), F.lit(0.0))
        z = lambda x, c=c, s=s: (x - F.col(f"_m_{c}")) / s
        scaled[f"{c}{suffix}"] = (z(F.col(c)) - z(F.col(f"_lo_{c}"))) / (z(F.col(f"_hi_{c}")) - z(F.col(f"_lo_{c}")) + 1e-12)
    return out.withColumns(scaled).drop(*stats.columns)


def percentiles(df: DataFrame, column: str, points: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Exact percentiles with linear interpolation, as rows p, value; no rows without a value."""
    found = quantile_values(df, column, points)
    return df.sparkSession.createDataFrame(list(zip(map(float, points), found or [], strict=False)), "p double, value double")


def label_sites(sites: DataFrame, bound: DataFrame, structured: DataFrame, key: str, conservation: str, limit: float = 1.0) -> DataFrame:
    """label: clip_bound if the key is in bound; else clip_unbound if it is not in structured and conservation <= limit; else non_determined.

    bound and structured have the key (repeats allowed). They are joined as flags, never collected.
    """
    flags = [(bound, "_bound"), (structured, "_structured")]
    out = sites
    for df, flag in flags:
        out = out.join(df.select(key).distinct().withColumn(flag, F.lit(True)), key, "left")
    label = F.when(F.col("_bound"), "clip_bound").when(F.col("_structured").isNull() & (F.col(conservation) <= limit), "clip_unbound").otherwise("non_determined")
    return out.withColumn("label", label).drop("_bound", "_structured")


def label_counts(df: DataFrame, column: str, labels: Sequence[str]) -> DataFrame:
    """Rows label, n for the given labels, 0 where none occurs."""
    counts = df.agg(*(F.count_if(F.col(column) == v).alias(f"n{k}") for k, v in enumerate(labels)))
    rows = F.array(*(F.struct(F.lit(v).alias("label"), F.col(f"n{k}").alias("n")) for k, v in enumerate(labels)))
    return counts.select(F.explode(rows).alias("r")).select("r.*")


def oriented(df: DataFrame, posterior: str, conservation: str, flip: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """1 - x in the columns of flip if sites with a high posterior (> 0.9) are less conserved than those with a low one (< 0.1); by: groups, each by itself."""
    p, c = F.col(posterior), F.col(conservation)
    gap = df.groupBy(*by).agg((F.avg(F.when(p > 0.9, c)) - F.avg(F.when(p < 0.1, c))).alias("_gap"))  # one row, or one a group
    turn = F.coalesce(F.col("_gap") < 0, F.lit(False))
    both = df.join(gap, list(by)) if by else df.crossJoin(F.broadcast(gap))
    return both.withColumns({x: F.when(turn, 1 - F.col(x)).otherwise(F.col(x)) for x in flip}).drop("_gap")
