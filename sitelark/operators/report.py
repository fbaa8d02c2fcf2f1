"""Tables behind reports: reshaping, summaries by group, scaling within groups, recoding."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def unpivoted(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str = "model", value: str = "value") -> DataFrame:
    return df.select(*ids, *(F.col(v).cast("double").alias(v) for v in values)).unpivot(list(ids), list(values), name, value)


def union_fill(*tables: DataFrame) -> DataFrame:
    """Rows of all tables by column name; a column that a table lacks is null there."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def set_union(*columns: DataFrame) -> DataFrame:
    out = columns[0]
    for c in columns[1:]:
        out = out.union(c)
    return out.distinct()


def recoded(c: Column, names: Mapping[str, str]) -> Column:
    """The new name of each value; values without one stay."""
    out = None
    for old, new in names.items():
        out = F.when(c == old, new) if out is None else out.when(c == old, new)
    return c if out is None else out.otherwise(c)


def summary(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """n, mean, sd (ddof 1) and sem by group; nulls count in n and nowhere else."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd")).withColumn("sem", F.col("sd") / F.sqrt(F.col("n")))


def _with_stats(df: DataFrame, by: Sequence[str], *stats: Column) -> DataFrame:
    """Joins the statistics of a row's group to it: partial sums are shuffled and large groups stay spread, unlike with a window."""
    return df.join(df.groupBy(*by).agg(*stats), list(by))


def group_zscore(df: DataFrame, by: Sequence[str], value: str, name: str = "z") -> DataFrame:
    """(x - mean) / sd (ddof 1) within each group, 0 where the deviation is 0 or missing. Group columns hold no nulls."""
    out = _with_stats(df, by, F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    return out.withColumn(name, F.when(F.col("_s") > 0, (F.col(value) - F.col("_m")) / F.nullif(F.col("_s"), F.lit(0.0))).otherwise(0.0)).drop("_m", "_s")


def group_l2(df: DataFrame, by: Sequence[str], value: str, name: str = "l2") -> DataFrame:
    """x over the Euclidean norm of its group, 0 where the norm is 0."""
    out = _with_stats(df, by, F.sqrt(F.sum(F.col(value) * F.col(value))).alias("_n"))
    return out.withColumn(name, F.when(F.col("_n") > 0, F.col(value) / F.nullif(F.col("_n"), F.lit(0.0))).otherwise(0.0)).drop("_n")


def feature_order(summaries: DataFrame, model: str = "model", feature: str = "feature", mean: str = "mean") -> DataFrame:
    """Features by first appearance when each model's are listed by falling absolute mean. summaries has a row for each model and feature."""
    place = F.row_number().over(Window.partitionBy(model).orderBy(F.desc(F.abs(mean)), feature))
    first = summaries.withColumn("_p", place).groupBy(feature).agg(F.min(F.struct(model, "_p")).alias("_f"))
    return first.select(feature, F.row_number().over(Window.orderBy("_f")).cast("bigint").alias("place"))


def latest_per_key(df: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """The greatest value of a sortable name for each key."""
    return df.groupBy(*by).agg(F.max(order).alias(order))


def long_matrix(df: DataFrame, row: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """A table as (row columns, column, value), what a heat map is drawn from."""
    return unpivoted(df, row, columns, "column", "value")
