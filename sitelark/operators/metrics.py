"""Ranking metrics from one table of counts by distinct score; y is 0 or 1, a higher score should mean 1."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expressions import places

#: Distinct scores of a range that running totals are taken in, one task a range; ranges at least and at most.
RANGE_ROWS, RANGES = 1_000_000, (8, 20_000)


def running_by_score(df: DataFrame, score: str, y: str, ranges: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    """score, pos, neg, tp, fp, n_pos, n_neg: counts at each distinct score, and from it upwards; with ``by`` for each group, its columns first.

    Distinct scores are dealt into ranges by sampled boundaries, the same for all groups; each range of a group runs its own totals, and the totals of
    the ranges above, a row a range, are added. No window spans the whole table, nor a whole large group.
    """
    by = list(by)
    counts = df.where(F.col(score).isNotNull() & F.col(y).isNotNull()).groupBy(*by, F.col(score).alias("score")).agg(F.sum(F.col(y).cast("bigint")).alias("pos"), F.sum((1 - F.col(y)).cast("bigint")).alias("neg"))
    if ranges is None:
        distinct = df.agg(F.approx_count_distinct(score)).first()[0]
        ranges = min(max(RANGES[0], -(-distinct // RANGE_ROWS)), RANGES[1])
    cuts = df.where(F.col(score).isNotNull()).stat.approxQuantile(score, [k / ranges for k in range(1, ranges)], min(0.01, 0.5 / ranges))
    cuts = sorted(set(cuts))
    ranged = counts.withColumn("_range", places(F.col("score"), cuts))
    totals = ranged.groupBy(*by, "_range").agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    above = Window.partitionBy(*by).orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*by)
    totals = totals.select(*by, "_range", F.coalesce(F.sum("_p").over(above), F.lit(0)).alias("_pa"), F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_na"), F.sum("_p").over(every).alias("n_pos"), F.sum("_n").over(every).alias("n_neg"))
    own = Window.partitionBy(*by, "_range").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = ranged.join(totals if by else F.broadcast(totals), [*by, "_range"])  # at most a row a range (and group)
    return run.select(*by, "score", "pos", "neg", (F.sum("pos").over(own) + F.col("_pa")).alias("tp"), (F.sum("neg").over(own) + F.col("_na")).alias("fp"), "n_pos", "n_neg")


def _ratio(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0))


def roc_auc(df: DataFrame, score: str, y: str) -> DataFrame:
    """One row auc, by ranks with ties counted half; null with one class only."""
    return roc_auc_of(running_by_score(df, score, y))


def roc_auc_of(r: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """roc_auc() of a table that running_by_score() made, for each group of it."""
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / F.lit(2.0)))
    return r.groupBy(*by).agg(_ratio(area, F.max(F.col("n_pos") * F.col("n_neg"))).alias("auc"))


def roc_curve(df: DataFrame, score: str, y: str) -> DataFrame:
    """threshold, fpr, tpr at each distinct score: all points, none dropped as collinear."""
    return running_by_score(df, score, y).select(F.col("score").alias("threshold"), _ratio(F.col("fp"), F.col("n_neg")).alias("fpr"), _ratio(F.col("tp"), F.col("n_pos")).alias("tpr"))


def pr_curve(df: DataFrame, score: str, y: str) -> DataFrame:
    return _pr_points(running_by_score(df, score, y))


def _pr_points(r: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return r.select(*by, F.col("score").alias("threshold"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), _ratio(F.col("tp"), F.col("n_pos")).alias("recall"))


def average_precision(df: DataFrame, score: str, y: str) -> DataFrame:
    """One row ap: the sum of precision over the steps in recall."""
    return average_precision_of(running_by_score(df, score, y))


def average_precision_of(r: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return r.groupBy(*by).agg(F.sum(_ratio(F.col("pos"), F.col("n_pos")) * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("ap"))


def best_f1(df: DataFrame, score: str, y: str) -> DataFrame:
    """One row f1, threshold: the greatest F1 and, of ties, the lowest threshold that has it."""
    return best_f1_of(running_by_score(df, score, y))


def best_f1_of(run: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    p, r = F.col("precision"), F.col("recall")
    f1 = 2 * p * r / (p + r + 1e-12)
    return _pr_points(run, by).groupBy(*by).agg(F.max(F.struct(F.round(f1, 12).alias("f1"), (-F.col("threshold")).alias("t"))).alias("b")).select(*by, F.col("b.f1").alias("f1"), (-F.col("b.t")).alias("threshold"))


def precision_at_fpr(df: DataFrame, score: str, y: str, target: float) -> DataFrame:
    """One row precision, fpr, tpr, threshold at the greatest tpr whose fpr is within the target; of ties the highest threshold.

    The point above all scores (nothing predicted) counts, with precision 0 and an infinite threshold.
    """
    return precision_at_fpr_of(running_by_score(df, score, y), target)


def precision_at_fpr_of(r: DataFrame, target: float, by: Sequence[str] = ()) -> DataFrame:
    by = list(by)
    top = r.groupBy(*by).agg(F.max("n_pos").alias("n_pos"), F.max("n_neg").alias("n_neg")).select(*by, F.lit(float("inf")).alias("score"), F.lit(0).cast("bigint").alias("tp"), F.lit(0).cast("bigint").alias("fp"), "n_pos", "n_neg")
    points = r.select(*by, "score", "tp", "fp", "n_pos", "n_neg").unionByName(top).where(_ratio(F.col("fp"), F.col("n_neg")) <= target)
    best = points.groupBy(*by).agg(F.max(F.struct("tp", "score", "fp", "n_pos", "n_neg")).alias("b")).select(*by, "b.*")
    return best.select(*by, (F.col("tp") / (F.col("tp") + F.col("fp") + 1e-12)).alias("precision"), _ratio(F.col("fp"), F.col("n_neg")).alias("fpr"), _ratio(F.col("tp"), F.col("n_pos")).alias("tpr"), F.col("score").alias("threshold"))


def pr_baseline(df: DataFrame, y: str) -> DataFrame:
    return df.agg(F.avg(y).alias("positive_rate"))


def ks_statistic(df: DataFrame, column: str, cdf: Column) -> DataFrame:
    """One row n, ks: the greatest distance of the empirical distribution of column from cdf (an expression over ``score``)."""
    flat = df.select(F.col(column).alias("_x"), F.lit(1).alias("_one"))
    r = running_by_score(flat, "_x", "_one").withColumn("score", F.col("score"))
    upto, below = (F.col("n_pos") - F.col("tp") + F.col("pos")) / F.col("n_pos"), (F.col("n_pos") - F.col("tp")) / F.col("n_pos")
    return r.agg(F.max("n_pos").alias("n"), F.max(F.greatest(F.abs(upto - cdf), F.abs(cdf - below))).alias("ks"))
