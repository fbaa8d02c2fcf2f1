"""An extension beyond the batch stages: running sums of new signal rows by window of positions, as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_signal(stream: DataFrame, width: int = 1000, late: str = "10 minutes") -> DataFrame:
    """stream: ts, chrom, strand, at, val, depth. Sums by chromosome, strand, bin of positions and ten-minute event-time window.

    Rows later than ``late`` behind the greatest ts seen are left out; the sums suffice for means and variances (as in operators.signal).
    """
    key = [F.window("ts", "10 minutes"), "chrom", "strand", F.floor(F.col("at") / width).alias("bin")]
    v, w = F.col("val"), F.col("depth")
    return stream.withWatermark("ts", late).groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.sum(v).alias("sum_v"), F.sum(v * v).alias("sum_v2"), F.sum(w).alias("sum_w"), F.sum(v * w).alias("sum_vw"))
