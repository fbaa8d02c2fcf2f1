"""Global row numbers and exact first-n selection, without a window over a table and without one task that merges all.

Rows are dealt into ranges of the wanted order and sorted there side by side; a row's number is its place in its range plus the rows of all ranges
before it. The sorted ranges are a written table, so numbers and rows come from the same run whatever is lost meanwhile.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shared import written

#: Rows of a range, about.
RANGE_ROWS = 2_000_000


def numbered(df: DataFrame, order: Sequence[Column], name: str = "row") -> tuple[DataFrame, int]:
    """df with global row numbers 0..N-1 in ascending order (nulls first; rows that are equal in it: in any), and N.

    A running number is the last part of the order, so equal rows spread over ranges as well. A column of df called ``name`` is replaced.
    """
    keys = [F.col(f"_k{i}") for i in range(len(order))] + [F.col("_salt")]
    kept = [c for c in df.columns if c != name]
    flat = df.select(F.struct(*kept).alias("_row"), *(c.alias(f"_k{i}") for i, c in enumerate(order)), F.monotonically_increasing_id().alias("_salt"))
    ranges = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // RANGE_ROWS))
    ranged = flat.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys)
    place = F.monotonically_increasing_id()
    held = written(ranged.select("_row", F.shiftright(place, 33).alias("_range"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")), "numbered")
    counts = held.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))  # a row a range
    out = held.join(F.broadcast(before), "_range").select("_row.*", (F.col("_before") + F.col("_at")).alias(name))
    return out, held.count()


def first_rows(df: DataFrame, n: int, order: Sequence[Column]) -> DataFrame:
    """The n first rows of an ascending order; df is read once to be sorted in ranges, and no task holds more than its ranges."""
    rows, total = numbered(df, order, "_number")
    return (rows.where(F.col("_number") < n) if n < total else rows).drop("_number")
