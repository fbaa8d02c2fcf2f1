import math
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sitelark.llm.queries import QUERIES
from sitelark.llm.sharding import forget, permuted, place, row_at, sharded, side, write_shards

from . import edge


@pytest.mark.parametrize("rows", [1, 2, 3, 5, 16, 17, 99, 100, 101, 1000, 1025])
def test_places_are_a_permutation_and_invert(rows):
    at = [place(r, rows, 16, 5) for r in range(rows)]
    assert sorted(slot * 16 + shard for shard, slot in at) == list(range(rows))
    assert [row_at(*x, rows, 16, 5) for x in at] == list(range(rows))


def test_large_numbers_stay_in_range_and_invert():
    for rows in (10**12 + 7, 2**62):
        assert side(rows) < 2**31 + 1 and side(rows) ** 2 >= rows
        for r in (0, 1, rows // 3, rows - 1):
            assert row_at(*place(r, rows, 1000), rows, 1000) == r


@pytest.mark.parametrize("rows", [1, 2, 7, 300, 4097])
def test_column_equals_the_plain_function(spark, rows):
    got = spark.range(rows).select("id", permuted(F.col("id"), rows, 9).alias("p")).collect()
    assert {r["id"]: r["p"] for r in got} == {r: slot * 16 + shard for r in range(rows) for shard, slot in [place(r, rows, 16, 9)]}


def test_columns_of_large_numbers(spark):
    rows = 10**12 + 7
    got = spark.range(0, rows, rows // 500).select("id", permuted(F.col("id"), rows, 3).alias("p")).collect()
    assert all(divmod(r["p"], 16)[::-1] == place(r["id"], rows, 16, 3) for r in got)


def test_a_shuffle_leaves_no_order(spark):
    """Neighbours land in any pair of shards alike: chi-square of the 64 pairs, and seeds differ."""
    n = 40_000
    at = [place(r, n, 8, 1)[0] for r in range(n)]
    pairs = Counter(zip(at, at[1:]))
    want = (n - 1) / 64
    assert sum((pairs[a, b] - want) ** 2 / want for a in range(8) for b in range(8)) < 63 + 5 * math.sqrt(2 * 63)
    assert sum(x == place(r, n, 8, 2)[0] for r, x in enumerate(at)) < n / 8 + 5 * math.sqrt(n / 8)


def laws(rows, shards):
    counts = Counter(r["shard"] for r in rows)
    assert not rows or max(counts.values()) - min(counts.get(k, 0) for k in range(shards)) <= 1
    for shard, n in counts.items():
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(n))


def test_nulls_repeats_and_clashing_columns(spark):
    docs = edge.with_nulls(spark).withColumn("shard", F.lit("x")).withColumn("_row", F.lit(1)).withColumn("_range", F.lit(2)).withColumn("_p", F.lit(3))
    rows = sharded(docs, 5).collect()
    assert set(rows[0].asDict()) == set(docs.columns) | {"size", "text_crc32", "row", "shard", "slot"}
    assert Counter((r["doc_id"], r["text"], r["_row"], r["_range"]) for r in rows) == Counter((r["doc_id"], r["text"], 1, 2) for r in docs.collect())
    laws(rows, 5)
    assert sorted(r["row"] for r in rows) == list(range(len(rows)))
    for r in rows:
        data = (r["text"] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(data) + 1, zlib.crc32(data)) and (r["shard"], r["slot"]) == place(r["row"], len(rows), 5)
    order = lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["size"], r["text_crc32"])
    assert [order(r) for r in sorted(rows, key=lambda r: r["row"])] == sorted(order(r) for r in rows)
    again = sharded(docs.repartition(3), 5).collect()
    plain = lambda xs: Counter((r["doc_id"], r["text"], r["row"], r["shard"], r["slot"]) for r in xs)
    assert plain(again) == plain(rows)


def test_an_empty_table_and_one_row(spark):
    assert sharded(edge.empty(spark)).count() == 0
    assert [(r["shard"], r["slot"]) for r in sharded(edge.frame(spark, [(None, None)])).collect()] == [(0, 0)]
    with pytest.raises(ValueError):
        sharded(edge.empty(spark), 0)


def test_one_id_for_most_rows_spreads_over_ranges(spark):
    docs = spark.range(4000).select(F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(7).alias("doc_id"), F.lit("same").alias("text"))
    placed = sharded(docs, 4)
    laws(placed.collect(), 4)
    (folder,) = {f.rpartition("/")[0] for f in placed.inputFiles()}
    sizes = spark.read.parquet(folder).groupBy("_range").count().collect()
    assert len(sizes) > 1 and max(r["count"] for r in sizes) < 2500
    forget(placed)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(folder).count()


def test_written_shards_hold_their_slots_in_order(spark, tmp_path):
    path = f"file://{tmp_path}/shards"
    write_shards(sharded(edge.frame(spark), 3), path, slots_a_file=4)
    back = spark.read.parquet(path).withColumn("file", F.input_file_name()).withColumn("at", F.monotonically_increasing_id()).collect()
    laws(back, 3)
    assert len(back) == len(edge.texts())
    for file in {r["file"] for r in back}:
        own = sorted((r for r in back if r["file"] == file), key=lambda r: r["at"])
        assert len(own) <= 4 and len({(r["shard"], r["stretch"]) for r in own}) == 1
        assert [r["slot"] for r in own] == sorted(r["slot"] for r in own)


def test_query_plan_runs_no_python(spark):
    plan = QUERIES["op12_shards"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
