"""The BigWig source: index walk, pushed conditions, what is read of a file, files beyond 4 GB."""

import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitelark.operators import signal
from sitelark.sources import bigwig


def deep_big_wig(chroms: dict[str, list[tuple[int, int, float]]], per_block: int = 4, per_node: int = 3, gap: int = 0) -> tuple[bytes, list[tuple[int, bytes]]]:
    """Header and index of a file with a tree of several levels, and its blocks with their offsets; ``gap`` bytes stand before the blocks."""
    names = sorted(chroms)
    key = max(map(len, names))
    tree = struct.pack("<IIIIQQ", bigwig.TREE_MAGIC, len(names), key, 8, len(names), 0) + struct.pack("<BBH", 1, 0, len(names))
    tree += b"".join(n.encode().ljust(key, b"\0") + struct.pack("<II", i, 1 << 30) for i, n in enumerate(names))
    blocks, at = [], 64 + len(tree) + gap
    for i, n in enumerate(names):
        rows = chroms[n]
        for k in range(0, len(rows), per_block):
            part = rows[k : k + per_block]
            body = zlib.compress(struct.pack("<IIIIIBBH", i, part[0][0], part[-1][1], 0, 0, bigwig.BED_GRAPH, 0, len(part)) + b"".join(struct.pack("<IIf", *r) for r in part))
            blocks.append(((i, part[0][0]), (i, part[-1][1]), at, body))
            at += len(body)
    index_at = at
    level = [(x[0], x[1], x[2], len(x[3])) for x in blocks]
    leaf, nodes = True, []
    layers = []
    while True:
        groups = [level[k : k + per_node] for k in range(0, len(level), per_node)] or [[]]
        layers.append((leaf, groups))
        level, leaf = [(g[0][0], g[-1][1], None, 0) if g else ((0, 0), (0, 0), None, 0) for g in groups], False
        if len(groups) == 1:
            break
    # the root comes first, then layer by layer
    place = index_at + 48
    offsets = []
    for is_leaf, groups in reversed(layers):
        own = []
        for g in groups:
            own.append(place)
            place += 4 + (32 if is_leaf else 24) * len(g)
        offsets.append(own)
    out = b""
    for depth, (is_leaf, groups) in enumerate(reversed(layers)):
        child = 0
        for g in groups:
            out += struct.pack("<BBH", int(is_leaf), 0, len(g))
            for low, high, offset, size in g:
                if is_leaf:
                    out += struct.pack("<IIIIQQ", *low, *high, offset, size)
                else:
                    out += struct.pack("<IIIIQ", *low, *high, offsets[depth + 1][child])
                    child += 1
    index = struct.pack("<IIQIIIIQII", bigwig.INDEX_MAGIC, per_node, len(blocks), 0, 0, 0, 0, 0, 1, 0) + out
    head = struct.pack("<IHHQQQHHQQIQ", bigwig.MAGIC, 4, 0, 64, 64 + len(tree), index_at, 0, 0, 0, 0, 1 << 16, 0) + tree
    del nodes
    return head, [*((o, b) for _, _, o, b in blocks), (index_at, index)]


def rows_of(n: int, chroms=("chr1", "chr2", "chr10")) -> dict[str, list[tuple[int, int, float]]]:
    return {c: [(10 * k, 10 * k + 7, float(np.float32(math.sin(k + j)))) for k in range(n)] for j, c in enumerate(chroms)}


def write(path, chroms, **how):
    head, parts = deep_big_wig(chroms, **how)
    with open(path, "wb") as f:
        f.write(head)
        for at, body in parts:
            f.seek(at)
            f.write(body)
    return str(path)


def plain(df):
    return sorted((r["chrom"], r["start"], r["end"], r["value"]) for r in df.collect())


@pytest.fixture
def track(tmp_path):
    chroms = rows_of(200)
    return write(tmp_path / "a.bw", chroms), [(c, *r) for c, rows in chroms.items() for r in rows]


def test_partitions_are_stretches_of_leaves(spark, track):
    path, want = track
    df = bigwig.read_bigwig(spark, path)
    assert df.rdd.getNumPartitions() > 2 and plain(df) == sorted(want)
    assert plain(bigwig.read_bigwig(spark, f"file://{path}")) == sorted(want)


@pytest.mark.parametrize("condition", ["chrom = 'chr2'", "chrom = 'chr2' AND start < 530 AND end > 470", "chrom IN ('chr1', 'chr10') AND start >= 1990", "start = 40", "end <= 7", "end = 47 AND chrom = 'chr1'", "chrom = 'absent'", "chrom = 'chr1' AND chrom = 'chr2'", "start > 5000", "value > 0.9 AND start <= 100", "chrom = 'chr1' OR start = 40"])
def test_conditions_give_what_a_filter_gives(spark, track, condition):
    path, _ = track
    held = spark.createDataFrame(bigwig.read_bigwig(spark, path).collect(), bigwig.COLUMNS)
    assert plain(bigwig.read_bigwig(spark, path).where(condition)) == plain(held.where(condition))


def counted(path):
    """A read function that notes what it is asked for."""
    asked = []
    with open(path, "rb") as f:
        data = f.read()

    def at(offset, size):
        asked.append((offset, size))
        return data[offset : offset + size]

    return at, asked


def test_a_window_reads_its_own_blocks_alone(track):
    path, want = track
    at, asked = counted(path)
    window = bigwig.Wanted(frozenset(["chr2"]), start_below=530, end_from=471)
    head = bigwig.opened(at)
    nodes = bigwig.leaves(at, head, window)
    blocks = bigwig.wanted_blocks(at, head, nodes, window)
    every = bigwig.wanted_blocks(at, head, bigwig.leaves(at, head, bigwig.Wanted()), bigwig.Wanted())
    assert 1 <= len(blocks) <= 3 < len(every) and len(nodes) <= 2
    asked.clear()
    got = [r for c, s, e, v in bigwig.contents(at, head, blocks) for r in zip(s.tolist(), e.tolist(), v.tolist(), strict=True)]
    assert {(s, e, v) for c, s, e, v in want if c == "chr2" and s < 530 and e > 470} <= set(got)
    assert sum(size for _, size in asked) == sum(size for _, size in blocks) and len(asked) == 1


def test_options_and_pushed_conditions_reach_the_plan(spark, track):
    path, want = track
    spark.dataSource.register(bigwig.BigWigSource)
    near = spark.read.format("bigwig").option("chrom", "chr2").option("from", "470").option("to", "530").load(path)
    assert plain(near) == sorted(r for r in want if r[0] == "chr2" and r[1] < 530 and r[2] > 470)
    whole, one = bigwig.read_bigwig(spark, path), bigwig.read_bigwig(spark, path).where("chrom = 'chr2' AND start < 530 AND end > 470")
    assert one.rdd.getNumPartitions() < whole.rdd.getNumPartitions()
    reader = bigwig.FilteredBigWigReader({"path": path})
    from pyspark.sql.datasource import EqualTo, GreaterThan, LessThan

    value = GreaterThan(("value",), 0.5)
    assert list(reader.pushFilters([EqualTo(("chrom",), "chr2"), LessThan(("start",), 530), GreaterThan(("end",), 470), value])) == [value]
    assert sum(len(p.nodes) for p in reader.partitions()) <= 2


def test_blocks_beyond_four_gigabytes(spark, tmp_path):
    """A sparse file whose blocks and index lie beyond what 32 bits address: no whole file is read, no offset is cut."""
    path = write(tmp_path / "far.bw", rows_of(30), gap=5 << 30)
    assert plain(bigwig.read_bigwig(spark, path).where("chrom = 'chr10'")) == sorted(("chr10", *r) for r in rows_of(30)["chr10"])


def test_folders_several_files_and_damage(spark, tmp_path):
    (tmp_path / "d").mkdir()
    a, b = write(tmp_path / "d" / "a.bw", rows_of(5)), write(tmp_path / "d" / "b.bw", rows_of(9, ("x",)))
    (tmp_path / "d" / "_SUCCESS").write_bytes(b"")
    assert bigwig.read_bigwig(spark, str(tmp_path / "d")).groupBy("file").count().count() == 2
    assert bigwig.read_bigwig(spark, f"{a},{b}").count() == 24
    (tmp_path / "no.bw").write_bytes(b"short")
    with pytest.raises(Exception, match="not a BigWig file"):
        bigwig.read_bigwig(spark, str(tmp_path / "no.bw")).count()
    with pytest.raises(Exception, match="no-such"):
        bigwig.read_bigwig(spark, str(tmp_path / "no-such.bw")).count()
    assert bigwig.read_bigwig(spark, write(tmp_path / "none.bw", {"c": []})).count() == 0


def test_run_moments_equal_those_of_bases(spark):
    """Runs of many widths, gaps, overlaps, a constant window, strands, and sites without any run."""
    rng = np.random.default_rng(3)
    runs, at = [], 0
    for k in range(120):
        size = int(rng.choice([1, 2, 7, 40, 900]))
        runs.append((("a", "b")[k % 2], "+" if k % 3 else "-", at, at + size, ("native", "fixed")[k % 5 == 0], float(rng.integers(0, 5))))
        at += size + int(rng.integers(0, 3))
    runs += [("a", "+", 100, 100, "native", 9.0), ("a", "+", 50, 60, "native", None)]
    sites = [(k, ("a", "b")[k % 2], "+-"[k % 3 == 0], int(p)) for k, p in enumerate(rng.integers(-50, at + 50, 60))]
    got = {r["site"]: r.asDict() for r in signal.run_moments(spark.createDataFrame(sites, "site long, chrom string, strand string, pos long"), spark.createDataFrame(runs, "chrom string, strand string, start long, end long, cond string, val double"), 30, 200).collect()}
    for site, chrom, strand, pos in sites:
        for cond in ("native", "fixed"):
            bases = [(p, v) for c, s, a, b, k, v in runs if (c, s, k) == (chrom, strand, cond) and v is not None for p in range(max(a, pos - 200), min(b, pos + 200))]
            for name, part in (("in", [v for p, v in bases if pos - 30 <= p < pos + 30]), ("out", [v for p, v in bases if not pos - 30 <= p < pos + 30])):
                row = got.get(site, {})
                assert (row.get(f"n_{cond}_{name}") or 0) == len(part)
                if part:
                    assert abs(row[f"mean_{cond}_{name}"] - np.mean(part)) < 1e-9 and abs(row[f"var_{cond}_{name}"] - np.var(part)) < 1e-9
                    assert len(set(part)) > 1 or row[f"var_{cond}_{name}"] == 0


def test_dense_scores_explode_no_base(spark):
    runs = spark.createDataFrame([("a", "+", 0, 10**9, "native", 1.0), ("a", "+", 0, 10**9, "fixed", 2.0)], "chrom string, strand string, start long, end long, cond string, val double")
    sites = spark.range(50).select("id", F.lit("a").alias("chrom"), F.lit("+").alias("strand"), (F.col("id") * 10_000_000).alias("pos")).withColumnRenamed("id", "site")
    assert signal.site_score_dense(sites, runs).groupBy("s_l").count().collect() == [(0.0, 50)]
