"""BigWig tracks as a Spark data source: rows (file, chrom, start, end, value), half-open, 0-based.

A file is split by its own index: a partition is a few neighbouring leaves of the R-tree, and reads only their blocks, by position. Conditions on chrom,
start and end reach the walk through the index, so that a query of one window opens the leaves and blocks of that window alone. No file is ever read
whole, so its size has no bound. Files are opened through pyarrow's file systems (local, hdfs, s3, gs), on the executors too.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

#: Fixed values of the format.
MAGIC, TREE_MAGIC, INDEX_MAGIC = 0x888FFC26, 0x78CA8C91, 0x2468ACE0
BED_GRAPH, VARIABLE_STEP, FIXED_STEP = 1, 2, 3
#: Leaves of a partition, and bytes that neighbouring blocks are read together up to.
LEAVES, RUN_BYTES = 16, 4 << 20
COLUMNS = "file string, chrom string, start bigint, end bigint, value double"
#: Greatest position of the format.
END = 1 << 32

ReadAt = Callable[[int, int], bytes]


@dataclass
class Wanted:
    """What of a track is asked for: chromosomes (None: all) and positions that an interval's start and end must lie in."""

    chroms: frozenset[str] | None = None
    start_from: int = 0
    start_below: int = END
    end_from: int = 0
    end_below: int = END + 1

    def meets(self, low: tuple[int, int], high: tuple[int, int], ids: dict[int, str]) -> bool:
        """Whether a stretch of the index, from low to high (chromosome and base), may hold a wanted interval."""
        if self.start_from >= self.start_below or self.end_from >= self.end_below:
            return False
        if self.chroms is not None and not any(name in self.chroms for i, name in ids.items() if low[0] <= i <= high[0]):
            return False
        return low[0] != high[0] or (low[1] < self.start_below and low[1] < self.end_below and high[1] >= self.start_from and high[1] >= self.end_from)


@dataclass
class Track:
    """A file's header: byte order, names of chromosomes, place of the index, whether blocks are packed."""

    end: str
    names: dict[int, str]
    index: int
    packed: bool
    steps: list[tuple[int, int]] = field(default_factory=list)


def opened(at: ReadAt) -> Track:
    head = at(0, 64)
    end = "<" if len(head) == 64 and struct.unpack_from("<I", head)[0] == MAGIC else ">"
    if len(head) < 64 or struct.unpack_from(end + "I", head)[0] != MAGIC:
        raise ValueError("not a BigWig file")
    _, _, _, tree, _, index, _, _, _, _, unpacked, _ = struct.unpack_from(end + "IHHQQQHHQQIQ", head)
    return Track(end, dict(_names(at, tree, end)), index, unpacked > 0)


def _names(at: ReadAt, tree: int, end: str) -> Iterator[tuple[int, str]]:
    magic, _, key_size, _ = struct.unpack(end + "IIII", at(tree, 16))
    if magic != TREE_MAGIC:
        raise ValueError("the chromosome tree is damaged")
    stack = [tree + 32]
    while stack:
        node = stack.pop()
        leaf, _, count = struct.unpack(end + "BBH", at(node, 4))
        items = at(node + 4, count * (key_size + 8))
        for k in range(count):
            item = k * (key_size + 8)
            if leaf:
                yield struct.unpack_from(end + "I", items, item + key_size)[0], items[item : item + key_size].rstrip(b"\0").decode()
            else:
                stack.append(struct.unpack_from(end + "Q", items, item + key_size)[0])


def _entries(at: ReadAt, node: int, end: str) -> tuple[bool, list[tuple[tuple[int, int], tuple[int, int], int, int]]]:
    """Whether a node is a leaf, and its entries: from, to, offset, size (0 in an inner node)."""
    leaf, _, count = struct.unpack(end + "BBH", at(node, 4))
    size = 32 if leaf else 24
    body = at(node + 4, size * count)
    rows = [struct.unpack_from(end + ("IIIIQQ" if leaf else "IIIIQ"), body, size * k) for k in range(count)]
    return bool(leaf), [((r[0], r[1]), (r[2], r[3]), r[4], r[5] if leaf else 0) for r in rows]


def leaves(at: ReadAt, track: Track, wanted: Wanted) -> list[int]:
    """Offsets of the leaves of the index that may hold wanted intervals, in file order; only inner nodes of wanted stretches are read."""
    if struct.unpack(track.end + "I", at(track.index, 4))[0] != INDEX_MAGIC:
        raise ValueError("the index is damaged")
    level = [track.index + 48]
    while level:
        if _entries_are_leaf(at, level[0], track.end):  # all leaves lie at one depth
            return level
        level = [child for node in level for low, high, child, _ in _entries(at, node, track.end)[1] if wanted.meets(low, high, track.names)]
    return []


def _entries_are_leaf(at: ReadAt, node: int, end: str) -> bool:
    return bool(struct.unpack(end + "BBH", at(node, 4))[0])


def wanted_blocks(at: ReadAt, track: Track, nodes: Iterable[int], wanted: Wanted) -> list[tuple[int, int]]:
    """Offset and size of the blocks below some leaves that may hold wanted intervals."""
    return [(offset, size) for node in nodes for low, high, offset, size in _entries(at, node, track.end)[1] if wanted.meets(low, high, track.names)]


def contents(at: ReadAt, track: Track, blocks: Sequence[tuple[int, int]]) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
    """Chromosome, starts, ends and values of blocks; neighbours in the file are read together."""
    k = 0
    while k < len(blocks):
        first, stop = k, blocks[k][0] + blocks[k][1]
        while k + 1 < len(blocks) and blocks[k + 1][0] == stop and stop + blocks[k + 1][1] - blocks[first][0] <= RUN_BYTES:
            k += 1
            stop += blocks[k][1]
        run = at(blocks[first][0], stop - blocks[first][0])
        for offset, size in blocks[first : k + 1]:
            yield _parsed(run[offset - blocks[first][0] : offset - blocks[first][0] + size], track)
        k += 1


def _parsed(block: bytes, track: Track) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    block, end = zlib.decompress(block) if track.packed else block, track.end
    chrom, start, _, step, span, kind, _, count = struct.unpack_from(end + "IIIIIBBH", block)
    fields = {BED_GRAPH: "start end value", VARIABLE_STEP: "start value", FIXED_STEP: "value"}[kind].split()
    rows = np.frombuffer(block, np.dtype([(f, end + ("f4" if f == "value" else "u4")) for f in fields]), count, 24)
    starts = rows["start"].astype(np.int64) if "start" in fields else start + step * np.arange(count, dtype=np.int64)
    return track.names[chrom], starts, rows["end"].astype(np.int64) if "end" in fields else starts + span, rows["value"].astype(np.float64)


def intervals(data: bytes) -> Iterator[tuple[str, int, int, float]]:
    """All intervals of a file's content, in its order."""
    at = lambda offset, size: data[offset : offset + size]
    track, every = opened(at), Wanted()
    for chrom, starts, ends, values in contents(at, track, wanted_blocks(at, track, leaves(at, track, every), every)):
        yield from zip(repeat(chrom), starts.tolist(), ends.tolist(), values.tolist(), strict=False)


def _filesystem(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[str]:
    """The files of a path: itself, or those in a folder (names that begin with a dot or an underscore are left out)."""
    system, inner = _filesystem(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [path]
    names = [x.base_name for x in system.get_file_info(fs.FileSelector(inner)) if x.type == fs.FileType.File and x.base_name[0] not in "._"]
    return [f"{path.rstrip('/')}/{n}" for n in sorted(names)]


def reading(path: str) -> tuple[pa.NativeFile, ReadAt]:
    """An open file, and a function that gives a range of its bytes."""
    system, inner = _filesystem(path)
    file = system.open_input_file(inner)

    def at(offset: int, size: int) -> bytes:
        file.seek(offset)
        return file.read(size)

    return file, at


@dataclass
class Leaves(InputPartition):
    file: str
    nodes: list[int]


class BigWigReader(DataSourceReader):
    """Reads without filters; conditions may be given as options chrom, from and to (intervals that touch [from, to))."""

    def __init__(self, options: dict[str, str]):
        self.paths = [p for p in options["path"].split(",") if p]
        self.wanted = Wanted()
        if "chrom" in options:
            self.wanted.chroms = frozenset(options["chrom"].split(","))
        if "to" in options:
            self.wanted.start_below = int(options["to"])
        if "from" in options:
            self.wanted.end_from = int(options["from"]) + 1

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for name in (f for p in self.paths for f in _files(p)):
            file, at = reading(name)
            with file:
                found = leaves(at, opened(at), self.wanted)
            out += [Leaves(name, found[k : k + LEAVES]) for k in range(0, len(found), LEAVES)]
        return out or [Leaves("", [])]

    def read(self, partition: Leaves) -> Iterator[pa.RecordBatch]:
        if not partition.nodes:
            return
        file, at = reading(partition.file)
        w = self.wanted
        with file:
            track = opened(at)
            for chrom, starts, ends, values in contents(at, track, wanted_blocks(at, track, partition.nodes, w)):
                if w.chroms is not None and chrom not in w.chroms:
                    continue
                kept = np.flatnonzero((starts >= w.start_from) & (starts < w.start_below) & (ends >= w.end_from) & (ends < w.end_below) & ~np.isnan(values))
                same = [pa.repeat(pa.scalar(x), len(kept)) for x in (partition.file, chrom)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(starts[kept]), pa.array(ends[kept]), pa.array(values[kept])], ["file", "chrom", "start", "end", "value"])


class FilteredBigWigReader(BigWigReader):
    """Takes conditions on chrom, start and end from the plan; sessions allow that with spark.sql.python.filterPushdown.enabled."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        w = self.wanted
        for f in filters:
            name, value = getattr(f, "attribute", ("",))[0], getattr(f, "value", None)
            if name == "chrom" and isinstance(f, EqualTo | In):
                chosen = frozenset([value] if isinstance(f, EqualTo) else value)
                w.chroms = chosen if w.chroms is None else w.chroms & chosen
            elif name in ("start", "end") and isinstance(value, int) and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
                if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
                    least = value + isinstance(f, GreaterThan)
                    setattr(w, f"{name}_from", max(getattr(w, f"{name}_from"), least))
                if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
                    below = value + (not isinstance(f, LessThan))
                    setattr(w, f"{name}_below", min(getattr(w, f"{name}_below"), below))
            else:
                yield f


class BigWigSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bigwig"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema) -> DataSourceReader:  # noqa: ARG002
        return (FilteredBigWigReader if self.options.get("pushdown") == "true" else BigWigReader)(dict(self.options))


def read_bigwig(spark: SparkSession, path: str) -> DataFrame:
    """The intervals of a file, of several (joined by commas) or of all in a folder. NaN values are left out."""
    spark.dataSource.register(BigWigSource)
    pushed = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("bigwig").option("pushdown", pushed).load(path)


def per_base(track: DataFrame) -> DataFrame:
    """A row (chrom, at, value) for each base of a track's intervals. Windows need none of it: they take moments of whole runs."""
    return track.where(F.col("end") > F.col("start")).select("chrom", F.explode(F.sequence("start", F.col("end") - 1)).alias("at"), "value")
