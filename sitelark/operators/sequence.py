"""Scoring of sequence windows with a position-weight matrix.

Contigs are cut into tiles with a halo on both sides, and the tiles are dealt out anew over all shuffle partitions, so that a chromosome
spreads over tasks; a tile is scored on both strands in numpy, with prefix sums for all windows, and the tile size never changes a result. Near a contig's end a score window keeps its
width and stays where it last fitted; GC windows are cut off there instead.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shared import written
from .ranks import first_rows

TILE = 1 << 18
#: Bases of short contigs that are scored at once: some 200 bytes a base while it works.
GROUP = 1 << 16
CODES = np.full(256, 255, np.uint8)
for _k, _letters in enumerate((b"A", b"C", b"G", b"TU")):
    for _b in _letters:
        CODES[_b] = _k
#: The code of the base that pairs with each; a letter that is none stays so.
PAIRED = np.full(256, 255, np.uint8)
PAIRED[:4] = (3, 2, 1, 0)
SCAN = (
    "chrom string, contig_order bigint, pos1 bigint, strand string, inner_mean double, outer_mean double, "
    "gc_inner_pct double, gc_outer_pct double, kmer_count_inner int, kmer_count_outer int"
)


def base_composition(seqs: DataFrame) -> DataFrame:
    """base, n, share over all sequences; a base that never occurs counts once; U counts as T."""
    n = lambda letters: F.sum(F.length("seq") - F.length(F.translate("seq", letters, "")))
    counts = seqs.agg(*(F.greatest(F.coalesce(n(x), F.lit(0)), F.lit(1)).alias(x[0]) for x in ("A", "C", "G", "TU")))
    whole = F.col("A") + F.col("C") + F.col("G") + F.col("T")
    rows = F.array(*(F.struct(F.lit(b).alias("base"), F.col(b).cast("bigint").alias("n"), (F.col(b) / whole).alias("share")) for b in "ACGT"))
    return counts.select(F.explode(rows).alias("r")).select("r.*")


def count_matrix(seqs: DataFrame, size: int) -> DataFrame:
    """k, base, n: how many sequences have a base at place k (0-based, below size); U counts as T, other letters not at all."""
    at = lambda k: F.translate(F.substring("seq", k + 1, 1), "U", "T")
    sums = [F.coalesce(F.count_if(at(k) == b), F.lit(0)).alias(f"n_{k}_{b}") for k in range(size) for b in "ACGT"]
    rows = F.array(*(F.struct(F.lit(k).cast("bigint").alias("k"), F.lit(b).alias("base"), F.col(f"n_{k}_{b}").alias("n")) for k in range(size) for b in "ACGT"))
    return seqs.agg(*sums).select(F.explode(rows).alias("r")).select("r.*")


def log_matrix(counts: DataFrame, background: DataFrame | None = None) -> DataFrame:
    """k, base, logp of a matrix k, base, n: each place's shares after 1e-9 is added everywhere, in natural logarithms.

    With a background (base, share) also llr, the logarithm of share over background share.
    """
    p = F.col("n").cast("double") + 1e-9
    logp = counts.select("k", "base", F.ln(p / F.sum(p).over(Window.partitionBy("k"))).alias("logp"))
    if background is None:
        return logp
    q = background.select("base", F.col("share").alias("_q"))  # four rows
    return logp.join(F.broadcast(q), "base").select("k", "base", "logp", (F.col("logp") - F.ln("_q")).alias("llr"))


def log_ratios(logp: np.ndarray, background: np.ndarray) -> np.ndarray:
    """Natural-log probabilities [L, 4] minus the log of the background."""
    q = np.asarray(background, np.float64)
    return np.asarray(logp, np.float64) - np.log(q / q.sum())


def kmer_scores(codes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Score (single precision, as double) and validity of each k-mer start; a k-mer with a letter that is no base scores 0."""
    size = len(weights)
    n = max(0, len(codes) - size + 1)
    score, valid, base = np.zeros(n), np.ones(n, bool), codes < 4
    for k in range(size):
        of = np.zeros(256)
        of[:4] = weights[k]
        valid &= base[k : k + n]
        score += of.take(codes[k : k + n])
    return np.where(valid, score, 0.0).astype(np.float32).astype(np.float64), valid


def scan_tile(codes: np.ndarray, at: int, first: int, last: int, n: int, weights: np.ndarray, inner: int, outer: int) -> dict[str, np.ndarray]:
    """All windows of the centres first..last-1 (0-based) of a contig of n bases; codes is its part that starts at ``at``."""
    return scan_centres(codes, np.arange(first, last), -at, n, weights, inner, outer)


def scan_centres(codes: np.ndarray, i: np.ndarray, off: np.ndarray | int, n: np.ndarray | int, weights: np.ndarray, inner: int, outer: int, wanted: Sequence[str] | None = None) -> dict[str, np.ndarray]:
    """All windows of the centres i (0-based in their contigs of n bases), where base b of a centre's contig stands at codes[off + b].

    Parts of many contigs may stand behind each other in codes: no window leaves its contig. wanted: columns that are needed; pos1 and kmer_count_inner always are.
    """
    score, valid = kmer_scores(codes, weights)
    prefix = [np.concatenate([np.zeros(1, t), np.cumsum(x, dtype=t)]) for x, t in ((score, np.float64), (valid, np.int64), ((codes == 1) | (codes == 2), np.int64))]
    if outer < inner or 2 * inner - len(weights) + 2 <= 0 or outer - inner - len(weights) + 1 <= 0 or len(codes) < 2 * outer + 1:
        return _centres_anywhere(prefix, i, off, n, len(weights), inner, outer, wanted)
    # where no window meets an end, each is one difference at a fixed distance; the centres near ends are done one by one
    out = _centres_inside(prefix, np.clip(i + off - outer, 0, len(codes) - 2 * outer - 1), len(weights), inner, outer, wanted)
    edge = np.flatnonzero((i < outer) | (i > n - 1 - outer))
    if len(edge):
        near = _centres_anywhere(prefix, i[edge], off if np.ndim(off) == 0 else off[edge], n if np.ndim(n) == 0 else n[edge], len(weights), inner, outer, wanted)
        for c, v in near.items():
            if c != "pos1":
                out[c][edge] = v
    return {"pos1": i + 1} | out


def _centres_inside(prefix: list[np.ndarray], at: np.ndarray, size: int, inner: int, outer: int, wanted: Sequence[str] | None) -> dict[str, np.ndarray]:
    """All windows of centres whose contigs reach over outer bases on both sides; at: where their outer windows begin."""
    needs = lambda *names: wanted is None or any(c in wanted for c in names)
    sums, counts, gc = prefix
    places, w_in, w_out = len(gc) - 2 * outer - 1, 2 * inner - size + 2, outer - inner - size + 1

    def over(x: np.ndarray, first: int, width: int) -> np.ndarray:
        return x[first + width : first + width + places] - x[first : first + places]

    n_in = over(counts, outer - inner, w_in)
    out = {"kmer_count_inner": n_in}
    with np.errstate(divide="ignore", invalid="ignore"):
        if needs("inner_mean"):
            out["inner_mean"] = np.where(n_in > 0, over(sums, outer - inner, w_in) / n_in, np.nan)
        if needs("outer_mean", "kmer_count_outer"):
            sum_out, n_out = (over(x, 0, w_out) + over(x, outer + inner + 1, w_out) for x in (sums, counts))
            out |= {"outer_mean": np.where(n_out > 0, sum_out / n_out, np.nan), "kmer_count_outer": n_out}
        if needs("gc_inner_pct", "gc_outer_pct"):
            flanks = over(gc, 0, outer - inner) + over(gc, outer + inner + 1, outer - inner)
            out |= {"gc_inner_pct": over(gc, outer - inner, 2 * inner + 1) * 100.0 / (2 * inner + 1), "gc_outer_pct": flanks * 100.0 / (2 * (outer - inner))}
    return {c: v.take(at) for c, v in out.items()}


def _centres_anywhere(prefix: list[np.ndarray], i: np.ndarray, off: np.ndarray | int, n: np.ndarray | int, size: int, inner: int, outer: int, wanted: Sequence[str] | None) -> dict[str, np.ndarray]:
    needs = lambda *names: wanted is None or any(c in wanted for c in names)
    sums, counts, gc = prefix

    def over(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start, end = start + off, end + 1 + off
        return sums[end] - sums[start], counts[end] - counts[start]

    none = np.zeros(len(i)), np.zeros(len(i), np.int64)
    w_in, w_out = 2 * inner - size + 2, outer - inner - size + 1
    held = np.minimum(i, n - 1 - inner)
    sum_in, n_in = over(np.maximum(held - inner, 0), held + inner - size + 1) if w_in > 0 else none
    out = {"pos1": i + 1, "kmer_count_inner": n_in}
    with np.errstate(divide="ignore", invalid="ignore"):
        if needs("inner_mean"):
            out["inner_mean"] = np.where(n_in > 0, sum_in / n_in, np.nan)
        if needs("outer_mean", "kmer_count_outer"):
            end = np.maximum(i - inner - size, 0)
            left = over(np.maximum(end - w_out + 1, 0), end) if w_out > 0 else none
            held = np.minimum(i, n - 1 - outer)
            right = over(held + inner + 1, held + outer - size + 1) if w_out > 0 else none
            sum_out, n_out = left[0] + right[0], left[1] + right[1]
            out |= {"outer_mean": np.where(n_out > 0, sum_out / n_out, np.nan), "kmer_count_outer": n_out}
    if not needs("gc_inner_pct", "gc_outer_pct"):
        return out

    def bases(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start, end = np.clip(start, 0, n), np.clip(end, 0, n)
        return gc[np.maximum(end, start) + off] - gc[start + off], np.maximum(end - start, 0)

    g_in, l_in = bases(i - inner, i + inner + 1)
    g_left, l_left = bases(i - outer, i - inner)
    g_right, l_right = bases(i + inner + 1, i + outer + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        around = np.where(l_left + l_right > 0, (g_left + g_right) * 100.0 / (l_left + l_right), np.nan)
        return out | {"gc_inner_pct": g_in * 100.0 / l_in, "gc_outer_pct": around}


TILES = "chrom string, contig_order bigint, n bigint, first bigint, last bigint, start bigint, part string"


def tiles(seqs: DataFrame, tile: int, halo: int) -> DataFrame:
    """Pieces of ``tile`` bases with a halo on both sides, dealt out anew by contig and place: a contig's tiles lie in many partitions."""
    names = [c.strip().split()[0] for c in TILES.split(",")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                seq = batch.column(2)[k].as_py()
                n, first = len(seq), np.arange(0, len(seq), tile)
                start, last = np.maximum(first - halo, 0), np.minimum(first + tile, n)
                for at in range(0, len(first), 64):  # a batch holds a bounded part of a contig
                    f, s, e = first[at : at + 64], start[at : at + 64], last[at : at + 64]
                    part = pa.array([seq[a : b + halo] for a, b in zip(s.tolist(), e.tolist(), strict=True)], pa.string())
                    same = [pa.repeat(batch.column(c)[k], len(f)) for c in (0, 1)]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(np.full(len(f), n)), pa.array(f), pa.array(e), pa.array(s), part], names)

    whole = seqs.select(F.col("chrom").cast("string").alias("chrom"), F.col("contig_order").cast("bigint").alias("contig_order"), F.col("seq").cast("string").alias("seq"))
    # by a number of partitions: tiles are small beside the rows that they give, and adaptive plans would put them together by their own size
    return whole.mapInArrow(cut, TILES).repartition(int(seqs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "chrom", "first")


def _ends(score: np.ndarray, keep: tuple[int, int], slack: float) -> np.ndarray:
    """Which scores may be among the keep[0] highest or the keep[1] lowest of all; ties with the last one stay."""
    chosen = np.zeros(len(score), bool)
    for n, x in zip(keep, (-score, score), strict=True):
        if n >= len(score):
            return np.ones(len(score), bool)
        if n > 0:
            chosen |= x <= np.partition(x, n - 1)[n - 1] + slack
    return chosen


#: Classes of inner means by which the two ends of a scan are cut out; a mean lies between the least and the greatest score of a k-mer.
BINS = 1 << 16


def _classes(score: np.ndarray, low: float, high: float) -> np.ndarray:
    """The class of each score: the same one whenever the same score is classed, and never smaller for a greater score."""
    width = (high - low) or 1.0
    return np.clip(np.floor((score - low) / width * BINS), 0, BINS - 1).astype(np.int64)


def _weighted(pos: np.ndarray, values: np.ndarray, scale: float, first: np.ndarray) -> list[int]:
    """The sums of positions times values (scaled and rounded, half away from 0; 0 for one that is no number) from each of these rows up to the next."""
    if values.dtype.kind == "f":
        scaled = np.where(np.isnan(values), 0.0, values) * scale
        values = np.trunc(scaled).astype(np.int64)
        rest = scaled - values
        values += (rest >= 0.5).astype(np.int64) - (rest <= -0.5)
    if float(pos.max()) * max(float(values.max()), -float(values.min()), 1.0) * len(pos) >= 2.0**63:  # beyond 64 bits: exactly, and an error where a sum does not fit
        return np.add.reduceat(pos.astype(object) * values.astype(object), first).tolist()
    return np.add.reduceat(pos * values, first).tolist()


def scan_windows(seqs: DataFrame, weights: np.ndarray, inner: int = 50, outer: int = 500, strands: bool = True, tile: int = TILE, columns: Sequence[str] | None = None, keep: tuple[int, int] | None = None, slack: float = 0.0, ends: tuple[int, int] | None = None, counted: bool = False, weighted: Mapping[str, tuple[str, float]] | None = None) -> DataFrame:
    """Every centre of every contig with at least one valid inner k-mer, on one or both strands.

    seqs: chrom, seq (upper case), contig_order. weights: log ratios [L, 4]. Contigs shorter than max(2*inner+1, 2*outer+1, L) are
    skipped. pos1 is 1-based and always counted on the forward strand. columns: those of SCAN that are wanted. keep: the numbers of
    highest and lowest inner means that are wanted, of which each tile gives its own, with what is within ``slack`` of the last one.
    counted: rows (bin, n) instead, the number of a tile's centres in each of BINS classes of inner means. ends: only centres whose class is
    at least ends[0] or at most ends[1]. weighted: rows (contig_order, strand, names) instead, one a tile and strand with any centre: for each name the sum
    over its centres of pos1 times a column, multiplied by a scale and rounded; no row a centre leaves the scan.
    """
    if outer <= inner:
        raise ValueError("outer must be greater than inner")
    size = len(weights)
    whole = seqs.where(F.length("seq") >= max(2 * inner + 1, 2 * outer + 1, size))
    kinds = dict(c.strip().split() for c in SCAN.split(","))
    names = list(columns or kinds)
    needed = [*([c for c, _ in weighted.values()] if weighted else names), *(["inner_mean"] if counted or keep is not None or ends is not None else [])]
    low, high = float(weights.min(axis=1).sum()), float(weights.max(axis=1).sum())

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, first, last, start = (batch.column(c).to_numpy() for c in ("n", "first", "last", "start"))
            mixed: list[tuple] = []
            groups = np.cumsum(pc.binary_length(batch.column("part")).to_numpy()) // min(tile, GROUP)
            for g in np.unique(groups):  # short contigs are scored together; no more than a group is ever unpacked
                at = np.flatnonzero(groups == g)
                parts = [CODES[np.frombuffer(x.encode("latin-1", "replace"), np.uint8)] for x in batch.column("part").slice(at[0], len(at)).to_pylist()]
                codes = np.concatenate(parts)
                length, count = np.array([len(x) for x in parts]), last[at] - first[at]
                before, owner = np.cumsum(length) - length, np.repeat(at, count)
                ahead = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
                for strand in "+-" if strands else "+":
                    if strand == "+":
                        x = scan_centres(codes, first[owner] + ahead, np.repeat(before - start[at], count), n[owner], weights, inner, outer, needed)
                    else:
                        turned = len(codes) - before - length - (n[at] - start[at] - length)
                        x = scan_centres(PAIRED[codes[::-1]], n[owner] - last[owner] + ahead, np.repeat(turned, count), n[owner], weights, inner, outer, needed)
                        x["pos1"] = n[owner] - x["pos1"] + 1
                    kept = np.flatnonzero(x["kmer_count_inner"] > 0)
                    if keep is not None:
                        kept = kept[_ends(x["inner_mean"][kept], keep, slack)]
                    if counted:
                        found, n_found = np.unique(_classes(x["inner_mean"][kept], low, high), return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(n_found.astype(np.int64))], ["bin", "n"])
                        continue
                    if ends is not None:
                        which = _classes(x["inner_mean"][kept], low, high)
                        kept = kept[(which >= ends[0]) | (which <= ends[1])]
                    if weighted is not None:
                        if len(kept):
                            mine = owner[kept]
                            begin = np.flatnonzero(np.r_[True, mine[1:] != mine[:-1]])
                            pos = x["pos1"][kept]
                            contigs = batch.column("contig_order").take(pa.array(mine[begin])).to_pylist()
                            mixed += zip(contigs, [strand] * len(begin), *(_weighted(pos, x[c][kept], scale, begin) for c, scale in weighted.values()), strict=True)
                        continue
                    rows = pa.array(owner[kept])
                    own = {"chrom": lambda: batch.column("chrom").take(rows), "contig_order": lambda: batch.column("contig_order").take(rows), "strand": lambda: pa.repeat(pa.scalar(strand), len(kept))}  # noqa: B023
                    out = [own[c]() if c in own else pa.array(x[c][kept].astype(np.int32) if kinds[c] == "int" else x[c][kept]) for c in names]
                    yield pa.RecordBatch.from_arrays(out, names)
            if mixed:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k == 1 else pa.int64()) for k, c in enumerate(zip(*mixed, strict=True))], ["contig_order", "strand", *weighted])

    schema = "bin int, n bigint" if counted else ", ".join(f"{c} {kinds[c]}" for c in names) if weighted is None else ", ".join(["contig_order bigint", "strand string", *(f"{c} bigint" for c in weighted)])
    return tiles(whole, tile, outer + 2 * inner + size).mapInArrow(score, schema)


TIE = ("contig_order", "pos1", "strand")


def top_sites(scan: DataFrame, n: int, score: str = "inner_mean") -> DataFrame:
    """The n highest scores over all contigs and strands; ties by contig, position, strand."""
    return scan.orderBy(F.desc(score), *TIE).limit(n)


def bottom_sites(scan: DataFrame, n: int, score: str = "inner_mean") -> DataFrame:
    return scan.orderBy(F.asc(score), *TIE).limit(n)


def scan_ends(seqs: DataFrame, weights: np.ndarray, inner: int, outer: int, top: int, bottom: int, strands: bool = True, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """The ``top`` highest and ``bottom`` lowest inner means over all contigs and strands, all columns, in the order of top_sites and bottom_sites.

    A first pass counts the centres of each class of scores; the classes that hold the last wanted ones bound a second pass, which gives both ends at
    once, and only these rows are sorted, in ranges. So no task ever merges the rows of others, however many are wanted and however many tie.
    """
    classes = scan_windows(seqs, weights, inner, outer, strands, tile, counted=True).groupBy("bin").agg(F.sum("n").alias("n")).orderBy("bin").collect()  # at most BINS rows

    def cut(rows: Sequence, wanted: int, none: int) -> int:
        seen, at = 0, none
        for r in rows:
            if seen >= wanted:
                break
            seen, at = seen + r["n"], r["bin"]
        return at

    ends = cut(classes[::-1], top, BINS), cut(classes, bottom, -1)
    both = written(scan_windows(seqs, weights, inner, outer, strands, tile, ends=ends), "scan-ends")
    tie = [F.col(c) for c in TIE]
    width = (float(weights.max(axis=1).sum() - weights.min(axis=1).sum())) or 1.0
    # the classes once more, a hair wider: only to spare each end the other's rows
    edge = lambda b, hair: float(weights.min(axis=1).sum()) + (b + hair) * width / BINS
    upper = both.where(F.col("inner_mean") >= edge(ends[0], -0.5)) if ends[0] > 0 else both
    lower = both.where(F.col("inner_mean") <= edge(ends[1], 1.5)) if ends[1] < BINS - 1 else both
    best = first_rows(upper, top, [-F.col("inner_mean"), *tie]) if top else both.where("false")
    worst = first_rows(lower, bottom, [F.col("inner_mean"), *tie]) if bottom else both.where("false")
    return best, worst


def in_output_order(scan: DataFrame) -> DataFrame:
    return scan.orderBy("contig_order", "pos1", "strand")
