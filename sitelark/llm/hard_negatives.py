"""Hard negatives by a two-dimensional block matrix multiply.

Rows are cut into shards. An anchor shard meets every row shard in one place of a grid (each block is sent to the places of its grid row or
column, which spreads them over all tasks); there the products of their chunks of components are added up to the tile of int64 scores, as SUMMA does, and only
the best of every anchor go on: no score is ever shuffled. A first pass over shards of equal labels finds the positives; a second one over all shards finds,
in the window that each positive's score opens, the best rows of other labels. Nothing is approximate, no task holds more than two blocks and their tile, and
nothing but shard counts goes through the driver.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import dropped, written

#: Anchors and rows of a block of vectors of at most COMPONENTS components (longer ones have smaller blocks), components of a chunk, groups that labels are
#: dealt into for the first pass. A row is sent once for every ANCHORS anchors, an anchor once for every ROWS rows.
ANCHORS, ROWS, COMPONENTS, CHUNK, GROUPS = 1024, 2048, 256, 32, 64
#: Positives of an anchor, negatives of a positive, and the window of a negative's score in percent of the positive's.
POSITIVES, NEGATIVES, LOW, HIGH = 5, 3, 50, 95
#: Sums of products below this are exact in double precision.
EXACT = 1 << 53

POSITIVE = "arid bigint, vec_id bigint, score bigint"
NEGATIVE = "arid bigint, p int, vec_id bigint, score bigint"


def quantised(vectors: DataFrame, unit: int = 256) -> DataFrame:
    """rid, vec_id, label and q (floor(unit * x), bigint) of the rows that take part."""
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    whole = vectors.where(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & x.isNotNull()).where(finite)
    return whole.select(
        F.monotonically_increasing_id().alias("rid"),
        F.col("vec_id").cast("bigint").alias("vec_id"),
        F.col("label").cast("bigint").alias("label"),
        F.transform(x, lambda v: F.floor(v.cast("double") * unit)).cast("array<bigint>").alias("q"),
    )


def _matrix(parts: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Lists of at most width numbers as rows, short ones filled up with 0."""
    parts = parts.combine_chunks() if isinstance(parts, pa.ChunkedArray) else parts
    out = np.zeros((len(parts), width), np.int64)
    size = np.diff(parts.offsets.to_numpy())
    row = np.repeat(np.arange(len(parts)), size)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = parts.flatten().to_numpy()
    return out


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T in int64; through double precision where no sum can leave what that holds exactly."""
    most = lambda m: int(max(abs(int(m.max(initial=0))), abs(int(m.min(initial=0)))))
    if most(a) * most(b) * max(a.shape[1], 1) < EXACT:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def _tile(left: pa.Table, right: pa.Table, width: int) -> tuple[np.ndarray, list, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The whole tile of an anchor block and a row block, added up chunk by chunk where it stands: anchors, their bounds and labels, rows' rids, ids and labels, scores."""
    longest = max((int(np.diff(t[c].combine_chunks().offsets.to_numpy()).max(initial=0)) for t, c in ((left, "q"), (right, "b_q"))), default=0)
    a, b = _matrix(left["q"], longest), _matrix(right["b_q"], longest)
    scores = np.zeros((len(a), len(b)), np.int64)
    for k in range(0, longest, width):
        scores += product(a[:, k : k + width], b[:, k : k + width])
    return (left["rid"].to_numpy(), left["bounds"].to_pylist(), left["label"].to_numpy(), *(right[c].to_numpy() for c in ("b_rid", "b_id", "b_label")), scores)


def _table(schema: str, rows: dict[str, list[np.ndarray]]) -> pa.Table:
    kinds = {"int": np.int32, "bigint": np.int64}
    return pa.table({n: np.concatenate([np.zeros(0, kinds[k]), *(x.astype(kinds[k]) for x in rows[n])]).astype(kinds[k]) for n, k in (c.split() for c in schema.split(", "))})


def _best_positives(width: int, most: int):
    def reduce(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _table(POSITIVE, {"arid": [], "vec_id": [], "score": []})
        anchors, _, own, rids, ids, labels, scores = _tile(left, right, width)
        out: dict[str, list] = {"arid": [], "vec_id": [], "score": []}
        for k, arid in enumerate(anchors):
            at = np.flatnonzero((labels == own[k]) & (rids != arid))
            s = scores[k, at]
            if len(at) > most:
                near = s >= np.partition(s, len(s) - most)[len(s) - most]  # ties with the last one stay
                at, s = at[near], s[near]
            best = np.lexsort((ids[at], -s))[:most]
            out["arid"].append(np.full(len(best), arid))
            out["vec_id"].append(ids[at[best]])
            out["score"].append(s[best])
        return _table(POSITIVE, out)

    return reduce


def _best_negatives(width: int, most: int, low: int, high: int):
    def reduce(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _table(NEGATIVE, {"arid": [], "p": [], "vec_id": [], "score": []})
        anchors, bounds, own, _, ids, labels, scores = _tile(left, right, width)
        out: dict[str, list] = {"arid": [], "p": [], "vec_id": [], "score": []}
        for k, arid in enumerate(anchors):
            windows = [(-(-low * p // 100), high * p // 100) for p in bounds[k]]  # whole scores: least and greatest
            windows = [(p, a, b) for p, (a, b) in enumerate(windows) if a <= b]
            if not windows:
                continue
            s = scores[k]
            at = np.flatnonzero((s >= min(a for _, a, _ in windows)) & (s <= max(b for _, _, b in windows)) & (labels != own[k]))
            at = at[np.lexsort((ids[at], -s[at]))]
            falling = -s[at]
            for p, a, b in windows:
                begin, end = np.searchsorted(falling, -b, "left"), np.searchsorted(falling, -a, "right")
                best = at[begin : min(end, begin + most)]
                out["arid"].append(np.full(len(best), arid))
                out["p"].append(np.full(len(best), p))
                out["vec_id"].append(ids[best])
                out["score"].append(s[best])
        return _table(NEGATIVE, out)

    return reduce


def _counted(rows: DataFrame, size: int) -> list[int]:
    """How many shards of about size rows each group of labels gets."""
    n = {r["g"]: r["count"] for r in rows.groupBy("g").count().collect()}  # at most GROUPS rows
    return [-(-n.get(g, 0) // size) for g in range(GROUPS)]


def _dealt(rows: DataFrame, shards: list[int]) -> DataFrame:
    """rows with shard: the group's first shard plus a hash of the row's number."""
    starts = np.cumsum([0, *shards[:-1]]).tolist()
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), F.col("g") + 1)
    return rows.withColumn("shard", (pick(starts) + F.pmod(F.xxhash64("rid"), pick(shards).cast("bigint"))).cast("int"))


def _within(shards: list[int]) -> Column:
    """The shards of the own group; null where there is none."""
    starts = np.cumsum([0, *shards[:-1]]).tolist()
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), F.col("g") + 1)
    return F.when(pick(shards) > 0, F.sequence(pick(starts), pick(starts) + pick(shards) - 1))


def _tiles(anchors: DataFrame, rows: DataFrame, of_anchor: Column, of_row: Column, best: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """The best of every tile: anchor blocks go to the row shards of_anchor, row blocks to the anchor shards of_row."""
    a = anchors.select(F.col("shard").alias("i"), F.explode(of_anchor).alias("j"), "rid", "label", "bounds", "q")
    # names of their own: anchors are among the rows, and a cogroup would take their columns for the same
    b = rows.select(F.col("shard").alias("j"), F.explode(of_row).alias("i"), F.col("rid").alias("b_rid"), F.col("vec_id").alias("b_id"), F.col("label").alias("b_label"), F.col("q").alias("b_q"))
    return a.groupBy("i", "j").cogroup(b.groupBy("i", "j")).applyInArrow(best, schema)


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, chunk: int = CHUNK, anchor_rows: int = ANCHORS, block_rows: int = ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score: for each anchor and each of its first ``positives`` rows of the same
    label, the first ``negatives`` rows of other labels whose score s satisfies low * p <= 100 * s <= high * p, p being the positive's score.

    vectors: vec_id, embedding, label; other columns are ignored. is_anchor: a condition on vec_id and label. A score is the inner product with the
    anchor of the components floor(256 * x); higher scores come first, then smaller vec_ids. Rows with a null vec_id, label or vector or with a null or
    non-finite component take no part. Of vectors of different length the missing components count as 0; an empty one scores 0. Each row of a repeated
    vec_id is a row of its own: it can be the other's positive, and an anchor each. Anchors without a positive, and positives without a row in their
    window, give no row; so does an empty table. Scores must fit 63 bits.
    """
    rows = written(quantised(vectors).withColumn("g", F.pmod(F.hash("label"), F.lit(GROUPS))), "vectors")
    longest = rows.agg(F.max(F.size("q"))).first()[0] or 0
    block_rows, anchor_rows = (max(1, n * COMPONENTS // max(longest, COMPONENTS)) for n in (block_rows, anchor_rows))  # longer vectors: smaller blocks
    chosen = rows.where(is_anchor)
    row_shards, anchor_shards = _counted(rows, block_rows), _counted(chosen, anchor_rows)
    empty = rows.sparkSession.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    if not sum(anchor_shards):
        return empty
    every, anchors = _dealt(rows, row_shards), _dealt(chosen, anchor_shards)
    none = F.array().cast("array<bigint>")
    found = _tiles(anchors.withColumn("bounds", none), every, _within(row_shards), _within(anchor_shards), _best_positives(chunk, positives), POSITIVE)
    ranked = lambda df, n, *key: df.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= n)
    best = written(ranked(found, positives, "arid"), "positives")
    windows = best.groupBy("arid").agg(F.array_sort(F.collect_list(F.struct("rank", "score")))["score"].alias("bounds"))  # at most ``positives`` rows each
    opened = anchors.join(windows, anchors["rid"] == windows["arid"]).drop("arid")
    everywhere = lambda shards: F.sequence(F.lit(0), F.lit(sum(shards) - 1))
    second = _tiles(opened, every, everywhere(row_shards), everywhere(anchor_shards), _best_negatives(chunk, negatives, low, high), NEGATIVE)
    hits = ranked(second, negatives, "arid", "p")
    named = chosen.select(F.col("rid").alias("arid"), F.col("vec_id").alias("anchor_id"))
    of = best.select("arid", (F.col("rank") - 1).alias("p"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    joined = hits.select("arid", "p", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")).join(of, ["arid", "p"]).join(named, "arid")
    out = written(joined.select(*empty.columns), "hard-negatives")
    dropped(rows)
    dropped(best)
    return out
