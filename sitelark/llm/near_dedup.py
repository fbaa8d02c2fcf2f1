"""Near-duplicate documents by HyperMinHash.

1. One pass over the texts gives each document its set size, a 128-bit digest of the set and ``REGISTERS`` HyperMinHash
   registers of 16 bits: the leading-zero count and ``MANTISSA`` bits of the least hash in each bucket.
2. Equal sets are collapsed to a representative before anything is compared, so copies cost nothing later.
3. ``BANDS`` bands of compressed registers (empty ones borrow from another bucket) give candidates. Within a band's
   bucket every member is tried with the bucket's smallest member only, not with all others.
4. The collision-corrected Jaccard estimate of the registers drops candidates that are far below the threshold; the rest
   are confirmed on the full shingle sets.
5. In buckets whose members are still in different components these are compared by their full sets, in blocks of bounded size. A
   block gives one link for each two components it joins, not all pairs: no connection is lost to the star of step 3.
6. Components by large-star and small-star steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import connected_components
from .shared import dropped, written
from .textblocks import LOWERED, NOT_SPACE, U64, blocks, mixed, shingle_hashes, word_hashes, words

#: Buckets of a sketch, and bands of BAND registers: at a similarity of 0.8 a pair shares no band with probability 5e-8.
REGISTERS, BAND = 128, 4
BANDS = REGISTERS // BAND
#: Bits of a register's mantissa, and the constant of the published estimate of accidental collisions.
MANTISSA = 10
COLLISION = 0.169919487159739093975315012348
EMPTY = 0xFFFF
#: A candidate is dropped unread if its estimate is this far below the threshold: about six standard deviations.
SLACK = 0.25
#: Members of a bucket in one comparison block, members of a hub in one confirmation group.
CHUNK, FAN = 1024, 200
#: Rows of (document, group) up to which they are sent to all executors rather than shuffled with the texts.
SEND_ROWS = 200_000

_TRIES = np.random.default_rng(7).integers(0, REGISTERS, (REGISTERS, 256))


def shingle_sets(part_rows: int, data: np.ndarray, offs: np.ndarray, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text with fewer than k words is one shingle, none without words."""
    low = LOWERED[data]
    s, e, doc = words(low, offs, NOT_SPACE)
    h = word_hashes(low, s, e)
    grams, at = shingle_hashes(h, doc, k)
    begins = np.searchsorted(doc, np.arange(part_rows + 1))
    cuts = np.searchsorted(doc[at], np.arange(part_rows + 1)) if len(at) else np.zeros(part_rows + 1, np.int64)
    out = []
    for d in range(part_rows):
        n = begins[d + 1] - begins[d]
        if n >= k:
            x = np.sort(grams[cuts[d] : cuts[d + 1]])
            out.append(x[np.r_[True, x[1:] != x[:-1]]])
        elif n:
            out.append(shingle_hashes(h[begins[d] : begins[d + 1]], doc[begins[d] : begins[d + 1]], int(n))[0])
        else:
            out.append(np.zeros(0, U64))
    return out


def registers(hashes: np.ndarray) -> np.ndarray:
    """Of sorted distinct hashes: top 7 bits choose the bucket, the rest gives leading zeros and mantissa of the least."""
    out = np.full(REGISTERS, EMPTY, np.uint16)
    if not len(hashes):
        return out
    bucket = (hashes >> U64(57)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    low = ((hashes[first] & U64((1 << 57) - 1)) >> U64(4)).astype(np.float64)  # 53 bits: exact
    bits = low.view(U64)
    zeros = np.where(low > 0, 52 - ((bits >> U64(52)).astype(np.int64) - 1023), 53)
    out[bucket[first]] = ((zeros << MANTISSA) | ((bits >> U64(52 - MANTISSA)) & U64((1 << MANTISSA) - 1)).astype(np.int64)).astype(np.uint16)
    return out


def band_keys(regs: np.ndarray) -> np.ndarray:
    """A key for each band; an empty register borrows from the first filled one in a fixed sequence of its own."""
    empty = np.flatnonzero(regs == EMPTY)
    if len(empty) == REGISTERS:
        return np.zeros(0, U64)
    full = regs
    if len(empty):
        full = regs.copy()
        filled = regs != EMPTY
        tries = filled[_TRIES[empty]]
        source = _TRIES[empty, np.argmax(tries, axis=1)]
        source[~tries.any(axis=1)] = int(np.argmin(regs))
        full[empty] = regs[source]
    rows = full.reshape(BANDS, BAND).astype(U64)
    key = np.arange(1, BANDS + 1, dtype=U64)
    for j in range(BAND):
        key = key * U64(1 << 16 | 1) + rows[:, j]
        key = mixed(key)
    return key


def estimates(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Collision-corrected Jaccard estimates of registers a and b (last axis), set sizes n_a and n_b."""
    both = (a != EMPTY) & (b != EMPTY)
    either = np.maximum(((a != EMPTY) | (b != EMPTY)).sum(-1), 1)
    alike = ((a == b) & both).sum(-1)
    ratio = np.maximum(n_a, n_b) / np.maximum(np.minimum(n_a, n_b), 1)
    expected = COLLISION * REGISTERS / (1 << MANTISSA) * 4 * ratio / (1 + ratio) ** 2
    return np.maximum(alike - expected, 0) / either


SKETCH = "doc_id bigint, n bigint, d1 bigint, d2 bigint, regs binary"


def _sketch(k: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offs in blocks(batches):
            sets = shingle_sets(part.num_rows, data, offs, k)
            sums = np.array([[len(s), s.sum(dtype=U64), mixed(s + U64(0x51ED270B)).sum(dtype=U64)] for s in sets], U64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(sums[:, 0].view(np.int64)), pa.array(sums[:, 1].view(np.int64)), pa.array(sums[:, 2].view(np.int64)), pa.array([registers(s).tobytes() for s in sets], pa.binary())],
                ["doc_id", "n", "d1", "d2", "regs"],
            )

    return sketch


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [band_keys(np.frombuffer(r.as_py(), np.uint16)) for r in batch.column("regs")]
        times = np.array([len(x) for x in keys], np.int64)
        if times.sum():
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.repeat(batch.column("rep").to_numpy(), times))], ["key", "rep"])


def _close(threshold: float):
    """Keeps the pairs whose estimate and set sizes allow the threshold."""

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
            ra, rb = (np.frombuffer(b"".join(x.as_py() for x in batch.column(c)), np.uint16).reshape(-1, REGISTERS) for c in ("ra", "rb"))
            keep = (np.minimum(na, nb) >= threshold * np.maximum(na, nb)) & (estimates(ra, rb, na, nb) >= threshold - SLACK)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(keep)), batch.column("b").filter(pa.array(keep))], ["a", "b"])

    return close


def _full_sets(k: int):
    """Each text's shingle set."""

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offs in blocks(batches):
            sets = shingle_sets(part.num_rows, data, offs, k)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.tobytes() for x in sets], pa.binary())], ["rep", "full"])

    return full


def _across(percent: int):
    """Within a block of a bucket: a link for each two components that some pair of their members joins.

    Full sets are compared, so each link found is a confirmed one. Members of the block's largest component need not be tried with each other, nor members of any one component.
    """

    def across(group: pa.Table) -> pa.Table:
        rep, comp, side = (group.column(c).to_numpy() for c in ("rep", "comp", "side"))
        comp = np.unique(comp, return_inverse=True)[1]
        lists = [np.frombuffer(x.as_py(), U64) for x in group.column("full")]
        size = np.array([len(x) for x in lists])
        token, owner = np.unique(np.concatenate(lists), return_inverse=True)[1], np.repeat(np.arange(len(rep)), size)
        order = np.argsort(token, kind="stable")
        cuts = np.r_[0, np.cumsum(np.bincount(token))]
        owner = owner[order]
        begin = np.cumsum(size) - size
        if (side != 0).any():
            tried, against = np.flatnonzero(side < 0), side > 0
        else:
            tried, against = np.flatnonzero(comp != np.argmax(np.bincount(comp))), np.ones(len(rep), bool)
        a, b = [], []
        for i in tried:
            own = token[begin[i] : begin[i] + size[i]]
            shared = cuts[own + 1] - cuts[own] > 1
            own = own[shared]
            length = cuts[own + 1] - cuts[own]
            flat = np.repeat(cuts[own] - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
            both = np.bincount(owner[flat], minlength=len(rep))
            hits = np.flatnonzero(against & (comp != comp[i]) & (100 * both >= percent * (size + size[i] - both)))
            for j in hits:
                if comp[j] != comp[i]:
                    a.append(min(rep[i], rep[j]))
                    b.append(max(rep[i], rep[j]))
                    comp[comp == comp[j]] = comp[i]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return across


def _confirm(k: int, percent: int):
    """Rows sorted by (hub, part, role): a hub's text comes before the texts that are compared with it."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, hub_set = None, np.zeros(0, U64)
        for part, data, offs in blocks(batches):
            sets = shingle_sets(part.num_rows, data, offs, k)
            a, b = [], []
            hubs, salts, roles, docs = (part.column(c).to_pylist() for c in ("hub", "salt", "role", "doc_id"))
            for i, s in enumerate(sets):
                if roles[i] == 0:
                    hub, hub_set = (hubs[i], salts[i]), s
                elif hub == (hubs[i], salts[i]):
                    both = np.concatenate([hub_set, s])
                    both.sort()
                    inside = int((both[1:] == both[:-1]).sum())
                    if 100 * inside >= percent * (len(both) - inside):
                        a.append(hubs[i])
                        b.append(docs[i])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return confirm


def _sent_if_small(df: DataFrame) -> DataFrame:
    """Rows of ids, computed once: sent to all executors up to SEND_ROWS of them, else shuffled, as the smaller side of a hash join."""
    df = written(df, "ids")
    return F.broadcast(df) if df.count() <= SEND_ROWS else df.hint("shuffle_hash")


def _confirmed(texts: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) that meet the threshold on full sets. A hub a with many partners is split by partner."""
    degree = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("degree"))
    salted = pairs.join(degree, "a").select("a", "b", F.when(F.col("degree") > FAN, F.pmod(F.xxhash64("b"), F.ceil(F.col("degree") / FAN))).otherwise(0).cast("long").alias("salt"))
    roles = salted.select(F.col("b").alias("doc_id"), F.col("a").alias("hub"), "salt", F.lit(1).alias("role")).unionByName(
        salted.select("a", "salt").distinct().select(F.col("a").alias("doc_id"), F.col("a").alias("hub"), "salt", F.lit(0).alias("role"))
    )
    met = texts.join(_sent_if_small(roles), "doc_id").repartition("hub", "salt").sortWithinPartitions("hub", "salt", "role")
    return met.select("doc_id", "hub", "salt", "role", "text").mapInArrow(_confirm(k, percent), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, percent: int = 80, k: int = 5) -> DataFrame:
    """Links documents whose sets of k-word shingles have 100 * intersection >= percent * union, and their components.

    docs: doc_id (integer), text; other columns are ignored. Words are ``[^\\x20\\x09-\\x0D]+`` with
    A-Z in lower case; a text of fewer than k words is one shingle; a null, empty or blank text has an empty set
    and is linked with nothing. Returns a row for each row of docs: doc_id, n_shingles, component_id (the smallest doc_id that
    links reach) and kept (doc_id is the component's). Rows with a null doc_id are linked with nothing, get a null component and
    are kept. Rows that share a doc_id are one document, with the least of their texts, and share its result. No rows in, no rows out.
    """
    threshold = percent / 100
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    known, unknown = own.where("doc_id is not null"), own.where("doc_id is null")
    if known.groupBy("doc_id").count().where("count > 1").limit(1).count():
        one = written(known.groupBy("doc_id").agg(F.min("text").alias("text")).unionByName(unknown), "documents")
        decided = near_duplicates(one, percent, k)
        return decided.where("doc_id is null").unionByName(known.select("doc_id").join(decided, "doc_id"))
    sketches = written(own.mapInArrow(_sketch(k), SKETCH), "sketches")
    live = sketches.where("n > 0 and doc_id is not null")
    sets = written(live.groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep"), F.min_by("regs", "doc_id").alias("regs")), "sets")
    bands = written(sets.select("rep", "regs").mapInArrow(_bands, "key bigint, rep bigint"), "bands")
    stars = bands.groupBy("key").agg(F.min("rep").alias("a"), F.max("rep").alias("last")).where("a <> last").select("key", "a")
    members = written(bands.join(stars, "key"), "members")  # key, rep, a: buckets of two and more
    texts = known
    first = members.select("a", F.col("rep").alias("b")).where("a <> b").distinct()
    r = sets.select("rep", "n", "regs")
    first = (
        first.join(r.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("regs").alias("ra")), "a")
        .join(r.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("regs").alias("rb")), "b")
        .mapInArrow(_close(threshold), "a bigint, b bigint")
    )
    pairs = written(first, "pairs")
    links = written(_confirmed(texts, pairs, k, percent), "links")
    comps = connected_components(links)
    placed = members.join(comps, members["rep"] == comps["node"], "left").select("key", "rep", F.coalesce("component", "rep").alias("comp"))
    split = placed.groupBy("key").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2"), F.count(F.lit(1)).alias("size")).where("c1 <> c2").select("key", "size")
    rest = placed.join(split, "key").withColumn("parts", F.ceil(F.col("size") / CHUNK).cast("int"))
    left = rest = written(rest.withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")), "rest")
    open_ = rest.select(F.col("rep").alias("doc_id")).distinct()
    full = texts.join(_sent_if_small(open_), "doc_id", "left_semi").select("doc_id", "text").mapInArrow(_full_sets(k), "rep bigint, full binary")
    # in a bucket of several parts, a member meets its own part and each other part: block (i, j) with i <= j
    block = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(F.least(F.col("part"), j).alias("i"), F.greatest(F.col("part"), j).alias("j"), F.when(F.col("part") < j, -1).when(F.col("part") > j, 1).otherwise(0).alias("side")))
    rest = rest.withColumn("at", F.explode(block)).select("key", "at.i", "at.j", "at.side", "rep", "comp").join(full, "rep")
    more = written(rest.groupBy("key", "i", "j").applyInArrow(_across(percent), "a bigint, b bigint").distinct(), "links")
    if more.count():
        comps = connected_components(links.unionByName(more))
    for done in (bands, members, pairs, left, links, more):
        dropped(done)
    by_set = sets.join(comps, sets["rep"] == comps["node"], "left").select("n", "d1", "d2", F.coalesce("component", "rep").alias("component"))
    whole = sketches.alias("s").join(by_set.alias("c"), ["n", "d1", "d2"], "left")
    component = F.when(F.col("doc_id").isNull(), None).when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component"))
    return whole.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))

