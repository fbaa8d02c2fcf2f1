"""Exact-substring dedup over sorted suffixes: front-coded runs, merged by loser trees that know common prefixes.

Every string of ``SPAN`` bytes has an anchor: the leftmost least hash among its ``GRAM``-byte substrings. Equal strings have equal
anchors at equal offsets, so it is enough to sort the suffixes that start at anchors, about one byte in forty, and of these only
the ones whose ``GRAM`` bytes occur more than once anywhere.

1. Anchors of all texts: their hashes meet by hash bucket, and the repeated ones go back to their documents.
2. Each task sorts the suffixes at its repeated anchors and sends front-coded runs to the range that their first bytes fall in.
   Of suffixes with equal surroundings a run holds the earliest; the others are repeats already.
3. Each range merges its runs by a loser tree whose nodes keep the length of the prefix they share with the last output: only
   on equal lengths are bytes compared, from that length on. The merge yields the suffix order with its prefix lengths.
4. Within the order, suffixes that share ``SPAN - o`` bytes, and the ``o`` bytes left of their anchors, hold the same string at offset
   o; all but the earliest of them start a repeat.
5. The spans meet by document and are cut out of its text.
"""

from __future__ import annotations

import hashlib
import pickle
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import dropped, written
from .textblocks import U64, blocks, mixed

#: Bytes of a repeated string and of the substring whose hash makes an anchor.
SPAN, GRAM = 100, 24
WIDTH = SPAN - GRAM + 1
#: Anchors that are held before a task sends a run, and documents whose anchors give the splitters of the ranges.
HELD, SAMPLE = 120_000, 2000
#: Bytes of text for each range of suffixes, at most.
RANGE_BYTES = 32 << 20
FIRST = -(1 << 63)


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(1 << 16, 1 << (n - 1).bit_length() if n else 1)
    if size not in _powers:
        _powers.clear()
        ups, downs = np.full(size, _BASE, U64), np.full(size, _INVERSE, U64)
        ups[0] = downs[0] = 1
        _powers[size] = np.cumprod(ups), np.cumprod(downs)
    return _powers[size]


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of each GRAM bytes, from running sums of powers. They choose anchors and pass on which may repeat: a collision costs
    a comparison of bytes and never a result."""
    ups, downs = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * ups[: len(data)], out=sums[1:])
    return mixed((sums[GRAM:] - sums[:-GRAM]) * downs[: len(data) - GRAM + 1])


def anchors(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Position and hash of each anchor of a block, and the first and last start of the strings that it is the anchor of."""
    size = np.maximum(np.diff(offs) - SPAN + 1, 0)
    none = np.zeros(0, np.int64)
    if not size.sum():
        return none, none.astype(U64), none, none
    grams = gram_hashes(data)
    bits = U64(32)  # the same in every block, so that equal strings have equal anchors: by half the hash, then by place
    keys = (grams >> bits) << bits | np.arange(len(grams), dtype=U64)
    rows = -(-len(keys) // WIDTH)
    padded = np.full(rows * WIDTH, np.iinfo(np.uint64).max, U64)
    padded[: len(keys)] = keys
    table = padded.reshape(rows, WIDTH)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    start = np.repeat(offs[:-1] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    least = (np.minimum(behind[start], ahead[start + WIDTH - 1]) & ((U64(1) << bits) - U64(1))).astype(np.int64)
    first = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    at = least[first]
    return at, grams[at], start[first], start[np.r_[first[1:], len(start)] - 1]


def _packed(x) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(x, 5))


def _unpacked(b: bytes):
    return pickle.loads(zstandard.ZstdDecompressor().decompress(b))


def _print_runs(buckets: int):
    """Step 1, by task: distinct hashes of anchors with their first place, and the places of those that repeat in the task."""

    def send(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        h, d, sub, at = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(h, kind="stable")
        h, d, sub, at = h[order], d[order], sub[order], at[order]
        new = np.r_[True, h[1:] != h[:-1]]
        multi = np.r_[~new[1:], False]
        rows = []
        bucket = (h % U64(buckets)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[by], np.arange(buckets + 1))
        for b in range(buckets):
            i = by[cuts[b] : cuts[b + 1]]
            if len(i):
                a, r = i[new[i]], i[~new[i]]
                rows.append((b, _packed((h[a], multi[a], d[a], sub[a], at[a].astype(np.int32), d[r], sub[r], at[r].astype(np.int32)))))
        return pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], ["part", "run"])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for part, data, offs in blocks(batches):
            at, h, _, _ = anchors(data, offs)
            doc = np.searchsorted(offs, at, side="right") - 1
            held.append((h, part.column(0).to_numpy()[doc], part.column(1).to_numpy()[doc], at - offs[doc]))
            n += len(at)
            if n > 8 * HELD:
                yield send(held)
                held, n = [], 0
        if n:
            yield send(held)

    return runs


PLACES = "d bigint, sub bigint, at int"


def _repeated_prints(group: pa.Table) -> pa.Table:
    """Step 1, by bucket: the places of anchors whose hash occurs more than once."""
    parts = [_unpacked(x.as_py()) for x in group.column("run")]
    h, multi, d, sub, at = (np.concatenate([p[k] for p in parts]) for k in range(5))
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    often = multi.copy()
    often[order[1:][same]] = True
    often[order[:-1][same]] = True
    return pa.table({k: pa.array(np.concatenate([x[often], *(p[5 + j] for p in parts)])) for j, (k, x) in enumerate((("d", d), ("sub", sub), ("at", at)))})


def front_coded(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Of sorted strings: length of the prefix shared with the one before, length of the rest, all rests."""
    shared, rest, before = [], [], b""
    for s in strings:
        n = shared_from(before, s, 0)
        shared.append(n)
        rest.append(s[n:])
        before = s
    return np.array(shared, np.int32), np.array([len(x) for x in rest], np.int32), b"".join(rest)


def decoded(shared: np.ndarray, sizes: np.ndarray, rests: bytes) -> list[bytes]:
    out, before, at = [], b"", 0
    for n, size in zip(shared.tolist(), sizes.tolist(), strict=True):
        before = before[:n] + rests[at : at + size]
        out.append(before)
        at += size
    return out


def shared_from(a: bytes, b: bytes, h: int) -> int:
    """The length of the common prefix of a and b, of which h bytes are known."""
    n = min(len(a), len(b))
    if a[h:n] == b[h:n]:
        return n
    while a[h : h + 12] == b[h : h + 12]:
        h += 12
    while a[h] == b[h]:
        h += 1
    return h


def merge_runs(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[int], list[int], list[int]]:
    """Merges sorted runs, each with its strings and the prefix that each shares with the one before.

    Returns run, index and shared prefix with the string before, in order. A node of the loser tree holds a run whose
    head shares ``known[run]`` bytes with the last output; the longer prefix is the smaller string, bytes are
    looked at on equal prefixes only, and from there on.
    """
    size = 1
    while size < len(runs):
        size *= 2
    heads: list[bytes | None] = [r[0][0] if r[0] else None for r in runs] + [None] * (size - len(runs))
    known, place, loser = [0] * size, [0] * size, [0] * size
    winners = [*range(size)]
    base = size
    while base > 1:  # the first round, level by level
        base //= 2
        up = []
        for k in range(base):
            a, b = winners[2 * k], winners[2 * k + 1]
            x, y = heads[a], heads[b]
            if y is not None and (x is None or known[b] > known[a]):
                a, b = b, a
            elif x is not None and y is not None and known[a] == known[b]:
                n = shared_from(x, y, known[a])
                if n < len(y) and n < len(x) and y[n] < x[n] or n == len(y) < len(x):
                    a, b = b, a
                known[b] = n
            loser[base + k] = b
            up.append(a)
        winners = up
    best = winners[0]
    out_run, out_index, out_known = [], [], []
    while heads[best] is not None:
        i = place[best]
        out_run.append(best)
        out_index.append(i)
        out_known.append(known[best])
        strings, lengths = runs[best]
        i += 1
        if i < len(strings):
            place[best], heads[best], known[best] = i, strings[i], lengths[i]
        else:
            heads[best] = None
        node = (best + size) >> 1
        while node:
            other = loser[node]
            y = heads[other]
            if y is not None:
                x = heads[best]
                if x is None or known[other] > known[best]:
                    loser[node], best = best, other
                elif known[other] == known[best]:
                    n = shared_from(x, y, known[best])
                    if (y[n] < x[n]) if n < len(y) and n < len(x) else n == len(y) < len(x):
                        loser[node], best = best, other
                        known[loser[node]] = n
                    else:
                        known[other] = n
            node >>= 1
    return out_run, out_index, out_known


def _suffix_runs(splitters: list[bytes]):
    """Step 2: sorted, front-coded runs of the suffixes at repeated anchors, by range of their first GRAM bytes."""

    def send(held: list[tuple]) -> pa.RecordBatch:
        held.sort()  # by right side, left side, document, place
        rows: dict[int, tuple[list, list]] = {}
        last = None
        for x in held:
            part = bisect_right(splitters, x[0][:GRAM])
            kept, repeats = rows.setdefault(part, ([], []))
            if last is not None and x[0] == last[0] and x[1] == last[1]:
                repeats.append(x[2:])
            else:
                kept.append(x)
                last = x
        out = []
        for part, (kept, repeats) in rows.items():
            left = [x[1] for x in kept]
            places = np.array([x[2:] for x in kept], np.int64)
            spans = np.array([(d, sub, at - lo, at + hi + SPAN) for d, sub, at, lo, hi in repeats], np.int64).reshape(-1, 4)
            out.append((part, _packed((front_coded([x[0] for x in kept]), np.array([len(x) for x in left], np.int32), b"".join(left), places, spans))))
        return pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], ["part", "run"])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for part, data, offs in blocks(batches):
            wanted = part.column(part.schema.get_field_index("places"))
            places = np.concatenate([np.asarray(x.values).astype(np.int64) + o for x, o in zip(wanted, offs, strict=False)])
            at, _, lo, hi = anchors(data, offs)
            pick = np.isin(at, places)
            at, lo, hi = at[pick], lo[pick], hi[pick]
            doc = np.searchsorted(offs, at, side="right") - 1
            raw, d, sub = data.tobytes(), part.column(0).to_numpy()[doc].tolist(), part.column(1).to_numpy()[doc].tolist()
            begin = (at - offs[doc]).tolist()
            for a, x, y, i, j, b in zip(at.tolist(), lo.tolist(), hi.tolist(), d, sub, begin, strict=True):
                held.append((raw[a : y + SPAN], raw[x:a], i, j, b, a - x, y - a))
                if len(held) >= HELD:
                    yield send(held)
                    held = []
        if held:
            yield send(held)

    return runs


SPANS = "d bigint, sub bigint, s int, e int"


def _repeats(group: pa.Table) -> pa.Table:
    """Steps 3 and 4: merges the runs of a range and finds the repeated strings."""
    parts = [_unpacked(x.as_py()) for x in group.column("run")]
    rights = [(decoded(*p[0]), p[0][0].tolist()) for p in parts]
    run, index, known = merge_runs(rights)
    begin = np.cumsum([0] + [len(r[0]) for r in rights])
    order = begin[np.array(run, np.int64)] + np.array(index, np.int64)
    d, sub, at, before, after = np.concatenate([p[3] for p in parts]).reshape(-1, 5)[order].T
    sizes = np.concatenate([p[1] for p in parts])
    ends = np.cumsum(sizes)[order]
    left = np.frombuffer(b"".join(p[2] for p in parts), np.uint8)
    low, high = repeated_offsets(np.array(known, np.int64), left, ends, -after, before, np.lexsort((at, sub, d)))
    hit = np.flatnonzero(high >= 0)
    direct = np.concatenate([p[4] for p in parts])
    found = np.column_stack([d[hit], sub[hit], at[hit] - high[hit], at[hit] - low[hit] + SPAN])
    whole = np.concatenate([found, direct])
    whole = whole[np.lexsort((whole[:, 2], whole[:, 1], whole[:, 0]))]
    return pa.table({"d": pa.array(whole[:, 0]), "sub": pa.array(whole[:, 1]), "s": pa.array(whole[:, 2].astype(np.int32)), "e": pa.array(whole[:, 3].astype(np.int32))})


def repeated_offsets(known: np.ndarray, left: np.ndarray, ends: np.ndarray, least: np.ndarray, most: np.ndarray, by_place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lowest and highest offset at which each suffix's string repeats an earlier one; -1 where none does.

    known: prefix shared with the suffix before, in suffix order. left: bytes left of the anchors, a suffix's ending at ends. least
    and most: the offsets at which the suffix's anchor is a string's. by_place: the suffixes from the earliest on.
    """
    n = len(known)
    low, high = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    hashes = np.zeros(n, U64)
    following = np.r_[known[1:], -1]
    for o in range(int(most.max(initial=-1)) + 1):
        if o:
            longer = np.flatnonzero(most >= o)
            h = (hashes[longer] + left[ends[longer] - o].astype(U64) + U64(1)) * U64(0x9E3779B97F4A7C15)
            hashes[longer] = h ^ (h >> U64(29))  # not linear in the bytes
        share = SPAN - o
        live = (least <= o) & (o <= most) & ((known >= share) | (following >= share))
        i = by_place[live[by_place]]
        if not len(i):
            continue
        block = np.cumsum(known < share)
        key = mixed(mixed(hashes[i]) + block[i].astype(U64))
        _, first = np.unique(key, return_index=True)
        later = np.ones(len(i), bool)
        later[first] = False
        i = i[later]
        low[i] = np.where(low[i] < 0, o, low[i])
        high[i] = o
    return low, high


OUT = "d bigint, sub bigint, n_bytes bigint, spans array<struct<s:int,e:int>>, kept binary"


def _cut(whole: bool):
    """Step 5: merges a document's spans and gives the bytes that stay, or only their digest."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offs in blocks(batches):
            raw, lists = data.tobytes(), part.column(part.schema.get_field_index("spans"))
            spans, kept = [], []
            for x, a, b in zip(lists, offs[:-1].tolist(), offs[1:].tolist(), strict=True):
                merged: list[list[int]] = []
                text = raw[a:b]
                if x.is_valid:
                    both = np.asarray(x.values.flatten()[0]), np.asarray(x.values.flatten()[1])
                    order = np.argsort(both[0], kind="stable")
                    for s, e in zip(both[0][order].tolist(), both[1][order].tolist(), strict=True):
                        if merged and s <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], e)
                        else:
                            merged.append([s, e])
                    edge = [0, *(v for m in merged for v in m), len(text)]
                    text = b"".join(text[edge[k] : edge[k + 1]] for k in range(0, len(edge), 2))
                spans.append([{"s": s, "e": e} for s, e in merged])
                kept.append(text if whole else hashlib.sha256(text).hexdigest().encode())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(np.diff(offs)), pa.array(spans, pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))), pa.array(kept, pa.binary())],
                ["d", "sub", "n_bytes", "spans", "kept"],
            )

    return cut


def substring_dedup(docs: DataFrame, digest: bool = False) -> DataFrame:
    """Removes every byte that a 100-byte string covers which also starts earlier: in a smaller doc_id, or before in the same text.

    docs: doc_id (integer), text; other columns are ignored. Texts are UTF-8 bytes, matches never cross documents, overlapping
    ones count, and all are judged on the input. Returns a row for each row of docs: doc_id, n_bytes, spans (array of s, e: the
    maximal removed runs, ascending, e exclusive) and kept, the bytes that stay (with digest, their lower-case hex sha256). A null
    or empty text has no bytes. A null doc_id comes before all others. Rows that share a doc_id stand in the order of a
    hash of their texts; those that share the text too are one document and get one result each.
    """
    spark = docs.sparkSession
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST)).alias("d"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    repeats = bool(own.groupBy("d").count().where("count > 1").limit(1).count())
    own = own.select("d", (F.xxhash64("text") if repeats else F.lit(0)).cast("long").alias("sub"), "text")
    each = own.dropDuplicates(["d", "sub"]) if repeats else own
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(64, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    prints = each.mapInArrow(_print_runs(parts), "part int, run binary").groupBy("part").applyInArrow(_repeated_prints, PLACES)
    places = written(prints.groupBy("d", "sub").agg(F.collect_list("at").alias("places")), "places")
    chosen = each.join(places.hint("shuffle_hash"), ["d", "sub"])
    runs = chosen.mapInArrow(_suffix_runs(_splitters(each, parts)), "part int, run binary")
    spans = runs.groupBy("part").applyInArrow(_repeats, SPANS)
    spans = written(spans.groupBy("d", "sub").agg(F.collect_list(F.struct("s", "e")).alias("spans")), "spans")
    dropped(places)
    cut = own.join(spans.hint("shuffle_hash"), ["d", "sub"], "left").mapInArrow(_cut(not digest), OUT)
    return cut.select(F.when(F.col("d") == FIRST, None).otherwise(F.col("d")).alias("doc_id"), "n_bytes", "spans", F.col("kept").cast("string").alias("kept") if digest else "kept")


def _splitters(docs: DataFrame, parts: int) -> list[bytes]:
    """First bytes that part the anchors of at most SAMPLE documents, or two for each part, evenly; they decide on balance, never on results."""

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, offs in blocks(batches):
            raw = data.tobytes()
            at = anchors(data, offs)[0][::7].tolist()
            yield pa.RecordBatch.from_arrays([pa.array([raw[a : a + GRAM] for a in at], pa.binary())], ["g"])

    few = docs.where(F.length("text") >= SPAN).select("text").limit(max(SAMPLE, 2 * parts))
    found = sorted({bytes(r["g"]) for r in few.mapInArrow(grams, "g binary").toLocalIterator()})
    return [found[len(found) * k // parts] for k in range(1, parts)] if len(found) > parts else []
