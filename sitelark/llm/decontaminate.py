"""Benchmark decontamination by winnowing.

From each side the minimum k-gram hash of every window of ``WINDOW`` consecutive k-grams is kept. Two spans of
``K + WINDOW - 1`` words that are alike keep at least one fingerprint alike, so a join of fingerprints misses no shared
span of that length; each hit is then extended on exact word hashes and the full item windows that lie in it
are confirmed. Items that are shorter than a window are fingerprinted whole, by their own length.

Up to ``BLOCK_WORDS`` item words (counted by Spark before anything is sent) the items' fingerprints go to the executors and nothing of a
document is shuffled. Beyond that, items and documents meet in shuffled joins: documents are read and cut into words once, a bitmap
of fixed size holds back most fingerprints that no item has, the others are joined with those of the items, and so are the windows
around them. Both ways give the same rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import dropped, written
from .textblocks import ALNUM, LOWERED, U64, as_signed, blocks, shingle_hashes, word_hashes, words

#: Words of a benchmark window: what counts as contamination.
SPAN = 10
#: Words of a fingerprinted k-gram and k-grams of a winnowing window; K + WINDOW - 1 == SPAN.
K, WINDOW = 5, 6
#: Item words whose fingerprints are sent (about 40 bytes each), and bytes of a word at most, on average, in what is sent.
BLOCK_WORDS, WORD_BYTES = 500_000, 64
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # as it stands in the text, before A-Z are lower-cased
#: Bits of a hash that choose its bit of the bitmap (8 MB), and bits of a bucket of Spark's bitmap functions.
MAP_BITS, BUCKET = 26, 1 << 15


def winnowed(grams: np.ndarray, doc: np.ndarray, width: int) -> np.ndarray:
    """Indices of the k-grams that are the rightmost minimum of some window of width neighbours in one text.

    doc holds the text of each k-gram. A text with fewer k-grams than a window keeps its minimum.
    """
    n = len(grams)
    if not n:
        return np.zeros(0, np.int64)
    start = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    length = np.diff(np.r_[start, n])
    least, at = grams[: max(0, n - width + 1)].copy(), np.arange(max(0, n - width + 1))
    for j in range(1, width):
        later = grams[j : j + len(least)]
        better = later <= least
        least[better], at[better] = later[better], at[better] * 0 + np.flatnonzero(better) + j
    whole = doc[: len(at)] == doc[width - 1 : width - 1 + len(at)] if len(at) else np.zeros(0, bool)
    picked = np.zeros(n, bool)
    picked[at[whole]] = True
    for s, size in zip(start[length < width], length[length < width], strict=True):
        picked[s + size - 1 - int(np.argmin(grams[s : s + size][::-1]))] = True
    return np.flatnonzero(picked)


def fingerprints(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray, np.ndarray]]]:
    """Of a block of items: the winnowed k-grams of those of SPAN words or more, and the hashes of windows with the item of each,
    by length: SPAN, or the whole of a shorter item."""
    low = LOWERED[data]
    s, e, doc = words(low, offs, ALNUM)
    h = word_hashes(low, s, e)
    count = np.bincount(doc, minlength=len(offs) - 1)
    grams, at = shingle_hashes(h, doc, K)
    long_item = count[doc[at]] >= SPAN
    keep = winnowed(grams[long_item], doc[at][long_item], WINDOW)
    full, where = shingle_hashes(h, doc, SPAN)
    windows = [(SPAN, full, doc[where])]
    for n in np.unique(count[(count > 0) & (count < SPAN)]).tolist():
        short, at = shingle_hashes(h, doc, n)
        only = count[doc[at]] == n
        windows.append((n, short[only], doc[at][only]))
    return np.unique(grams[long_item][keep]), windows


class Items:
    """The fingerprints of a bounded number of items: of k-grams by winnowing, of windows for the confirmation, of short items."""

    def __init__(self, ids: list, texts: list[str | None]):
        self.ids = ids
        column = pa.array([t or "" for t in texts], pa.large_string())
        data, offs = next(((d, o) for _, d, o in blocks(iter([pa.RecordBatch.from_arrays([column], ["text"])]), most=1 << 62)), (np.zeros(0, np.uint8), np.zeros(1, np.int64)))
        self.prints, windows = fingerprints(data, offs)
        grouped = {n: self._grouped(h, items) for n, h, items in windows}
        self.windows, self.window_items = grouped.pop(SPAN)
        self.short = grouped

    @staticmethod
    def _grouped(keys: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        order = np.lexsort((items, keys))
        keys, items = keys[order], items[order]
        unique, first = np.unique(keys, return_index=True)
        return unique, [np.unique(x) for x in np.split(items, first[1:])] if len(unique) else []


def _found(keys: np.ndarray, probe: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of probe stand in the sorted keys, and where."""
    if not len(keys) or not len(probe):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place = np.minimum(np.searchsorted(keys, probe), len(keys) - 1)
    hit = np.flatnonzero(keys[place] == probe)
    return hit, place[hit]


def _around(first: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first words of the windows in one text that hold the k-grams at first, and which k-gram each window is of."""
    near = (first[:, None] + np.arange(-(SPAN - K), 1)).ravel()
    of = np.repeat(np.arange(len(first)), SPAN - K + 1)
    inside = (near >= 0) & (near + SPAN <= len(doc))
    near, of = near[inside], of[inside]
    same = doc[near] == doc[near + SPAN - 1]
    return near[same], of[same]


def _window_hashes(h: np.ndarray, near: np.ndarray) -> np.ndarray:
    parts = np.stack([h[near + j] for j in range(SPAN)], axis=1).ravel()
    return shingle_hashes(parts, np.repeat(np.arange(len(near)), SPAN), SPAN)[0]


def _occurrences(h: np.ndarray, doc: np.ndarray, items: Items) -> list[tuple[int, int, np.ndarray]]:
    """(first word, number of words, items) of each occurrence of a window in the block."""
    out: list[tuple[int, int, np.ndarray]] = []
    if len(items.prints):
        grams, at = shingle_hashes(h, doc, K)
        keep = winnowed(grams, doc[at], WINDOW)
        hit, _ = _found(items.prints, grams[keep])
        if len(hit):  # extend: all windows that hold a word run around a shared fingerprint
            near = np.unique(_around(at[keep[hit]], doc)[0])
            hit, place = _found(items.windows, _window_hashes(h, near))
            out += [(int(near[a]), SPAN, items.window_items[b]) for a, b in zip(hit, place, strict=True)]
    for n, (keys, owners) in items.short.items():
        grams, at = shingle_hashes(h, doc, n)
        hit, place = _found(keys, grams)
        out += [(int(at[a]), n, owners[b]) for a, b in zip(hit, place, strict=True)]
    return out


HITS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_words", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("words", T.LongType())]))),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)


def _scan(sent):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = sent.value
        span = pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64())]))
        for part, data, offs in blocks(batches):
            low = LOWERED[data]
            s, e, doc = words(low, offs, ALNUM)
            h = word_hashes(low, s, e)
            begins = np.searchsorted(doc, np.arange(part.num_rows + 1))
            spans: list[list | None] = [None] * part.num_rows
            found: list[set | None] = [None] * part.num_rows
            for first, n, owners in _occurrences(h, doc, items):
                d = int(doc[first])
                if spans[d] is None:
                    spans[d], found[d] = [], set()
                spans[d].append({"first": int(first - begins[d]), "words": n})
                found[d].update(items.ids[o] for o in owners)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(np.diff(begins)), pa.array([_merged(x) for x in spans], span), pa.array([sorted(x) if x else None for x in found], pa.list_(pa.string()))],
                ["doc_id", "n_words", "spans", "items"],
            )

    return scan


def _merged(spans: list[dict] | None) -> list[dict] | None:
    if not spans:
        return None
    out: list[dict] = []
    for x in sorted(spans, key=lambda x: (x["first"], x["words"])):
        if out and x["first"] <= out[-1]["first"] + out[-1]["words"]:
            out[-1]["words"] = max(out[-1]["words"], x["first"] + x["words"] - out[-1]["first"])
        else:
            out.append(dict(x))
    return out


WINDOWS = "n int, h bigint, item string"
CANDIDATES = "k bigint, doc_id bigint, n_words bigint, found array<struct<n:int,p:bigint,h:bigint,first:bigint>>"
#: Length under which the winnowed k-grams stand among the windows of items.
PRINT = 0


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n, h, item: the windows of items by length and hash, and their winnowed k-grams (n is PRINT, without an item)."""
    for part, data, offs in blocks(batches):
        prints, windows = fingerprints(data, offs)
        ids = part.column(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(prints), PRINT, np.int32)), pa.array(as_signed(prints)), pa.nulls(len(prints), pa.string())], ["n", "h", "item"])
        for n, h, items in windows:
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), n, np.int32)), pa.array(as_signed(h)), ids.take(pa.array(items))], ["n", "h", "item"])


def _candidates(sent, lengths: list[int]):
    """k, doc_id, n_words and found: the windows whose fingerprint p the bitmap lets through; a shorter window is its own fingerprint."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(sent.value, np.uint8)

        def may(h: np.ndarray) -> np.ndarray:
            at = (h >> U64(64 - MAP_BITS)).astype(np.int64)
            return np.flatnonzero(bits[at >> 3] >> (at & 7).astype(np.uint8) & 1)

        for part, data, offs in blocks(batches):
            low = LOWERED[data]
            s, e, doc = words(low, offs, ALNUM)
            h = word_hashes(low, s, e)
            grams, at = shingle_hashes(h, doc, K)
            keep = winnowed(grams, doc[at], WINDOW)
            keep = keep[may(grams[keep])]
            near, of = _around(at[keep], doc)
            found = [(np.full(len(near), SPAN, np.int32), grams[keep][of], _window_hashes(h, near), near)]
            for n in lengths:
                grams, at = shingle_hashes(h, doc, n)
                pick = may(grams)
                found.append((np.full(len(pick), n, np.int32), grams[pick], grams[pick], at[pick]))
            n, p, w, first = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.argsort(first, kind="stable")
            n, p, w, first = n[order], p[order], w[order], first[order]
            begins = np.searchsorted(doc, np.arange(part.num_rows + 1))
            own = first - begins[doc[first]] if len(first) else first
            each = pa.StructArray.from_arrays([pa.array(n), pa.array(as_signed(p)), pa.array(as_signed(w)), pa.array(own)], ["n", "p", "h", "first"])
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(first, begins).astype(np.int32)), each)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.diff(begins)), lists], ["k", "doc_id", "n_words", "found"])

    return scan


def _joined(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, spans, items by shuffled joins; an item is as often in a list as it has windows in the document."""
    spark = docs.sparkSession
    windows = written(items.mapInArrow(_item_windows, WINDOWS), "item-windows")
    known = windows.where(F.col("n") != SPAN).select(F.col("h").alias("p"))
    at = F.shiftrightunsigned("p", 64 - MAP_BITS) + 1  # Spark's bitmaps count from 1
    buckets = known.groupBy(F.bitmap_bucket_number(at).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect()  # 2048 of 4 kB at most
    bits = np.zeros((1 << MAP_BITS) // BUCKET * (BUCKET // 8), np.uint8)
    for r in buckets:
        begin = (r["b"] - 1) * (BUCKET // 8)
        bits[begin : begin + BUCKET // 8] = np.frombuffer(r["bits"], np.uint8)
    lengths = [r["n"] for r in windows.where(~F.col("n").isin(PRINT, SPAN)).select("n").distinct().collect()]  # below SPAN
    sent = spark.sparkContext.broadcast(bits.tobytes())
    numbered = docs.select(F.monotonically_increasing_id().alias("k"), "doc_id", "text")
    candidates = written(numbered.mapInArrow(_candidates(sent, sorted(lengths)), CANDIDATES), "candidates")
    sent.destroy()
    shared = candidates.select("k", F.inline("found")).join(known.distinct(), "p", "left_semi")
    hits = shared.join(windows.where(F.col("n") != PRINT).distinct(), ["n", "h"])
    hits = hits.groupBy("k").agg(F.collect_set(F.struct("first", F.col("n").cast("bigint").alias("words"))).alias("spans"), F.collect_set("item").alias("items"))
    found = candidates.select("k", "doc_id", "n_words").join(hits, "k", "left")
    found = written(found.select("doc_id", "n_words", union_of_spans(F.col("spans")).alias("spans"), F.array_sort("items").alias("items")), "hits")
    dropped(candidates)
    dropped(windows)
    return found


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Finds the benchmark windows that occur in documents.

    docs: doc_id (integer), text; benchmark: item_id, text; other columns are ignored. Returns a row for each row of docs: doc_id,
    n_words, spans (array of first word and number of words, merged and ascending: every word that some occurrence covers)
    and items (item_id as strings, ascending, without repeats), both empty where nothing occurs. A null or empty text
    has no words; an item without words has no window, an item with a null id counts its words but is not listed.
    Equal items or documents are each reported. An empty table on either side gives no hits.
    """
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").alias("text"))
    size = items.agg(F.coalesce(F.sum(F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)) + 1), F.lit(0)).alias("words"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    if size["words"] <= BLOCK_WORDS and size["bytes"] <= BLOCK_WORDS * WORD_BYTES:
        held = items.orderBy("item", "text").collect()
        whole = own.mapInArrow(_scan(spark.sparkContext.broadcast(Items([r["item"] for r in held], [r["text"] for r in held]))), HITS)
    else:
        whole = _joined(own, items)
    none = F.array().cast("array<struct<first:bigint,words:bigint>>"), F.array().cast("array<string>")
    return whole.select("doc_id", "n_words", F.coalesce("spans", none[0]).alias("spans"), F.coalesce(F.filter("items", lambda i: i.isNotNull()), none[1]).alias("items"))


def union_of_spans(spans):
    """Sorted spans without overlaps."""
    kind = "array<struct<first:bigint,words:bigint>>"
    return F.aggregate(
        F.array_sort(spans),
        F.array().cast(kind),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (x["first"] <= F.element_at(acc, -1)["first"] + F.element_at(acc, -1)["words"]),
            F.concat(
                F.slice(acc, 1, F.size(acc) - 1),
                F.array(F.struct(F.element_at(acc, -1)["first"].alias("first"), (F.greatest(F.element_at(acc, -1)["first"] + F.element_at(acc, -1)["words"], x["first"] + x["words"]) - F.element_at(acc, -1)["first"]).alias("words"))),
            ),
        ).otherwise(F.concat(acc, F.array(x))),
    )


def items_digest(items):
    return F.sha2(F.array_join(items, ","), 256)


def digest(ids: list[str]) -> str:
    return hashlib.sha256(",".join(ids).encode()).hexdigest()
