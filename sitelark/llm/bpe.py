"""Byte-level BPE with a hierarchical-bitmap rank queue, encoding and decoding.

Merges of one pre-token run on a linked list of its pieces. Each adjacent pair that has a rank is queued in the bucket of
that rank; which buckets are filled stands in a bitmap of three levels of 64-bit words, so that find-first-set on
three words gives the least rank. Entries that a merge has made stale stay queued and are skipped when they come up.
A pre-token of n bytes takes O(n log n) whatever merges it needs.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .idpool import IdPool

#: Pre-tokens whose ids a Python worker keeps; beyond that it starts anew. Characters of text split at once.
CACHE, BLOCK_CHARS = 900_000, 1 << 20
LETTER, NUMBER, SPACE = 1, 2, 3
#: The pattern whose splitting classes() and split() do with tables; another pattern is left to the regex library.
KNOWN_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class RankQueue:
    """Positions in buckets by rank; which buckets are filled is marked in a bitmap of three levels."""

    def __init__(self, ranks: int):
        n0 = ranks // 64 + 1
        n1 = n0 // 64 + 1
        self.low, self.mid, self.top = [0] * n0, [0] * n1, 0
        self.buckets: dict[int, list[int]] = {}

    def fill(self, rank: int, positions: list[int]) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket += positions
            return
        self.buckets[rank] = positions
        i = rank >> 6
        j = i >> 6
        self.low[i] |= 1 << (rank & 63)
        self.mid[j] |= 1 << (i & 63)
        self.top |= 1 << j

    def take(self) -> tuple[int, list[int]] | None:
        """The least rank with its positions from left to right, which leave the queue; None when it is empty."""
        top = self.top
        if not top:
            return None
        j = (top & -top).bit_length() - 1
        word = self.mid[j]
        i = j << 6 | (word & -word).bit_length() - 1
        word = self.low[i]
        rank = i << 6 | (word & -word).bit_length() - 1
        self.low[i] = word & (word - 1)
        if not self.low[i]:
            self.mid[j] &= self.mid[j] - 1
            if not self.mid[j]:
                self.top = top & (top - 1)
        bucket = self.buckets.pop(rank)
        bucket.sort()
        return rank, bucket


_classes: list[np.ndarray] = []


def classes() -> np.ndarray:
    """The class of each code point: letter, number, white space or 0."""
    if not _classes:
        table = np.zeros(0x110000, np.uint8)
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
            for m in regex.finditer(pattern, every):
                a, b = ord(every[m.start()]), ord(every[m.end() - 1])
                table[a : b + 1] = kind
        table[0xD800:0xE000] = 0
        _classes.append(table)
    return _classes[0]


def split(points: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Where the pre-tokens of KNOWN_PATTERN start in texts given as code points, offs[d] being the start of text d."""
    n = len(points)
    kind = classes()[points]
    edge = np.zeros(n + 3, bool)
    edge[offs] = True  # no pre-token crosses from one text to the next
    turn = np.ones(n, bool)
    turn[1:] = kind[1:] != kind[:-1]
    turn |= edge[:n]
    start = turn.copy()
    after = np.zeros(n, bool)  # a run of other than white space that follows white space in its text
    after[1:] = turn[1:] & (kind[1:] != SPACE) & (kind[:-1] == SPACE) & ~edge[1:n]
    start[:-1] |= after[1:]
    start[1:] &= ~(after[1:] & (points[:-1] == 32))
    quote = np.flatnonzero(start & (points == 39))
    if len(quote):
        tail = np.r_[points, np.zeros(2, points.dtype)]
        one, two = tail[quote + 1], tail[quote + 2]
        short = ~edge[quote + 1] & np.isin(one, [ord(c) for c in "stmd"])
        long = ~edge[quote + 1] & ~edge[quote + 2] & (((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108))
        kinds = np.r_[kind, np.zeros(3, np.uint8)]
        for which, size in ((quote[short], 2), (quote[long], 3)):
            start[which + 1] = False
            more = which + size
            more = more[(more < n)]
            start[more] |= ~edge[more] & (kinds[more] == LETTER)
    return np.flatnonzero(start)


class BytePairs:
    """A vocabulary of mergeable ranks with its encoder and decoder.

    ranks: bytes -> id, with all 256 single bytes in it; pattern: what splits a text into pre-tokens.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, pattern
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        size = max(ranks.values()) + 1
        self.queue, self.known = RankQueue(size), IdPool(CACHE)
        self.two = np.full(1 << 16, -1, np.int64)
        names: list[bytes] = [b""] * size
        for piece, i in ranks.items():
            names[i] = piece
            if len(piece) == 2:
                self.two[piece[0] << 8 | piece[1]] = i
        self.lengths = np.array([len(x) for x in names], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(names), np.uint8)

    @classmethod
    def from_file(cls, path: str, pattern: str) -> BytePairs:
        """path: lines of a base64 piece and its rank."""
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}, pattern)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of pre-tokens, and the number of ids of each.

        The pieces stand behind each other in one linked list, and no pair crosses from one to the next. A bucket is worked
        off from left to right; when a merge queues a pair of a lower rank, what is left of the bucket goes back first.
        """
        get, queue = self.ranks.get, self.queue
        text = b"".join(pieces)
        n = len(text)
        ends = np.cumsum([len(p) for p in pieces])
        edges = bytearray(n + 1)
        for x in ends.tolist():
            edges[x] = 1
        edges[0] = 1
        raw = np.frombuffer(text, np.uint8).astype(np.int64)
        token = self.single[raw]
        ranks = np.full(n, -1, np.int64)
        ranks[:-1] = self.two[raw[:-1] << 8 | raw[1:]]
        begin = ends - [len(p) for p in pieces]
        whole = [(b, len(p), r) for b, p in zip(begin.tolist(), pieces, strict=True) if len(p) > 1 and (r := get(p)) is not None]
        ranks[ends[ends > 0] - 1] = -1
        end = np.arange(1, n + 1)
        dead = np.zeros(n, bool)
        for b, size, r in whole:  # in the vocabulary as it is
            ranks[b : b + size] = -1
            dead[b + 1 : b + size] = True
            end[b], token[b] = b + size, r
        order = np.argsort(ranks, kind="stable")
        order = order[np.searchsorted(ranks[order], 0) :]
        if len(order):
            first = np.flatnonzero(np.r_[True, np.diff(ranks[order]) != 0])
            for r, positions in zip(ranks[order[first]].tolist(), np.split(order, first[1:]), strict=True):
                queue.fill(r, positions.tolist())
        pair, end, token, left = ranks.tolist(), end.tolist(), token.tolist(), list(range(-1, n - 1))
        gone = []
        buckets, fill = queue.buckets, queue.fill
        while (least := queue.take()) is not None:
            rank, bucket = least
            for x, i in enumerate(bucket):
                if pair[i] != rank:  # stale
                    continue
                j = end[i]
                k = end[j]
                end[i], token[i], pair[j] = k, rank, -1
                gone.append(j)
                lower = False
                if edges[k]:
                    pair[i] = -1
                else:
                    left[k] = i
                    r = get(text[i : end[k]], -1)
                    pair[i] = r
                    if r >= 0:
                        if r in buckets:
                            buckets[r].append(i)
                        else:
                            fill(r, [i])
                        lower = r < rank
                if not edges[i]:
                    h = left[i]
                    r = get(text[h:k], -1)
                    pair[h] = r
                    if r >= 0:
                        if r in buckets:
                            buckets[r].append(h)
                        else:
                            fill(r, [h])
                        lower = lower or r < rank
                if lower and x + 1 < len(bucket):
                    fill(rank, bucket[x + 1 :])
                    break
        dead[gone] = True
        live = np.flatnonzero(~dead)
        cuts = np.searchsorted(live, np.r_[begin, n])
        return np.array(token, np.uint32)[live], np.diff(cuts)

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of texts, and the number of ids before each text and at the end."""
        whole = "".join(texts)
        offs = np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)
        if not whole:
            return np.zeros(0, np.uint32), np.zeros(len(offs), np.int64)
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        if self.pattern == KNOWN_PATTERN:
            starts = split(points, offs)
        else:
            starts = np.array([m.start() + o for t, o in zip(texts, offs, strict=False) for m in regex.finditer(self.pattern, t)], np.int64)
        ends = np.r_[starts[1:], len(points)]
        ids, total = self.known.ids(points, 4 * starts, 4 * ends, lambda new: self.merge([whole[starts[i] : ends[i]].encode() for i in new]))
        return ids, np.r_[0, total][np.searchsorted(starts, offs)]

    def encode(self, text: str) -> np.ndarray:
        """The ids of a whole text, as unsigned 32-bit integers."""
        return self.encode_all([text])[0]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids, gathered from the vocabulary's one byte table."""
        ids = ids.astype(np.int64)
        size = self.lengths[ids]
        before = np.cumsum(size) - size
        at = np.repeat(self.starts[ids] - before, size) + np.arange(int(size.sum()))
        return self.bytes[at].tobytes()


_loaded: dict[tuple[str, str], BytePairs] = {}


def loaded(path: str, pattern: str) -> BytePairs:
    """One vocabulary for each Python worker."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = BytePairs.from_file(path, pattern)
    return _loaded[path, pattern]


def text_slices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of batches with at most BLOCK_CHARS characters of text, or one longer text; a null text is empty."""
    for batch in batches:
        texts = [t or "" for t in batch.column(column).to_pylist()]
        at, size = 0, 0
        for to, t in enumerate(texts):
            if size and size + len(t) > BLOCK_CHARS:
                yield batch.slice(at, to - at), texts[at:to]
                at, size = to, 0
            size += len(t)
        if at < len(texts):
            yield batch.slice(at), texts[at:]


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Adds ids (array<int>) to docs and nothing else; the columns of docs stay.

    docs: a text column; a null or empty text has no ids. path: a rank file that every executor has (an installed package's).
    If docs has a column ids already, it is replaced. Very long texts and pre-tokens are taken whole.
    """
    out = T.StructType([f for f in docs.schema.fields if f.name != "ids"] + [T.StructField("ids", T.ArrayType(T.IntegerType()))])
    keep = [f.name for f in out.fields[:-1]]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = loaded(path, pattern)
        for part, texts in text_slices(batches, keep.index("text")):
            ids, cuts = coder.encode_all(texts)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(ids.view(np.int32)))], [*keep, "ids"])

    return docs.select(*keep).mapInArrow(encode, out)


def decode_documents(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """Replaces ids by decoded (binary), the bytes that they stand for; null ids decode to no bytes."""
    keep = [f.name for f in tokens.schema.fields if f.name not in ("ids", "decoded")]
    out = T.StructType([tokens.schema[c] for c in keep] + [T.StructField("decoded", T.BinaryType())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = loaded(path, pattern)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("ids"))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), pa.array([coder.decode(np.asarray(x.values)) if x.is_valid and len(x.values) else b"" for x in ids], pa.binary())], out.fieldNames())

    return tokens.select(*keep, "ids").mapInArrow(decode, out)


DIGESTS = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def encode_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, sha256 of the comma-joined ids and of the bytes that the ids decode to, a row for each row of docs.

    Encodes and decodes a text at a time, so that ids of a document never leave the task.
    """

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = loaded(path, pattern)
        names = [str(i).encode() for i in range(len(coder.lengths))]
        for part, texts in text_slices(batches, 1):
            ids, cuts = coder.encode_all(texts)
            each = [ids[x:y] for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
            a = [hashlib.sha256(b",".join([names[i] for i in x.tolist()])).hexdigest() for x in each]
            b = [hashlib.sha256(coder.decode(x)).hexdigest() for x in each]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(cuts)), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).mapInArrow(digests, DIGESTS)


def encode_verified(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids and decoded_sha256 (of the bytes that the ids decode to), a row for each row of docs."""
    schema = "doc_id bigint, n_tokens bigint, ids array<int>, decoded_sha256 string"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = loaded(path, pattern)
        for part, texts in text_slices(batches, 1):
            ids, cuts = coder.encode_all(texts)
            whole = [hashlib.sha256(coder.decode(ids[x:y])).hexdigest() for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(cuts)), pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(ids.view(np.int32))), pa.array(whole, pa.string())], ["doc_id", "n_tokens", "ids", "decoded_sha256"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).mapInArrow(encode, schema)
