"""Texts as one byte buffer for numpy: blocks of bounded size, words by byte class, 64-bit hashes of words and shingles.

The word classes used here put every byte from 0x80 up on the same side, so words by UTF-8 byte are words by character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text in a block; a longer text is a block of its own.
BLOCK_BYTES = 2 << 20
U64 = np.uint64
#: Bytes of a span that are taken eight at a time, all spans side by side.
LONG_SPAN = 256
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)


def word_table(inside: bytes | None = None, outside: bytes | None = None) -> np.ndarray:
    """A table of 256 flags: the bytes of a word given directly, or all but some."""
    table = np.full(256, outside is not None)
    for b in inside or outside or b"":
        table[b] = outside is None
    return table


#: Words ``[^\x20\x09-\x0D]+``.
NOT_SPACE = word_table(outside=b" \t\n\x0b\x0c\r")
#: Words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of lower-cased text: 0-9, a-z and everything from 0x80.
ALNUM = word_table(inside=bytes([*range(48, 58), *range(97, 123), *range(128, 256)]))
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: each output bit depends on all input bits."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with the bytes of their texts and the offsets of each text; a null text is empty."""
    for batch in batches:
        data, offs = _buffer(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offs, offs[at] + most, side="right")) - 1)
            yield batch.slice(at, to - at), data[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
            at = to


def _buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, values = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(values, np.uint8)[offs[0] : offs[-1]] if values is not None else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def words(data: np.ndarray, offs: np.ndarray, table: np.ndarray, cuts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of word bytes, none across texts, and the text that each is in.

    cuts: flags of the bytes before which a run is cut in two.
    """
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    flag = table[data]
    first = flag.copy()
    first[1:] &= ~flag[:-1]
    edges = offs[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    first[edges] = flag[edges]
    last = flag.copy()
    last[:-1] &= ~flag[1:]
    last[edges - 1] = flag[edges - 1]
    if cuts is not None:
        first |= cuts & flag
        last[:-1] |= cuts[1:] & flag[:-1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offs, starts, side="right") - 1


def wide(data: np.ndarray) -> np.ndarray:
    """At each byte of data, and at its end, the eight bytes from there on as one integer; zeros follow the end."""
    padded = np.zeros(data.nbytes + 8, np.uint8)
    padded[:-8] = data.view(np.uint8)
    return np.ndarray((data.nbytes + 1,), np.dtype("<u8"), padded, 0, (1,))


def span_hashes(view: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each span of bytes, of which view is wide(): its length and each eight bytes go through the finalizer in turn.

    Unlike sums of powers this is not linear in the bytes, so that no pair of words is known to collide; from LONG_SPAN bytes on
    the rest of a span goes through xxhash.
    """
    size = ends - starts
    h = mixed((view[starts] & _MASKS[np.minimum(size, 8)]) ^ (size.astype(U64) * U64(0x9E3779B97F4A7C15)))
    at, live = 8, np.flatnonzero(size > 8)
    while len(live):
        if at == LONG_SPAN:
            raw = view.base
            rest = [xxhash.xxh3_64_intdigest(raw[s:e]) for s, e in zip((starts[live] + at).tolist(), ends[live].tolist(), strict=True)]
            h[live] = mixed(h[live] + np.array(rest, U64))
            break
        h[live] = mixed(h[live] ^ (view[starts[live] + at] & _MASKS[np.minimum(size[live] - at, 8)]))
        at += 8
        live = live[size[live] > at]
    return h


def same_spans(a: np.ndarray, a_starts: np.ndarray, b: np.ndarray, b_starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether spans of equal length hold equal bytes; a and b are wide()."""
    same = ((a[a_starts] ^ b[b_starts]) & _MASKS[np.minimum(size, 8)]) == 0
    at, live = 8, np.flatnonzero(same & (size > 8))
    while len(live):
        if at == LONG_SPAN:
            x, y = a.base, b.base
            for i in live.tolist():
                same[i] = np.array_equal(x[a_starts[i] + at : a_starts[i] + size[i]], y[b_starts[i] + at : b_starts[i] + size[i]])
            break
        good = ((a[a_starts[live] + at] ^ b[b_starts[live] + at]) & _MASKS[np.minimum(size[live] - at, 8)]) == 0
        same[live] = good
        at += 8
        live = live[good & (size[live] > at)]
    return same


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hashes(wide(data), starts, ends)


def shingle_hashes(h: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words of a text, and the index of each shingle's first word."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    out = h[:n].copy()
    for j in range(1, k):
        out *= U64(0xD6E8FEB86659FD93)
        out += h[j : j + n]
    at = np.flatnonzero(doc[:n] == doc[k - 1 : k - 1 + n])
    return mixed(out[at] + U64(k)), at


def as_signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
