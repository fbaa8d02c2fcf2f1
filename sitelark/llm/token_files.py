"""Token-ID files: independent zstandard frames, a trailing seek table, a checksum for each frame.

A file is a plain zstandard stream: frames of ids, each followed by an empty skippable frame (``SEPARATOR``, what Spark's text
writer puts after each row), and last a skippable frame with the seek table, so any zstandard decoder can read all ids.

Seek table, little-endian: for each frame ``<QIIQQ`` (offset, compressed and decompressed bytes, xxh64 of the ids' bytes, ids
before it in the file); for each document ``<qBII`` (doc_id, 1 if it is null, frame, ids); then ``<IIBIQ8s``: number of frames,
number of documents, bytes of an id, crc32 of the entries, their length, and ``MAGIC``. A document stands in one frame whole; a
reader seeks to the table, finds the frames of the documents that it wants and decompresses only those.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .idpool import IdPool
from ..sources.bigwig import reading
from .shared import deleted, fresh_path, written
from .textblocks import LOWERED, NOT_SPACE, blocks, word_table, words

SEPARATOR = struct.pack("<II", 0x184D2A50, 0)
TABLE_MAGIC = 0x184D2A5E
MAGIC = b"IDFRAMES"
FRAME_ENTRY, DOC_ENTRY, TAIL = struct.Struct("<QIIQQ"), struct.Struct("<qBII"), struct.Struct("<IIBIQ8s")
#: Ids of a frame before it is closed, and bytes of text that are tokenized at once.
FRAME_IDS, TEXT_BYTES = 131_072, 4 << 20
#: Bytes of text of a file, about: what the number of files is taken from.
FILE_BYTES = 128 << 20
#: Schemes of paths that are read by position; files under others come whole, through Spark, which FILE_BYTES bounds.
BY_POSITION = ("file", "hdfs", "viewfs", "s3", "gs")
#: Words and their ids that a Python worker keeps; beyond that it starts anew.
CACHE = 1_000_000


class FileWriter:
    """Builds one file's rows: add() gives a frame when one is full, close() the last frame and the seek table."""

    def __init__(self, id_bytes: int, level: int = 3):
        self.id_bytes, self.zstd = id_bytes, zstandard.ZstdCompressor(level=level)
        self.frames, self.docs, self.held, self.size, self.offset, self.before = [], [], [], 0, 0, 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[bytes]:
        self.docs.append(DOC_ENTRY.pack(doc_id or 0, doc_id is None, len(self.frames), len(ids)))
        self.held.append(ids)
        self.size += len(ids)
        if self.size >= FRAME_IDS:
            yield self._frame()

    def _frame(self) -> bytes:
        raw = np.concatenate(self.held).astype(f"<u{self.id_bytes}").tobytes()
        packed = self.zstd.compress(raw)
        self.frames.append(FRAME_ENTRY.pack(self.offset, len(packed), len(raw), xxhash.xxh64_intdigest(raw), self.before))
        self.offset += len(packed) + len(SEPARATOR)
        self.before += self.size
        self.held, self.size = [], 0
        return packed

    def close(self) -> Iterator[bytes]:
        if self.held:
            yield self._frame()
        entries = b"".join(self.frames) + b"".join(self.docs)
        body = entries + TAIL.pack(len(self.frames), len(self.docs), self.id_bytes, zlib.crc32(entries), len(entries), MAGIC)
        yield struct.pack("<II", TABLE_MAGIC, len(body)) + body


class FileReader:
    """Reads one file. read(offset, size) gives a range of its bytes; only the table and the wanted frames are asked for."""

    def __init__(self, read, size: int):
        self.read = read
        end = size - len(SEPARATOR)
        n_frames, n_docs, self.id_bytes, crc, length, magic = TAIL.unpack(read(end - TAIL.size, TAIL.size))
        if magic != MAGIC:
            raise ValueError("no seek table at the end of the file")
        entries = read(end - TAIL.size - length, length)
        if zlib.crc32(entries) != crc:
            raise ValueError("the seek table fails its checksum")
        self.frames = list(FRAME_ENTRY.iter_unpack(entries[: n_frames * FRAME_ENTRY.size]))
        self.docs = [(None if null else i, frame, n) for i, null, frame, n in DOC_ENTRY.iter_unpack(entries[n_frames * FRAME_ENTRY.size :])]
        assert len(self.docs) == n_docs

    def frame(self, k: int) -> np.ndarray:
        offset, packed, size, checksum, _ = self.frames[k]
        raw = zstandard.ZstdDecompressor().decompress(self.read(offset, packed), max_output_size=max(size, 1))
        if xxhash.xxh64_intdigest(raw) != checksum:
            raise ValueError(f"frame {k} fails its checksum")
        return np.frombuffer(raw, f"<u{self.id_bytes}")

    def documents(self, wanted: Iterable[int | None] | None = None) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, ids before it in the file, ids) of all or of the wanted documents, in the file's order."""
        wanted = None if wanted is None else set(wanted)
        at, inside, open_k, ids = 0, 0, -1, None
        for i, k, n in self.docs:
            if k != open_k:
                open_k, inside, ids = k, 0, None
            if wanted is None or i in wanted:
                ids = self.frame(k) if ids is None else ids
                yield i, at, ids[inside : inside + n]
            inside += n
            at += n


def open_bytes(content: bytes) -> FileReader | None:
    """A reader of a file's content, None for the empty file that Spark writes for an empty table."""
    view = memoryview(content)
    return FileReader(lambda at, n: bytes(view[at : at + n]), len(content)) if len(content) else None


ASCII_LETTER = word_table(inside=bytes(range(97, 123)))
#: ASCII punctuation without the apostrophe, which can begin a token with the letters after it.
PUNCTUATION = word_table(inside=bytes(b for b in range(33, 127) if not chr(b).isalnum() and b != 39))
#: Second bytes of the letters U+00C0 to U+00FF (all but the two signs among them).
LATIN_TAIL = word_table(inside=bytes(b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7)))


def sure_cuts(low: np.ndarray) -> np.ndarray:
    """Bytes before which the tokenizer always splits: punctuation after a letter, an ASCII letter after punctuation."""
    ascii_letter, mark = ASCII_LETTER[low], PUNCTUATION[low]
    letter = ascii_letter.copy()
    letter[1:] |= LATIN_TAIL[low[1:]] & (low[:-1] == 0xC3)
    cuts = np.zeros(len(low), bool)
    cuts[1:] = letter[:-1] & mark[1:] | mark[:-1] & ascii_letter[1:]
    return cuts


def inside(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Flags of the n bytes that lie in one of the spans, which do not overlap."""
    step = np.zeros(n + 1, np.int8)
    step[starts] += 1
    step[ends] -= 1
    return np.cumsum(step[:-1], dtype=np.int8) > 0


class WordTokenizer:
    """Ids of texts by a word tokenizer that drops white space and case: each stretch between sure splits is tokenized once.

    White space, and the punctuation of sure_cuts(), never joins a token nor reaches across in this tokenizer's splitting, so a text's ids
    are those of its stretches in order; tests hold that against the library on whole texts. A text that may hold one of the file's
    added tokens, in any case, is one stretch and goes to the library whole and with its own case. Of other stretches only those of ASCII
    alone are folded beforehand: the library composes before it folds, and some small letters compose where their capitals do not.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.added = [t.content.encode().lower() for t in self.library.get_added_tokens_decoder().values()]
        self.id_bytes = 2 if self.library.get_vocab_size() <= 1 << 16 else 4
        self.known = IdPool(CACHE)

    def with_added(self, low: bytes, offs: np.ndarray) -> np.ndarray:
        """The texts of a block, in lower case, in which an added token may stand."""
        at = []
        for token in self.added:
            found = low.find(token)
            while found >= 0:
                at.append(found)
                found = low.find(token, found + 1)
        return np.unique(np.searchsorted(offs, np.array(at, np.int64), side="right") - 1)

    def encode_block(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a block's texts, and the number of ids before each text and at the end."""
        low = LOWERED[data]
        s, e, doc = words(low, offs, NOT_SPACE, sure_cuts(low))
        whole = self.with_added(low.tobytes(), offs)
        if len(whole):
            rest = ~np.isin(doc, whole)
            s, e, doc = np.r_[s[rest], offs[whole]], np.r_[e[rest], offs[whole + 1]], np.r_[doc[rest], whole]
            order = np.argsort(s)
            s, e, doc = s[order], e[order], doc[order]
        high = np.r_[0, np.cumsum(data >= 0x80)]
        own_case = (high[e] > high[s]) | np.isin(doc, whole)
        data = np.where(inside(s[own_case], e[own_case], len(data)), data, low) if own_case.any() else low
        raw = data.tobytes()

        def learn(pieces: list[int]) -> tuple[np.ndarray, np.ndarray]:
            found = self.library.encode([raw[s[i] : e[i]].decode() for i in pieces], is_pretokenized=True, add_special_tokens=False)
            return np.array(found.ids, np.uint32), np.bincount(np.array(found.word_ids, np.int64), minlength=len(pieces))

        ids, total = self.known.ids(data, s, e, learn) if len(s) else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        return ids, np.r_[0, total][np.searchsorted(doc, np.arange(len(offs)))]


_loaded: dict[str, WordTokenizer] = {}


def loaded(path: str) -> WordTokenizer:
    if path not in _loaded:
        _loaded[path] = WordTokenizer(path)
    return _loaded[path]


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, path: str) -> None:
    """Writes the ids of all documents, each ended by end_id, as files under path, in ascending doc_id order over all files.

    docs: doc_id (integer), text; other columns are ignored. Rows with a null doc_id come first; rows that share a doc_id follow
    each other by a hash of their texts, so that even the rows of one doc_id may lie in several files. A file holds some FILE_BYTES of
    text, or one longer document. A null or empty text has the end id alone. An empty table gives at most an empty file.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, file = loaded(tokenizer), None
        for part, data, offs in blocks(batches, most=TEXT_BYTES):
            file = file or FileWriter(coder.id_bytes)
            ids, cuts = coder.encode_block(data, offs)
            ids = ids.astype(np.uint16) if coder.id_bytes == 2 else ids
            end = np.array([end_id], ids.dtype)
            out = [row for k, i in enumerate(part.column(0).to_pylist()) for row in file.add(i, np.concatenate([ids[cuts[k] : cuts[k + 1]], end]))]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
        if file:
            yield pa.RecordBatch.from_arrays([pa.array(list(file.close()), pa.binary())], ["value"])

    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // FILE_BYTES))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"), F.xxhash64("text").alias("hash"))
    ordered = own.repartitionByRange(files, "doc_id", "hash").sortWithinPartitions("doc_id", "hash", "text").select("doc_id", "text")
    ordered.mapInArrow(rows, "value binary").select(F.col("value").cast("string").alias("value")).write.option("lineSep", SEPARATOR.decode("latin-1")).text(path)


def read_token_files(spark: SparkSession, path: str, wanted: list[int] | None = None) -> DataFrame:
    """file_no, doc_id, local_start (ids before it in its file), n_tokens, ids_crc32 of documents in the files under path.

    wanted: doc_ids; None: all. Of each file the seek table and the frames of these documents are read, by position. ids_crc32 is over ids as
    little-endian 32-bit integers.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, length, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if not length:  # what Spark writes for an empty table
                    continue
                file, at = (None, None) if content.is_valid else reading(name)
                reader = open_bytes(content.as_buffer()) if file is None else FileReader(at, length)
                number = int(re.search(r"part-(\d+)", name)[1])
                found = [(i, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for i, at, ids in reader.documents(wanted)]
                if file is not None:
                    file.close()
                i, at, n, crc = (list(x) for x in zip(*found, strict=True)) if found else ([], [], [], [])
                yield pa.RecordBatch.from_arrays([pa.array([number] * len(i), pa.int32()), pa.array(i, pa.int64()), pa.array(at, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], ["file_no", "doc_id", "local_start", "n_tokens", "ids_crc32"])

    files = spark.read.format("binaryFile").load(path)
    whole = F.col("content") if "://" in path and path.partition(":")[0] not in BY_POSITION else F.lit(None).cast("binary")
    return files.select("path", "length", whole.alias("content")).mapInArrow(rows, "file_no int, doc_id bigint, local_start bigint, n_tokens bigint, ids_crc32 bigint")


def token_index(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Writes docs as token files, reads them back, and gives doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    The files serve this result alone and are deleted once they are read; write_token_files() writes files to keep.
    """
    spark = docs.sparkSession
    path = fresh_path(spark, "tokens")
    write_token_files(docs, tokenizer, end_id, path)
    found = written(read_token_files(spark, path), "token-index")
    deleted(spark, path)
    totals = found.groupBy("file_no").agg(F.sum("n_tokens").alias("total"))  # a row for each file
    bases = totals.select("file_no", (F.sum("total").over(Window.orderBy("file_no")) - F.col("total")).alias("base"))
    return found.join(bases, "file_no").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")
