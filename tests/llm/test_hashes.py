"""Texts whose sums of powers collide modulo 2**64 for every odd base, and pieces that are made to collide."""

import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from sitelark.llm import bpe, decontaminate, idpool, near_dedup, search, suffix_dedup, textblocks, token_files

from . import edge
from .test_operators import RANKS, WORDS, brute_cut, brute_hits, brute_search, sha

#: A Thue-Morse word of 1024 letters and its complement.
A = "".join("ab"[k.bit_count() & 1] for k in range(1024))
B = A.translate({97: "b", 98: "a"})


def test_span_hashes_tell_them_apart():
    data = np.frombuffer((A + B).encode(), np.uint8)
    h = textblocks.word_hashes(data, np.array([0, 1024]), np.array([1024, 2048]))
    assert h[0] != h[1]
    starts = np.arange(0, 2048 - 300)
    for size in (1, 7, 8, 9, 100, 255, 256, 257, 300):
        spans = [data[s : s + size].tobytes() for s in starts.tolist()]
        assert len(set(textblocks.word_hashes(data, starts, starts + size).tolist())) == len(set(spans))
    view = textblocks.wide(data)
    for size in (1, 8, 9, 256, 300):
        same = textblocks.same_spans(view, starts, view, starts[::-1], np.full(len(starts), size))
        assert same.tolist() == [data[a : a + size].tobytes() == data[b : b + size].tobytes() for a, b in zip(starts.tolist(), starts[::-1].tolist(), strict=True)]


def test_byte_bpe(spark):
    own = bpe.BytePairs.from_file(RANKS, P.PATTERN)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    for r in bpe.encode_digests(edge.frame(spark, [(1, A), (2, B)]).coalesce(1), RANKS, P.PATTERN).collect():
        text = {1: A, 2: B}[r["doc_id"]]
        assert (r["ids_sha256"], r["decoded_sha256"]) == (sha(",".join(map(str, library.encode_ordinary(text)))), sha(text))


def test_token_files(spark):
    library = Tokenizer.from_file(WORDS)
    got = {r["doc_id"]: r["ids_crc32"] for r in token_files.token_index(edge.frame(spark, [(1, A), (2, B)]).coalesce(1), WORDS, 1).collect()}
    assert got == {i: zlib.crc32(np.array([*library.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes()) for i, t in ((1, A), (2, B))}


def test_near_duplicates(spark):
    rows = [(1, A), (2, B), (3, f"x {A} y z w"), (4, f"x {B} y z w")]
    assert {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(edge.frame(spark, rows)).collect()} == {1: 1, 2: 2, 3: 3, 4: 4}


def test_decontamination(spark):
    items = [(7, B), (8, f"{B} two three four five six seven eight nine ten eleven")]
    rows = [(1, A), (2, f"a {B}"), (3, f"{A} two three four five six seven eight nine ten eleven")]
    got = {r["doc_id"]: (r["n_words"], sum(s["words"] for s in r["spans"]), list(r["items"])) for r in decontaminate.decontaminate(edge.frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {i: brute_hits(t, items) for i, t in rows}


def test_search(spark):
    rows, queries = [(1, A), (2, B), (3, f"{A} other")], [(10, A), (11, B)]
    got = search.top_k(edge.frame(spark, rows), spark.createDataFrame(queries, "query_id long, text string"), 3).collect()
    assert sorted(map(tuple, got)) == brute_search(rows, queries, 3)


def test_substrings(spark):
    rows = [(1, A + B), (2, B + A), (3, A[:500] + B[:500])]
    got = {r["doc_id"]: (r["n_bytes"], [(s["s"], s["e"]) for s in r["spans"]], bytes(r["kept"])) for r in suffix_dedup.substring_dedup(edge.frame(spark, rows)).collect()}
    assert got == brute_cut(rows)


@pytest.mark.parametrize("bits", [0, 3])
def test_pieces_of_one_hash_keep_their_ids(monkeypatch, bits):
    real = textblocks.span_hashes
    monkeypatch.setattr(idpool, "span_hashes", lambda *a: real(*a) & np.uint64((1 << bits) - 1))
    own = bpe.BytePairs.from_file(RANKS, P.PATTERN)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    for text in ("one two three one two", A + " " + B + " " + A, "three four one"):
        assert own.encode(text).tolist() == library.encode_ordinary(text)
