"""Each operator against brute force on the awkward table, with nulls, repeated rows, empty tables and clashing columns."""

import base64
import hashlib
import io
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sitelark.llm import bpe, components, decontaminate, line_dedup, near_dedup, pii, search, suffix_dedup, token_files, textblocks, toxicity, url_filter

from . import edge

RANKS, WORDS = P.path("byte_bpe_multi_50k.tiktoken"), P.path("word_bpe_49k.json")
LOWER = {c: c + 32 for c in range(65, 91)}


def sha(x) -> str:
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


# ---- 1


PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def brute_pii(text: str) -> list[tuple[int, int, int]]:
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum((2 * int(c) - 9 * (int(c) > 4)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0
            if k == 0 or k == 1 and all(int(x) <= 255 for x in m[0].split(".")) or k == 2 and 12 <= len(digits) <= 19 and luhn or k == 3 and 9 <= len(digits) <= 15:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_pii_base_spans(spark):
    rng = random.Random(5)
    noise = ["".join(rng.choice("a1.@+- 59()é4_,") for _ in range(80)) for _ in range(150)]
    rows = [*edge.texts(), *((100 + k, t) for k, t in enumerate(noise)), (900, " ".join(f"a{k}@b.io" for k in range(700)))]
    got = {r["doc_id"]: r for r in pii.find_personal_data(edge.frame(spark, rows)).collect()}
    for i, text in rows:
        base = [tuple(s) for s in got[i]["base"]]
        assert base == brute_pii(text or ""), text
        assert set(base) <= {tuple(s) for s in got[i]["spans"]}


def test_pii_addresses_with_zero_parts(spark):
    rng = random.Random(6)
    known = ["10.0.0.1", "192.168.0.1", "127.0.0.1", "0.0.0.0", "000.1.2.3", "00.000.0.00255", "0.0.0.256", "0256.0.0.0", "1.2.3.", "1.2.3.4"]
    noise = ["".join(rng.choice("0012.5. ") for _ in range(60)) for _ in range(100)]
    rows = list(enumerate([*(f"host {a} up" for a in known), *noise]))
    got = {r["doc_id"]: [tuple(s) for s in r["base"]] for r in pii.find_personal_data(edge.frame(spark, rows)).collect()}
    assert got == {i: brute_pii(t) for i, t in rows}
    assert [len(got[i]) for i in range(len(known))] == [1, 1, 1, 1, 1, 1, 0, 0, 0, 1]


def test_pii_nulls_and_empty(spark):
    assert pii.find_personal_data(edge.with_nulls(spark)).count() == edge.with_nulls(spark).count()
    assert pii.find_personal_data(edge.empty(spark)).collect() == []


def test_pii_estimates_find_the_reliable_labelers():
    rng, counts = random.Random(3), defaultdict(int)
    for _ in range(4000):
        truth = rng.random() < 0.4
        votes = tuple((1 if truth == (rng.random() < q) else -1) for q in (0.95, 0.9, 0.85, 0.5))
        counts[(0, votes, 1, truth)] += 1
    merged = defaultdict(int)
    for (k, v, s, _), n in counts.items():
        merged[k, v, s] += n
    patterns = [(*key, n) for key, n in merged.items()]
    post = pii.estimate(patterns)
    right = sum(n for (k, v, s, truth), n in counts.items() if (post[k, v] > 0.5) == truth)
    assert right / 4000 > 0.93
    weights = pii.train_classifier(patterns, post)
    by = {(k, v): sum(weights[i] for i in pii._features(k, v, s)) for k, v, s, _ in patterns}
    assert sum(n for (k, v, s, truth), n in counts.items() if (by[k, v] > 0) == truth) / 4000 > 0.9


def test_pii_classifier_adds_loose_spans_and_keeps_base(spark):
    rng = random.Random(8)
    mail = lambda k: f"please mail u{k} [at] host{k % 7} [dot] com today"
    rows = []
    for k in range(240):
        strict = f"mail u{k}@host.com or call +1 389 555 {1000 + k}" if k % 3 else "no address here"
        loose = mail(k) if k % 4 == 0 else f"call 389-555-{1000 + k} now" if k % 4 == 1 else "nothing else"
        failed = f"order number {rng.randrange(10**13, 10**14)} and version 999.{k}.1.2" if k % 5 == 0 else ""
        rows.append((k, f"{strict}. {loose}. {failed}"))
    out = {r["doc_id"]: ([tuple(s) for s in r["base"]], [tuple(s) for s in r["spans"]]) for r in pii.find_personal_data(edge.frame(spark, rows)).collect()}
    added = {i: set(spans) - set(base) for i, (base, spans) in out.items()}
    for i, text in rows:
        base, spans = out[i]
        assert base == brute_pii(text) and set(base) <= set(spans) and spans == sorted(spans)
        at = text.find(" [at]")
        if at >= 0:
            start = text.rfind(" ", 0, at) + 1
            assert any(k == 0 and s == start and text[s:e].endswith("com") for s, k, e in added[i]), text
        for s, k, e in added[i]:  # nothing of what counter cues stand before, nothing over a base span
            assert not text[max(0, s - 14) : s].endswith(("order number ", "version ")), text[s:e]
            assert not any(k == x[1] and x[0] < e and s < x[2] for x in base)


def test_pii_of_a_very_long_text(spark):
    text = "".join(f"a{k}@b.io, 10.0.{k % 300}.7 and +1 389 555 {k}; " for k in range(30_000))  # some 1.2 MB
    r = pii.find_personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [tuple(s) for s in r["base"]] == brute_pii(text)


# ---- 2


def test_token_files_round_trip(spark, tmp_path):
    library = token_files.WordTokenizer(WORDS).library
    rows = [r for r in edge.texts()]
    got = [tuple(r) for r in token_files.token_index(edge.frame(spark, rows), WORDS, 1).select("doc_id", "start", "n_tokens", "ids_crc32").orderBy("doc_id").collect()]
    start, want = 0, []
    for i, text in sorted(rows):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want
    path = f"file://{tmp_path}/tokens"
    token_files.write_token_files(edge.frame(spark, rows), WORDS, 1, path)
    some = {r["doc_id"]: r["n_tokens"] for r in token_files.read_token_files(spark, path, [8, 21, 999]).collect()}
    assert some == {w[0]: w[2] for w in want if w[0] in (8, 21)}
    for file in tmp_path.glob("tokens/part-*"):  # any zstandard decoder reads the frames
        raw = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(file.read_bytes()), read_across_frames=True).read()
        reader = token_files.open_bytes(file.read_bytes())
        assert raw == b"".join(reader.frame(k).tobytes() for k in range(len(reader.frames)))


def test_token_files_detect_damage_and_read_ranges():
    w = token_files.FileWriter(2)
    rows = [row for k in range(40) for row in w.add(k, np.arange(9000) % 50_000)] + list(w.close())
    content = b"".join(r + token_files.SEPARATOR for r in rows)
    read = []
    reader = token_files.FileReader(lambda at, n: read.append((at, n)) or content[at : at + n], len(content))
    (found,) = reader.documents([37])
    assert found[0] == 37 and found[1] == 37 * 9000 and (found[2] == np.arange(9000) % 50_000).all()
    assert len(read) == 3  # tail, table and one frame
    hurt = bytearray(content)
    hurt[reader.frames[1][0] + 40] ^= 1
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(token_files.open_bytes(bytes(hurt)).documents())


def read_ranges(monkeypatch, tmp_path):
    """Lets each task that opens a token file leave the ranges that it read in tmp_path."""
    log, opened = str(tmp_path / "ranges"), token_files.reading

    def logged(name):
        file, at = opened(name)

        def seen(offset, size):
            with open(log, "a") as out:
                out.write(f"{offset} {size}\n")
            return at(offset, size)

        return file, seen

    monkeypatch.setattr(token_files, "reading", logged)
    return lambda: [tuple(map(int, x.split())) for x in open(log)]


def test_token_files_of_bounded_size_hold_every_row_in_order(spark, tmp_path, monkeypatch):
    rows = [(k, f"one two {k}") for k in range(300)] + [(7, f"three {k}") for k in range(600)] + [(None, "four")] * 3
    whole = token_files.token_index(edge.frame(spark, rows).coalesce(1), WORDS, 1).select("doc_id", "start", "n_tokens", "ids_crc32")
    before = sorted(map(repr, whole.collect()))
    monkeypatch.setattr(token_files, "FILE_BYTES", 100)
    path = f"file://{tmp_path}/tokens"
    token_files.write_token_files(edge.frame(spark, rows), WORDS, 1, path)
    found = token_files.read_token_files(spark, path)
    assert found.select("file_no").distinct().count() > 40 and found.where("doc_id = 7").select("file_no").distinct().count() > 10
    assert sorted(map(repr, token_files.token_index(edge.frame(spark, rows), WORDS, 1).select("doc_id", "start", "n_tokens", "ids_crc32").collect())) == before


def test_token_files_are_read_by_the_seek_table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "FRAME_IDS", 50)
    path = f"file://{tmp_path}/tokens"
    token_files.write_token_files(edge.frame(spark, [(k, "one two three four five " * 30 + str(k)) for k in range(400)]).coalesce(1), WORDS, 1, path)
    ranges = read_ranges(monkeypatch, tmp_path)
    assert [r["doc_id"] for r in token_files.read_token_files(spark, path, [123]).collect()] == [123]
    files = list(tmp_path.glob("tokens/part-*"))
    assert len(ranges()) == 2 * len(files) + 1  # tail and table of each file, and the one frame
    assert "content" not in token_files.read_token_files(spark, path)._jdf.queryExecution().executedPlan().toString().partition("ReadSchema")[2]


def test_token_files_under_other_schemes_come_whole(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/tokens"
    token_files.write_token_files(edge.frame(spark, edge.texts()), WORDS, 1, path)
    by_position = sorted(token_files.read_token_files(spark, path).collect())
    monkeypatch.setattr(token_files, "BY_POSITION", ())
    monkeypatch.setattr(token_files, "reading", None)
    assert sorted(token_files.read_token_files(spark, path).collect()) == by_position


def test_token_files_nulls_and_empty(spark):
    library = token_files.WordTokenizer(WORDS).library
    ids = lambda text: np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
    got = token_files.token_index(edge.with_nulls(spark), WORDS, 1).orderBy("start").collect()
    want = [(r["doc_id"], zlib.crc32(ids(r["text"]).tobytes())) for r in edge.with_nulls(spark).collect()]
    assert sorted(map(repr, want)) == sorted(repr((r["doc_id"], r["ids_crc32"])) for r in got)
    assert [r["doc_id"] for r in got] == sorted((i for i, _ in want), key=lambda i: (i is not None, i or 0))
    assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got])[:-1].tolist()]
    assert token_files.token_index(edge.empty(spark), WORDS, 1).collect() == []


def test_word_tokenizer_equals_the_library():
    rng = random.Random(2)
    coder = token_files.WordTokenizer(WORDS)
    letters = [*"abcdeéßñ '’\n\t 0129.,;!?sdmtrevlAQ(|", "\x1c", "\x85", "\u00a0", "中", "\U0001F600", "e\u0301", "=\u0338", "İ", "Σ", "×", "É"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    data = "".join(texts).encode()
    offs = np.r_[0, np.cumsum([len(t.encode()) for t in texts])]
    ids, cuts = coder.encode_block(np.frombuffer(data, np.uint8), offs)
    want = [e.ids for e in coder.library.encode_batch(texts, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(cuts[:-1], cuts[1:], strict=True)] == want


def encoded(texts: list[str]) -> tuple[list, list]:
    """The ids of texts by the operator's tokenizer, and by the library with the file as it is."""
    offs = np.r_[0, np.cumsum([len(t.encode()) for t in texts])]
    ids, cuts = token_files.WordTokenizer(WORDS).encode_block(np.frombuffer("".join(texts).encode(), np.uint8), offs)
    want = [e.ids for e in Tokenizer.from_file(WORDS).encode_batch(texts, add_special_tokens=False)]
    return [ids[a:b].tolist() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], want


def test_word_tokenizer_keeps_the_added_tokens():
    rng = random.Random(12)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|endoftext", "|>", *"ab É.,'\n\t<|", "", " x y ", "Don't"]
    texts = ["x <|endoftext|> y", "<|endoftext|>", "", "<|endof", "text|>", *("".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(800))]
    got, want = encoded(texts)
    assert got == want and want[0] == [343, 49407, 344]


def test_word_tokenizer_composes_before_it_folds():
    rng = random.Random(13)
    pairs = ["J\u030c", "H\u0331", "T\u0308", "W\u030a", "Y\u030a"]
    parts = [*pairs, *(p.lower() for p in pairs), *"JHTWYjhtwy\u030c\u0331\u0308\u030a .,'é", "\u0323", "İ", "\u212a"]
    got, want = encoded([*pairs, *("x" + p + "x" for p in pairs), *("".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(1500))])
    assert got == want


# ---- 3


def test_url_rules_and_parts(spark):
    urls = ["https://A.Example.ORG/es/x?q#f", "http://example.org/en/12", "http://notexample.org/es/", "ftp://x.com/fr/", "http://x.com/de/y", "http://x.com", "no scheme", None, "http://", "a://b.org", "http://b.org?x/y", "x://É.com/de/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("bad", F.lit(1)).withColumn("host", F.lit("clash"))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(pages, spark.createDataFrame([], "page_id long, bad int")).collect()}
    want = [
        ("a.example.org", "/es/x", "example.org/es/", "block"), ("example.org", "/en/12", "example.org/en/1", "block"), ("notexample.org", "/es/", "org/", "allow"), ("x.com", "/fr/", "com/fr/", "allow"),
        ("x.com", "/de/y", "com/de/", "block"), ("x.com", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("b.org", "", None, "allow"), ("b.org", "", None, "allow"), ("É.com", "/de/", "com/de/", "block"),
    ]
    assert [got[k] for k in range(len(urls))] == want


def test_host_reputation_shrinks_and_blocks(spark):
    rows, k = [], 0
    for host, n, bad in (("good.a.net", 200, 4), ("evil.a.net", 200, 190), ("tiny.a.net", 1, 1), ("b.net", 100, 3)):
        for i in range(n):
            rows.append((k, f"http://{host}/{i}", int(i < bad)))
            k += 1
    df = spark.createDataFrame([*rows, (k, "http://new.a.net/", None)], "page_id long, url string, bad int")
    got = {r["host"]: r for r in url_filter.judge_urls(df.drop("bad"), df.select("page_id", "bad")).collect()}
    assert got["evil.a.net"]["verdict"] == "block" and got["good.a.net"]["verdict"] == got["tiny.a.net"]["verdict"] == got["new.a.net"]["verdict"] == "allow"
    assert got["good.a.net"]["bad_rate"] < got["new.a.net"]["bad_rate"] < got["tiny.a.net"]["bad_rate"] < 1
    assert url_filter.judge_urls(df.drop("bad").limit(0), df.select("page_id", "bad")).collect() == []


def test_hot_hosts_and_others_are_judged_alike(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(k, f"http://{'hot.big.com' if k % 3 == 0 else f'h{rng.randrange(40)}.d{rng.randrange(6)}.com'}/p{k}", int(rng.random() < 0.3)) for k in range(600)] + [(None, "http://hot.big.com/", 1), (5, "http://hot.big.com/", 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, bad int")
    labels = df.select("page_id", "bad")
    found = []
    for hot in (1 / 2000, 0.05, 1.0):  # all, some and no keys are hot
        monkeypatch.setattr(url_filter, "HOT", hot)
        found.append(sorted(map(repr, ((r["page_id"], r["host"], r["path"], r["verdict"], round(r["bad_rate"], 9)) for r in url_filter.judge_urls(df.drop("bad"), labels).collect()))))
    assert found[0] == found[1] == found[2] and len(found[0]) == len(rows)


# ---- 4


def brute_sets(text: str | None) -> set:
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows, percent):
    sets = [(i, brute_sets(t)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, (i, x) in enumerate(sets):
        for j, y in sets[a + 1 :]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                lo, hi = sorted((root(i), root(j)))
                parent[hi] = lo
    return {i: (len(x), root(i), root(i) == i) for i, x in sets}


@pytest.mark.parametrize("percent", [85, 80])
def test_near_duplicates(spark, percent):
    rng = random.Random(percent)
    rows = list(edge.texts())
    base = [f"t{rng.randrange(400)}" for _ in range(150)]
    for k in range(120):  # a family of which some link to the base only through others
        w = list(base)
        for _ in range(rng.randrange(0, 7)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
        rows.append((1000 + k, " ".join(w)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(edge.frame(spark, rows), percent).collect()}
    assert got == brute_components(rows, percent)


def test_near_duplicates_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "CHUNK", 8)
    monkeypatch.setattr(near_dedup, "FAN", 5)
    monkeypatch.setattr(near_dedup, "SEND_ROWS", 3)
    test_near_duplicates(spark, 85)


def test_near_duplicates_nulls_and_empty(spark):
    out = near_dedup.near_duplicates(edge.with_nulls(spark), 85).collect()
    assert len(out) == edge.with_nulls(spark).count()
    assert all(r["kept"] and r["component_id"] is None for r in out if r["doc_id"] is None)
    assert near_dedup.near_duplicates(edge.empty(spark), 85).collect() == []


def test_near_duplicates_with_rows_of_one_id(spark):
    texts = {k: edge.prose(random.Random(k), 60) for k in range(4)}
    rows = [(1, texts[0]), (1, texts[1]), (2, min(texts[0], texts[1])), (3, texts[2]), (3, None), (4, texts[3]), (None, texts[3]), (None, texts[3])]
    out = near_dedup.near_duplicates(edge.frame(spark, rows), 85).collect()
    want = brute_components([(1, min(texts[0], texts[1])), (2, min(texts[0], texts[1])), (3, texts[2]), (4, texts[3])], 85)
    assert len(out) == len(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in out if r["doc_id"] is not None} == want
    assert sum(r["doc_id"] is None and r["kept"] for r in out) == 2


def test_registers_estimate_similarity():
    rng = np.random.default_rng(4)
    for share in (0.2, 0.5, 0.9):
        pool = np.unique(rng.integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
        n = int(2000 * (1 + share) / 2 / share) if share > 0.4 else 2000
        both = int(2 * n * share / (1 + share))
        a, b = np.sort(pool[:n]), np.sort(np.r_[pool[:both], pool[n : 2 * n - both]])
        got = near_dedup.estimates(near_dedup.registers(a)[None], near_dedup.registers(b)[None], np.array([len(a)]), np.array([len(b)]))[0]
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs(got - true) < 0.15


def test_components(spark):
    rng = random.Random(9)
    edges = [(k, k + 1) for k in range(60)] + [(500, 500 + k) for k in range(1, 40)] + [(rng.randrange(900, 990), rng.randrange(900, 990)) for _ in range(60)]
    edges = [(a, b) for a, b in edges if a != b]
    parent = {x: x for e in edges for x in e}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        lo, hi = sorted((root(a), root(b)))
        parent[hi] = lo
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


# ---- 5


def brute_cut(rows):
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        raw = (text or "").encode()
        covered = bytearray(len(raw))
        for p in range(len(raw) - 99):
            w = raw[p : p + 100]
            if w in seen:
                covered[p : p + 100] = b"\1" * 100
            seen.add(w)
        spans = [m.span() for m in re.finditer(b"\1+", bytes(covered))]
        out[i] = (len(raw), spans, bytes(c for c, f in zip(raw, covered, strict=True) if not f))
    return out


def test_substring_dedup(spark):
    rng = random.Random(8)
    passage = edge.prose(rng, 60)
    rows = [*edge.texts(), *((200 + k, edge.prose(rng, 20) + passage + edge.prose(rng, 20)) for k in range(8)), (300, "For " * 300), (301, "or For " * 100)]
    got = {r["doc_id"]: (r["n_bytes"], [(s["s"], s["e"]) for s in r["spans"]], bytes(r["kept"])) for r in suffix_dedup.substring_dedup(edge.frame(spark, rows)).collect()}
    assert got == brute_cut(rows)


def test_substring_dedup_in_small_runs(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HELD", 7)
    test_substring_dedup(spark)


def test_substring_dedup_nulls_and_empty(spark):
    assert suffix_dedup.substring_dedup(edge.with_nulls(spark)).count() == edge.with_nulls(spark).count()
    assert suffix_dedup.substring_dedup(edge.empty(spark)).collect() == []


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.binary(max_size=9).map(lambda b: bytes(x & 1 for x in b)), max_size=30), max_size=6))
def test_loser_tree_merges_with_prefix_lengths(lists):
    runs = [sorted(x) for x in lists] or [[]]
    coded = [suffix_dedup.front_coded(r) for r in runs]
    assert [suffix_dedup.decoded(*c) for c in coded] == runs
    run, index, known = suffix_dedup.merge_runs([(r, c[0].tolist()) for r, c in zip(runs, coded, strict=True)])
    merged = [runs[a][b] for a, b in zip(run, index, strict=True)]
    assert merged == sorted(x for r in runs for x in r)
    assert all(known[i] == suffix_dedup.shared_from(merged[i - 1], merged[i], 0) for i in range(1, len(merged)))


# ---- 6


@pytest.fixture(scope="module")
def coders():
    own = bpe.BytePairs.from_file(RANKS, P.PATTERN)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return own, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from([*"abcdeéßñ '’\n\t 0129.,;!?sdmtrevl\x1c\x85\u00a0中文\U0001F600\u0301²½Ⅷ"]) | st.characters(blacklist_categories=["Cs"]), max_size=60))
def test_bpe_equals_the_library(coders, text):
    own, library = coders
    ids = own.encode(text)
    assert ids.tolist() == library.encode_ordinary(text) and own.decode(ids) == text.encode()


def test_bpe_of_very_long_pre_tokens(coders):
    own, library = coders
    rng = random.Random(1)
    for text in ("a" * 20_000, "ab" * 8000, "".join(rng.choice("abcdefgh") for _ in range(30_000))):
        assert own.encode(text).tolist() == library.encode_ordinary(text)


def test_bpe_over_tables(spark, coders):
    df = edge.with_nulls(spark)
    got = bpe.encode_documents(df, RANKS, P.PATTERN)
    assert [c for c in got.columns if c != "ids"] == [c for c in df.columns if c != "ids"]
    for r in bpe.decode_documents(got, RANKS, P.PATTERN).collect():
        assert bytes(r["decoded"]) == (r["text"] or "").encode()
    for r in bpe.encode_digests(edge.frame(spark), RANKS, P.PATTERN).collect():
        text = dict(edge.texts())[r["doc_id"]] or ""
        ids = coders[1].encode_ordinary(text)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(text))
    assert bpe.encode_digests(edge.empty(spark), RANKS, P.PATTERN).collect() == []


# ---- 7


def test_toxicity_generalises_to_misspellings():
    rng = random.Random(6)
    bad = ["stupid", "idiot", "worthless", "pathetic"]

    def text(toxic: int, words: list[str]) -> str:
        w = [rng.choice(edge.WORDS[:8]) + rng.choice(["a", "en", "ly"]) for _ in range(rng.randrange(20, 80))]
        for _ in range(4 * toxic):
            w.insert(rng.randrange(len(w)), rng.choice(words))
        return " ".join(w)

    labels = np.array([k % 2 for k in range(400)])
    model = toxicity.SubwordSoftmax().fit([text(int(y), bad) for y in labels], labels)

    def score(texts):
        data = "".join(texts).encode()
        return model.score(np.frombuffer(data, np.uint8), np.r_[0, np.cumsum([len(t.encode()) for t in texts])])

    clean, unseen = score([text(0, bad) for _ in range(60)]), score([text(1, ["stuupid", "idiotic", "worthles", "pathetik"]) for _ in range(60)])
    assert (clean < 0.5).mean() > 0.95 and (unseen >= 0.5).mean() > 0.8
    assert toxicity.SubwordSoftmax().fit([], np.array([], int)).bias < -10


def test_toxicity_over_tables(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1), (19, 0), (8, 1)], "doc_id long, toxic int").withColumn("text", F.lit("clash"))
    df = edge.with_nulls(spark)
    model = toxicity.fit_toxicity(df, labels)
    out = toxicity.score_toxicity(df, model).collect()
    assert len(out) == df.count() and all(0 <= r["score"] <= 1 for r in out)
    assert toxicity.score_toxicity(edge.empty(spark), toxicity.fit_toxicity(edge.empty(spark), labels.limit(0))).collect() == []


def naive_score(model, text: str) -> float:
    """Feature by feature: words and n-grams of letters with a mark at both ends."""
    low = (text or "").encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256)))
    found = []
    for word in re.findall(rb"[a-z\x80-\xff]+", low):
        marked = b" " + word + b" "
        found += [(marked[k : k + n], False) for n in (3, 4, 5) for k in range(len(marked) - n + 1)] + [(word, True)]
    total = 0.0
    for gram, whole in found:
        h = textblocks.span_hashes(textblocks.wide(np.frombuffer(gram, np.uint8)), np.array([0]), np.array([len(gram)]))
        total += float(model.weights[int((textblocks.mixed(h) if whole else h)[0]) % toxicity.BUCKETS])
    return 1 / (1 + np.exp(-np.clip(total / (len(found) + toxicity.PRIOR) + model.bias, -40, 40)))


def test_toxicity_scores_are_the_naive_ones(spark):
    rng = np.random.default_rng(2)
    model = toxicity.SubwordSoftmax(rng.normal(size=toxicity.BUCKETS).astype(np.float32) * 20, -0.3)
    rows = [*edge.texts(), (70, "a"), (71, "Aé B1c ÀÀ"), (72, "tail of one textA"), (73, "Bhead of the next")]
    for r in toxicity.score_toxicity(edge.frame(spark, rows), model, "p").collect():
        assert abs(r["p"] - naive_score(model, r["text"])) < 1e-5, r["doc_id"]
        if not r["text"]:
            assert abs(r["p"] - 1 / (1 + np.exp(0.3))) < 1e-9


def test_toxicity_sample_is_bounded(spark, monkeypatch):
    rows = [(k, f"text {k} " + "x" * 91) for k in range(100, 160)] + [(101, "another of the same id")] * 50
    labels = spark.createDataFrame([(k, k % 2) for k in range(100, 160)] * 2, "doc_id long, toxic int")
    everything = toxicity.training_texts(edge.frame(spark, rows), labels).collect()
    learned = [k for k in range(100, 160) if zlib.crc32(str(k).encode()) % 5]
    assert sorted(r["i"] for r in everything) == learned
    assert {r["text"] for r in everything if r["i"] == 101} <= {min("another of the same id", rows[1][1])}
    monkeypatch.setattr(toxicity, "MOST_BYTES", 1000)
    few = toxicity.training_texts(edge.frame(spark, rows), labels).collect()
    assert 0 < sum(len(r["text"]) for r in few) <= 1000 and {r["i"] for r in few} < set(learned)


# ---- 8


def brute_hits(text, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    w = words(text)
    hit, found = set(), set()
    for i, t in items:
        v = words(t)
        windows = {tuple(v[k : k + 10]) for k in range(len(v) - 9)} if len(v) >= 10 else ({tuple(v)} if v else set())
        for x in windows:
            for p in range(len(w) - len(x) + 1):
                if tuple(w[p : p + len(x)]) == x:
                    hit |= set(range(p, p + len(x)))
                    found |= {str(i)} if i is not None else set()
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("block_words", [500_000, 30])
def test_decontamination(spark, monkeypatch, block_words):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block_words)
    rng = random.Random(12)
    items = [(k, edge.prose(rng, rng.choice([1, 2, 5, 9, 10, 11, 25]))) for k in range(25)] + [(90, None), (91, "!!"), (None, edge.prose(rng, 12)), (2, edge.prose(rng, 15))]
    rows = [*edge.texts(), *((500 + k, edge.prose(rng, 8) + " " + (items[k % 25][1] or "") + " " + edge.prose(rng, 8)) for k in range(40))]
    bench = spark.createDataFrame([(i, t, 1, []) for i, t in items], "item_id long, text string, n_words int, items array<int>")
    got = {r["doc_id"]: (r["n_words"], sum(s["words"] for s in r["spans"]), list(r["items"])) for r in decontaminate.decontaminate(edge.frame(spark, rows), bench).collect()}
    assert got == {i: brute_hits(t, items) for i, t in rows}


def test_decontamination_nulls_and_empty(spark):
    bench = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    assert decontaminate.decontaminate(edge.with_nulls(spark), bench).where("size(spans) > 0").count() == 5
    assert decontaminate.decontaminate(edge.frame(spark), bench.limit(0)).where("size(spans) > 0").count() == 0
    assert decontaminate.decontaminate(edge.empty(spark), bench).collect() == []


def test_decontamination_of_repeated_rows_by_joins(spark, monkeypatch):
    bench = spark.createDataFrame([(k, f"{a} two") for k, a in enumerate(("one", "other", "one"))] + [(9, "short")], "item_id long, text string")
    whole = decontaminate.decontaminate(edge.with_nulls(spark), bench).collect()
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 1)
    assert sorted(map(repr, decontaminate.decontaminate(edge.with_nulls(spark).repartition(5), bench).collect())) == sorted(map(repr, whole))
    assert len(whole) == edge.with_nulls(spark).count()


def test_decontamination_by_joins_reads_documents_once(spark, monkeypatch):
    rng = random.Random(13)
    passage = edge.prose(rng, 30)
    rows = [(k, edge.prose(rng, 20) + " " + (passage if k % 3 == 0 else "") + " " + edge.prose(rng, 20)) for k in range(120)]
    bench = spark.createDataFrame([(k, passage) for k in range(4)] + [(9, "light idiot river"), (10, "stone")] + [(100 + k, edge.prose(rng, 15)) for k in range(50)], "item_id long, text string")
    sent = sorted(map(repr, decontaminate.decontaminate(edge.frame(spark, rows), bench).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 10)
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    docs = edge.frame(spark, rows)
    joined = decontaminate.decontaminate(docs.mapInArrow(counted, docs.schema), bench)
    assert sorted(map(repr, joined.collect())) == sent and read.value == len(rows)
    # a full bitmap lets every fingerprint through: the joins alone decide
    monkeypatch.setattr(decontaminate, "MAP_BITS", 15)
    assert sorted(map(repr, decontaminate.decontaminate(edge.frame(spark, rows), bench).collect())) == sent


# ---- 9


def brute_lines(rows):
    key = lambda s: s.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    holders = defaultdict(set)
    for i, t in rows:
        for s in (t or "").split("\n"):
            holders[key(s)].add(i)
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [s for s in lines if not (len(key(s)) >= 20 and len(holders[key(s)]) >= 3 and max(holders[key(s)]) != i)]
        out[i] = ("\n".join(kept), len(lines), len(lines) - len(kept))
    return out


def test_line_dedup(spark):
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in line_dedup.line_dedup(edge.frame(spark)).collect()}
    assert got == brute_lines(edge.texts())
    assert got[11][2] == 2 and got[13][2] == 0


def test_line_dedup_nulls_and_empty(spark):
    got = line_dedup.line_dedup(edge.with_nulls(spark), carry=True).select("doc_id", "text", "n_lines", "n_dropped").collect()
    want = brute_lines(edge.texts())
    assert sorted(map(repr, got)) == sorted(map(repr, [Row(doc_id=i, text=t, n_lines=n, n_dropped=d) for i, (t, n, d) in [*want.items(), (None, ("one two", 1, 0)), (None, ("", 1, 0)), (8, ("one two", 1, 0))]]))
    assert line_dedup.line_dedup(edge.empty(spark)).collect() == []


def test_line_dedup_counts_rows_of_one_id_once(spark):
    two, three, of_null = ("a line that stands in two documents", "a line that stands in three documents", "a line of rows without an id and one more")
    rows = [(8, two), (8, two), (9, two), (20, three), (20, f"{three}\nand more"), (21, three), (22, three), (None, of_null), (None, of_null), (30, of_null)]
    key = lambda r: (str(r[0]), r[1])
    got = sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in line_dedup.line_dedup(edge.frame(spark, rows)).collect()), key=key)
    holders = defaultdict(set)
    for i, t in rows:
        for s in t.split("\n"):
            holders[s].add(i)
    want = []
    for i, t in rows:
        kept = [s for s in t.split("\n") if len(s) < 20 or len(holders[s]) < 3 or max(x for x in holders[s] if x is not None) == i]
        want.append((i, "\n".join(kept), t.count("\n") + 1, t.count("\n") + 1 - len(kept)))
    assert got == sorted(want, key=key) and sum(w[3] for w in want) == 3


def lines_of_one_hash() -> tuple[str, str]:
    """Two lines of 24 bytes with the same xxhash64 under Spark's seed: the last 8 bytes make up for the others."""
    p1, p2, p4, p5, full = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5, (1 << 64) - 1
    turn = lambda x, n: (x << n | x >> (64 - n)) & full
    mix = lambda x: turn(x * p2 & full, 31) * p1 & full
    undo = lambda y: turn(y * pow(p1, -1, 1 << 64) & full, 33) * pow(p2, -1, 1 << 64) & full

    def state(head: bytes) -> int:
        h = 42 + p5 + 24
        for k in (0, 8):
            h = (turn((h ^ mix(int.from_bytes(head[k : k + 8], "little"))) & full, 27) * p1 + p4) & full
        return h

    first, k = b"the first line of twenty", 0
    while True:
        head = b"the other %06d" % k
        last = undo(state(first[:16]) ^ state(head.ljust(16, b"-")) ^ mix(int.from_bytes(first[16:], "little"))).to_bytes(8, "little")
        if all(32 < c < 127 and not 65 <= c <= 90 for c in last):
            return first.decode(), (head.ljust(16, b"-") + last).decode()
        k += 1


def test_line_dedup_tells_lines_of_one_hash_apart(spark):
    one, other = lines_of_one_hash()
    a, b = spark.createDataFrame([(one,), (other,)], "t string").select(F.xxhash64("t").alias("h1"), line_dedup.line_hashes(F.col("t"), 20)[0]["h2"].alias("h2")).collect()
    assert a["h1"] == b["h1"] and a["h2"] != b["h2"]
    got = line_dedup.line_dedup(edge.frame(spark, [(1, one), (2, one), (3, other)])).collect()
    assert sum(r["n_dropped"] for r in got) == 0


def test_line_runs_compact_by_levels(spark):
    runs = line_dedup.LineRuns(spark)
    for b in range(9):
        runs.add(spark.createDataFrame([(1, 1, b), (2, b, b)], "h1 long, h2 long, doc_id long"))
    assert [len(x) for x in runs.levels] == [1, 2]
    totals = {(r["h1"], r["h2"]): (r["n_docs"], r["max_doc"]) for r in runs.totals().collect()}
    assert totals == {(1, 1): (9, 8)} | {(2, b): (1, b) for b in range(9)}


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_line_runs_have_a_file_a_bucket_and_merge_without_a_shuffle(spark):
    runs = line_dedup.LineRuns(spark, fan_out=2)
    batch = lambda b: spark.range(2000).repartition(3).select(F.col("id").alias("h1"), (F.col("id") % (b + 2)).alias("h2"), F.lit(b).cast("long").alias("doc_id"))
    for b in range(5):
        runs.add(batch(b))
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    for name in (name for level in runs.levels for name in level):
        assert len(spark.table(name).inputFiles()) == runs.buckets
    assert exchanges(runs._merged([runs.levels[0][0], runs.levels[2][0]])) == 0
    keys = spark.table(runs.levels[0][0])
    assert exchanges(runs.met(keys)) == 0
    got = {(r["h1"], r["h2"]): (r["n_docs"], r["max_doc"]) for r in runs.totals().collect()}
    want = defaultdict(list)
    for b in range(5):
        for k in range(2000):
            want[k, k % (b + 2)].append(b)
    assert runs.totals().count() == len(got) and got == {k: (len(v), max(v)) for k, v in want.items()}
    runs.forget()
    assert runs.made == [] and not line_dedup._exists(spark, runs.path)


def test_line_dedup_leaves_no_tables_when_a_step_fails(spark, monkeypatch):
    def broken(self):
        raise RuntimeError("lost")

    before = {t.name for t in spark.catalog.listTables()}
    monkeypatch.setattr(line_dedup.LineRuns, "compact", broken)
    with pytest.raises(RuntimeError, match="lost"):
        line_dedup.line_dedup(edge.frame(spark))
    assert {t.name for t in spark.catalog.listTables()} == before


# ---- 10


def brute_search(rows, queries, k):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    docs = [(i, words(t)) for i, t in rows]
    average, df = sum(len(w) for _, w in docs) / len(docs), defaultdict(int)
    for _, w in docs:
        for t in set(w):
            df[t] += 1
    out = []
    for q, t in queries:
        scored = []
        for i, w in docs:
            points = 0
            for term in set(words(t)) & set(w):
                tf, idf = w.count(term), np.log1p((len(docs) - df[term] + 0.5) / (df[term] + 0.5))
                points += round(idf * tf * (search.K1 + 1) / (tf + search.K1 * (1 - search.B + search.B * len(w) / average)) * search.UNIT)
            if points > 0:
                scored.append((-points, i))
        out += [(q, r + 1, i, -p / search.UNIT) for r, (p, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


@pytest.mark.parametrize(("shard", "terms"), [(8192, 4_000_000), (7, 20)])
def test_top_k(spark, monkeypatch, shard, terms):
    monkeypatch.setattr(search, "SHARD_DOCS", shard)
    monkeypatch.setattr(search, "BLOCK_TERMS", terms)
    rng = random.Random(13)
    rows = [*edge.texts(), *((600 + k, edge.prose(rng, rng.randrange(1, 60))) for k in range(80))]
    queries = [(i, t) for i, t in rows if i % 20 == 0 or i in (5, 6, 8)]
    got = search.top_k(edge.frame(spark, rows), spark.createDataFrame([(i, t, 1) for i, t in queries], "query_id long, text string, rank int"), 4).collect()
    assert sorted(map(tuple, got)) == brute_search(rows, queries, 4)


def test_top_k_rounds(spark, monkeypatch):
    """Few shards are one round; floors of earlier rounds lose nothing; the setting of the tasks' size is put back."""
    rng = random.Random(31)
    rows = [(k, edge.prose(rng, rng.randrange(1, 60))) for k in range(400)] + [(400 + k, edge.prose(random.Random(k % 3), 30)) for k in range(60)]
    queries, tags = [(i, t) for i, t in rows if i % 20 == 0], []
    monkeypatch.setattr(search, "written", lambda df, tag, written=search.written: tags.append(tag) or written(df, tag))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    want, asked = brute_search(rows, queries, 4), spark.createDataFrame(queries, "query_id long, text string")
    assert sorted(map(tuple, search.top_k(edge.frame(spark, rows).repartition(4), asked, 4).collect())) == want
    assert tags.count("found") == 1
    for name, value in {"GROWTH": 2, "SHARD_DOCS": 7, "STRIDE": 2, "AT_ONCE": 5, "MOST_USED": 1 / 4}.items():
        monkeypatch.setattr(search, name, value)
    assert sorted(map(tuple, search.top_k(edge.frame(spark, rows).repartition(9), asked, 4).collect())) == want
    assert tags.count("found") == 5  # 2, 2, 4 shards and the ninth
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before


def test_shard_keeps_walked_lists_apart():
    """Entries of long lists stand in the dense rows only; the k best above a floor, and without one, are exact."""
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in rng.zipf(1.3, 40) if x < 5000) for _ in range(600)]
    batch = pa.record_batch({"doc_id": pa.array(range(600), pa.int64()), "text": pa.array(texts)})
    [packed] = [b.column(3)[0].as_py() for b in search._shards(iter([batch]))]
    _, _, terms, cuts, _, _ = search._unpacked(packed)
    df = np.diff(cuts)
    block = search.QueryBlock([(1, terms.tobytes(), np.log1p((600 - df + 0.5) / (df + 0.5)).tobytes())], 10, 40.0)
    shard = search.Shard(packed, block)
    assert len(shard.doc) == len(shard.add) == df[df < search.LONG * 600].sum() and len(shard.dense) == (df >= search.LONG * 600).sum()
    queries = [np.sort(rng.choice(len(terms), 30, replace=False)).astype(np.int32) for _ in range(20)]
    whole = [shard._walked(q[shard.row[q] < 0]) + shard.dense[shard.row[q][shard.row[q] >= 0]].sum(axis=0, dtype=np.float64) for q in queries]
    for floors in (np.zeros(20), np.array([np.sort(w)[-3] for w in whole])):
        for w, f, (found, score) in zip(whole, floors, shard.top(queries, 10, floors), strict=True):
            least = max(f, 1.0, np.sort(w)[-10])
            order = np.lexsort((shard.ids, -w[:600]))
            assert found.tolist() == [d for d in order if w[d] >= least][:10] and np.array_equal(score, w[found])


def test_top_k_nulls_and_empty(spark):
    queries = spark.createDataFrame([(1, "one"), (None, "one"), (3, None), (4, "absentword")], "query_id long, text string")
    assert [tuple(r)[:3] for r in search.top_k(edge.with_nulls(spark), queries, 1).collect()] == [(1, 1, None)]
    assert search.top_k(edge.empty(spark), queries).collect() == [] and search.top_k(edge.frame(spark), queries.limit(0)).collect() == []
