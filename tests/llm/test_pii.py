"""The whole decision of op1 in plain Python, time on texts without cuts, and values for nulls and empties."""

import re
import time
from collections import Counter

import regex

from sitelark.llm import pii

from . import edge
from .test_operators import brute_pii


def found_in(text: str) -> list[dict]:
    """All candidates of a text, strict forms first, with their votes."""
    out = []
    for loose, patterns in ((False, pii.STRICT), (True, pii.LOOSE)):
        for kind, pattern in patterns.items():
            for m in regex.finditer(pattern, text):
                k, t = pii.KINDS.index(kind), m[0]
                n = len(re.sub("[^0-9]", "", t))
                if (k == 2 and not 12 <= n <= 19) or (k == 3 and not 7 <= n <= 16) or (k == 1 and len(t) > 23):
                    continue
                out.append({"kind": k, "loose": loose, "s": m.start(), "e": m.end(), "t": t, "before": text[max(0, m.start() - pii.REACH) : m.start()], "after": text[m.end() : m.end() + 1]})
    return out


def votes(c: dict, ok: bool) -> tuple[tuple[int, ...], int]:
    t, k = c["t"], c["kind"]
    form = (
        r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9].*",
        r"([1-9]?[0-9]{1,2}\.){3}[0-9]{1,3}",
        r"[0-9]{13,16}|[0-9]{4}([ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}",
        r"\+[0-9]{1,3}[ .-]?(\([0-9]+\)|[0-9])[0-9 .-]+",
    )[k]
    a = 0 if c["loose"] else 1 if re.fullmatch(form, t) else -1
    b = 1 if ok else 0 if c["loose"] or k == 0 else -1
    if k == 0:
        g = 1 if (re.search(r"[A-Za-z0-9-]+$", t) or [""])[0].lower() in pii.TOP_DOMAINS else -1
    elif k == 1:
        g = 1 if 0 < int(t.split(".")[0]) < 224 else -1
    elif k == 2:
        g = 1 if t[0] in "3456" else -1
    else:
        code = (re.match(r"\+([0-9]{1,2})", t) or ["", ""])[1]
        g = 0 if c["loose"] else 1 if code in pii.CALLING_CODES or code[:1] in pii.CALLING_CODES else -1
    before = c["before"].lower()
    d = 1 if re.search(pii.CUES[pii.KINDS[k]], before) else -1 if re.search(pii.COUNTER_CUES, before) else 0
    e = -1 if re.search("[A-Za-z0-9]$", c["before"]) or re.match("[A-Za-z0-9]", c["after"]) else 1
    marks = re.sub("[A-Za-z0-9]", "", t)
    shape = 3 * (0 if len(t) < 12 else 1 if len(t) < 24 else 2) + (0 if not marks else 1 if len(set(marks)) == 1 and len(re.sub(r"(.)\1+", r"\1", marks)) == 1 else 2)
    return (a, b, g, d, e), shape


def plain_spans(texts: list[str]) -> list[tuple[list, list]]:
    """base and spans of each text: plain candidates and votes, the operator's own estimation on their counts, and a quadratic settling."""
    every, counts = [], Counter()
    for text in texts:
        base = set(brute_pii(text))
        cands = []
        for c in found_in(text):
            key = (c["s"], c["kind"], c["e"])
            ok = not c["loose"] and key in base
            v, shape = votes(c, ok)
            counts[c["kind"], v, shape] += 1
            cands.append((key, ok, v, shape))
        every.append((base, cands))
    patterns = sorted((*key, n) for key, n in counts.items())
    weights = pii.train_classifier(patterns, pii.estimate(patterns))
    out = []
    for base, cands in every:
        extra = sorted({key for key, ok, v, shape in cands if not ok and sum(weights[i] for i in pii._features(key[1], v, shape)) >= 0})
        touch = lambda x, y: x[1] == y[1] and x[0] < y[2] and y[0] < x[2]
        free = [x for k, x in enumerate(extra) if not any(touch(x, y) for y in base) and not any(touch(x, y) for y in extra[:k])]
        out.append((sorted(base), sorted([*base, *free])))
    return out


def decided(spark, texts):
    rows = pii.find_personal_data(edge.frame(spark, list(enumerate(texts)))).collect()
    got = {r["doc_id"]: ([tuple(s) for s in r["base"]], [tuple(s) for s in r["spans"]]) for r in rows}
    return [got[k] for k in range(len(texts))]


def test_spans_equal_a_plain_version(spark):
    texts = [t or "" for _, t in edge.texts()]
    texts += [r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    texts += [f"mail u{k} [at] host{k % 7} [dot] com, u{k} (at) h.org. call 389-555-{1000 + k} or (389) 555-{2000 + k} now, card {4 * 10**15 + k}, ip 1.2.{k}.{k % 300}" for k in range(200)]
    texts += [". ".join(f"4111 1111 1111 {1000 + (j * k) % 9000}.1.2.{j % 400} call 389-555-{1000 + j}" for j in range(k)) for k in (50, 400)]
    want = plain_spans(texts)
    assert sum(len(s) - len(b) for b, s in want) > 100
    assert decided(spark, texts) == want


NUMBERS = [4 * 10**15 + 37 * k for k in range(12_000)]
#: Texts without a cut and, where plain patterns would take the square of their length, their base spans.
LONG = {
    "addresses": (" ".join(f"10.{k % 256}.{k // 7 % 300}.{k % 99}" for k in range(16_000)), None),
    "cards": (" ".join(map(str, NUMBERS)), []),
    "cards in dots": (".".join(map(str, NUMBERS)), [(17 * k, 2, 17 * k + 16) for k, n in enumerate(NUMBERS) if brute_pii(str(n))]),
    "mails": (" ".join(f"a{k}@b{k}.c{k % 10}" for k in range(12_000)), None),
    "digits": ("1234567890" * 100_000, []),
    "one part": ("1." * 100_000, [(8 * k, 1, 8 * k + 7) for k in range(25_000)]),
    "phones": (" ".join(f"+1 389 555 {1000 + k % 9000}" for k in range(12_000)), None),
    "loose phones": ("; ".join(f"389-555-{1000 + k % 9000}" for k in range(12_000)), None),
}


def test_long_texts_without_cuts_take_seconds(spark):
    """Some 200 kB each (digits: 1 MB): where time grew with the square of the matches, one of them took minutes."""
    names = sorted(LONG)
    began = time.monotonic()
    got = decided(spark, [LONG[n][0] for n in names])
    took = time.monotonic() - began
    for name, (base, _) in zip(names, got, strict=True):
        text, want = LONG[name]
        assert base == (brute_pii(text) if want is None else want), name
    assert took < 120, took


def test_nulls_and_empties_have_no_spans(spark):
    got = Counter((r["doc_id"], len(r["base"]), len(r["spans"])) for r in pii.find_personal_data(edge.with_nulls(spark)).collect())
    want = Counter((i, len(brute_pii(t or ""))) for i, t in [*edge.texts(), (None, "one two"), (None, None), (8, "one two")])
    assert Counter({(i, b): n for (i, b, _), n in got.items()}) == want
    assert all(s == b for (i, b, s) in got if i in (None, 5, 6, 7, 8))
    assert pii.find_personal_data(edge.empty(spark)).collect() == []
