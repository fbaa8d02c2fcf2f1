"""Personal data by weak supervision (DataFrame operations only).

Texts are cut into segments where no span can cross, and patterns give candidate spans of four kinds in each: what a strict pattern
matches, whether or not it passes its test, and looser forms. Labelers vote on each (1 for, -1 against, 0 abstains): the form, the test,
gazetteers (top-level domains, calling codes, issuer digits, address ranges), cue words before the span, and the
characters at its edges. Expectation-maximisation over the counts of vote patterns (at most ``4 * 3**5 * 9`` rows, whatever
the input) estimates how reliable each labeler is; a logistic span classifier of votes and shape is then trained on the posteriors and decides on
all candidates that did not pass a strict test. Those that did always stay.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import written

KINDS = ("email", "ip", "card", "phone")
#: Strict patterns, with possessive loops so that no text makes them slow or deep. ``\\G`` lets a match start where the last one
#: ended, as a plain scan would; elsewhere one starts at the first character of a run only, since no later start in the
#: run can succeed where the first fails.
STRICT = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Loose patterns of the same kinds, for the classifier.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[\[(]at[\])] ?[A-Za-z0-9-]{1,63}(?: ?(?:[\[(]dot[\])]|\.) ?[A-Za-z0-9-]{1,63})++",
    "phone": r"(?<![0-9+.() -])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
}
#: A part up to 255 with any zeros before it, which may be all of it.
OCTET = "(?=[0-9])0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]?)?"
#: Fixed values of the labelers.
TOP_DOMAINS = ("com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "it", "uk", "eu", "us", "ca", "jp", "cn", "in", "br", "ru")
CALLING_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "39", "41", "44", "45", "46", "47", "48", "49", "52", "55", "61", "81", "82", "86", "91")
CUES = {"email": "mail|contact|write|reach", "ip": r"\bip\b|host|server|address|login", "card": "card|visa|credit|payment|account", "phone": r"phone|call|tel|mobile|fax|\bcell"}
COUNTER_CUES = "version|isbn|order|invoice|serial|sha|figure|section"
#: Code points before a span in which cues are sought; code points from which a segment may end.
REACH, SEGMENT = 32, 2048
LABELERS = ("form", "test", "gazetteer", "context", "edges")
#: A segment ends before a character that no pattern has, or after a letter or digit before a space where only a letter or (after a letter) a digit
#: follows: no pattern goes from a letter on over a space, nor from a digit over a space to a letter.
CUT = r"(?s).{%d,}?(?:(?=[^A-Za-z0-9._%%+@ ()\[\]-])|(?<=[A-Za-z0-9])(?= [A-Za-z])|(?<=[A-Za-z])(?= [0-9]))|(?s).+" % SEGMENT
#: Matches whose positions are summed up one after the other; those of more are summed up block by block, so that time stays linear.
BLOCK = 64
CANDIDATE = "array<struct<kind:int,loose:boolean,s:int,e:int,t:string,before:string,after:string>>"


def _spans(name: str, kind: str, pattern: str, gate: Column, loose: bool) -> list[tuple[str, Column]]:
    """Columns, one built on the other, that end in ``name``: the matches of a pattern in a segment, with positions in code points of the text."""
    text, m, g = F.col("segment"), f"{name}_m", f"{name}_g"
    n = F.size(m)
    piece = F.transform(
        F.arrays_zip(F.col(m).alias("t"), F.slice(F.col(g), 1, n).alias("l"), F.slice(F.col(g), 2, n).alias("r")),
        lambda x, i: F.struct(F.length(x["l"]).alias("gap"), x["t"].alias("t"), F.right(F.when(i == 0, F.concat(F.col("lead"), x["l"])).otherwise(x["l"]), F.lit(REACH)).alias("before"), F.left(x["r"], F.lit(1)).alias("after")),
    )
    size = lambda x: x["gap"] + F.length(x["t"])

    def span(at: Column, x: Column) -> Column:
        return F.struct(F.lit(KINDS.index(kind)).alias("kind"), F.lit(loose).alias("loose"), (at + x["gap"]).alias("s"), (at + size(x)).alias("e"), x["t"], x["before"], x["after"])

    def blocks(p: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / BLOCK).cast("int")), lambda b: F.slice(p, b * BLOCK + 1, BLOCK))

    def starts(b: Column) -> Column:
        sizes = F.transform(b, lambda x: F.aggregate(x, F.lit(0), lambda a, y: a + size(y)))
        return F.aggregate(sizes, F.struct(F.col("offset").alias("at"), F.array().cast("array<int>").alias("out")), lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")))["out"]

    within = lambda block, at: F.aggregate(
        block,
        F.struct(at.alias("at"), F.array().cast(CANDIDATE).alias("out")),
        lambda a, x: F.struct((a["at"] + size(x)).alias("at"), F.concat(a["out"], F.array(span(a["at"], x))).alias("out")),
    )["out"]
    placed = _let(piece, lambda p: _let(blocks(p), lambda b: F.flatten(F.zip_with(b, starts(b), within))))
    return [
        (m, F.when(gate, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))),
        (g, F.when(F.size(m) > 0, F.split(text, pattern, -1))),
        (name, F.when(F.size(m) > 0, placed)),
    ]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once: a column that stands in a lambda would be computed anew for each of its elements."""
    return F.get(F.transform(F.array(value), body), 0)


def segments(docs: DataFrame) -> DataFrame:
    """row, doc_id, n_segments, offset, lead (what stands before the segment) and segment, a row for each segment of each text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    cut = F.when(F.length(text) <= 2 * SEGMENT, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(CUT), F.lit(0)))
    own = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id"), cut.alias("cut")).withColumn("n_segments", F.size("cut"))
    ends = F.aggregate("cut", F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), lambda a, x: F.struct((a["at"] + F.length(x)).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")))["out"]
    begins = F.when(F.col("n_segments") == 1, F.array(F.lit(0))).otherwise(ends)
    leads = F.transform("cut", lambda x, i: F.when(i > 0, F.right(F.get("cut", i - 1), F.lit(REACH))).otherwise(""))
    each = own.select("row", "doc_id", "n_segments", F.explode(F.arrays_zip(begins.alias("offset"), leads.alias("lead"), F.col("cut").alias("segment"))).alias("x"))
    return each.select("row", "doc_id", "n_segments", "x.offset", "x.lead", "x.segment")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    total = F.aggregate(
        F.split(F.reverse(digits), ""),
        F.struct(F.lit(0).alias("sum"), F.lit(0).alias("i")),
        lambda a, d: F.struct((a["sum"] + F.when(a["i"] == 0, d.cast("int")).otherwise((2 * d.cast("int")) % 10 + F.floor(2 * d.cast("int") / 10).cast("int"))).alias("sum"), (1 - a["i"]).alias("i")),
    )
    return total["sum"] % 10 == 0


def _digits(c: Column) -> Column:
    return F.length(F.regexp_replace(c["t"], "[^0-9]", ""))


def valid(c: Column) -> Column:
    """The strict test of a candidate of each kind."""
    n = _digits(c)
    return (
        F.when(c["loose"], F.lit(False))
        .when(c["kind"] == 0, F.lit(True))
        .when(c["kind"] == 1, c["t"].rlike(rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$"))
        .when(c["kind"] == 2, F.when(n.between(12, 19), luhn(F.regexp_replace(c["t"], "[^0-9]", ""))).otherwise(False))
        .otherwise(n.between(9, 15))
    )


def plausible(c: Column) -> Column:
    """Numbers too short or too long for their kind are no candidates at all."""
    n = _digits(c)
    return F.when(c["kind"] == 2, n.between(12, 19)).when(c["kind"] == 3, n.between(7, 16)).when(c["kind"] == 1, F.length(c["t"]) <= 23).otherwise(True)


def _votes(c: Column) -> Column:
    """form, test, gazetteer, context, edges: each -1, 0 or 1; and the shape: a length class and a class of separators."""
    t = c["t"]
    canonical = (
        F.when(c["kind"] == 0, t.rlike(r"^[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9]"))
        .when(c["kind"] == 1, t.rlike(r"^(?:[1-9]?[0-9]{1,2}\.){3}[0-9]{1,3}$"))
        .when(c["kind"] == 2, t.rlike(r"^(?:[0-9]{13,16}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})$"))
        .otherwise(t.rlike(r"^\+[0-9]{1,3}[ .-]?(?:\([0-9]+\)|[0-9])[0-9 .-]+$"))
    )
    form = F.when(c["loose"], 0).when(canonical, 1).otherwise(-1)
    test = F.when(c["ok"], 1).when(c["loose"] | (c["kind"] == 0), 0).otherwise(-1)
    top = F.lower(F.regexp_extract(t, r"([A-Za-z0-9-]+)$", 1))
    code = F.regexp_extract(t, r"^\+([0-9]{1,2})", 1)
    gazetteer = (
        F.when(c["kind"] == 0, F.when(top.isin(*TOP_DOMAINS), 1).otherwise(-1))
        .when(c["kind"] == 1, F.when(t.rlike(r"^0*+(?:[1-9]|[1-9][0-9]|1[0-9][0-9]|2[01][0-9]|22[0-3])\."), 1).otherwise(-1))
        .when(c["kind"] == 2, F.when(t.rlike("^[3-6]"), 1).otherwise(-1))
        .otherwise(F.when(c["loose"], 0).when(code.isin(*CALLING_CODES) | F.left(code, F.lit(1)).isin(*CALLING_CODES), 1).otherwise(-1))
    )
    before = F.lower(c["before"])
    cue = F.lit(None)
    for i, kind in enumerate(KINDS):
        cue = F.when(c["kind"] == i, before.rlike(CUES[kind])).otherwise(cue)
    context = F.when(cue, 1).when(before.rlike(COUNTER_CUES), -1).otherwise(0)
    edges = F.when(F.right(c["before"], F.lit(1)).rlike("[A-Za-z0-9]") | c["after"].rlike("[A-Za-z0-9]"), -1).otherwise(1)
    size = F.length(t)
    marks = F.regexp_replace(t, "[A-Za-z0-9]", "")
    shape = 3 * F.when(size < 12, 0).when(size < 24, 1).otherwise(2) + F.when(marks == "", 0).when(F.length(F.regexp_replace(marks, F.lit(r"(.)\1+"), F.lit("$1"))) == 1, 1).otherwise(2)
    return F.struct(form.alias("form"), test.alias("test"), gazetteer.alias("gazetteer"), context.alias("context"), edges.alias("edges"), shape.alias("shape"))


def candidates(docs: DataFrame) -> DataFrame:
    """row, doc_id, n_segments and cands: all candidate spans of a segment with their votes, in one pass over the whole texts."""
    out, seg = segments(docs), F.col("segment")
    digit = seg.rlike("[0-9]")
    gates = {"email": seg.contains("@"), "ip": digit, "card": digit, "phone": seg.contains("+")}
    loose_gates = {"email": seg.rlike(r"[\[(]at[\])]"), "phone": digit}
    names = []
    for loose, patterns, when in ((False, STRICT, gates), (True, LOOSE, loose_gates)):
        for kind, pattern in patterns.items():
            name = f"{'loose' if loose else 'strict'}_{kind}"
            for column, value in _spans(name, kind, pattern, when[kind], loose):
                out = out.withColumn(column, value)
            names.append(name)
    none = F.array().cast(CANDIDATE)
    found = F.filter(F.flatten(F.array(*(F.coalesce(F.col(n), none) for n in names))), plausible)
    out = out.select("row", "doc_id", "n_segments", F.transform(found, lambda c: c.withField("ok", valid(c))).alias("found"))
    return out.select("row", "doc_id", "n_segments", F.transform("found", lambda c: F.struct(c["kind"], c["s"], c["e"], c["ok"], _votes(c).alias("votes"))).alias("cands"))


def estimate(patterns: Sequence[tuple[int, tuple[int, ...], int, int]], steps: int = 40) -> dict[tuple[int, tuple[int, ...]], float]:
    """Expectation-maximisation over (kind, votes, shape, count): the posterior that a candidate with these votes is personal data.

    Each kind has a share of true candidates, and each labeler a rate of votes for among its votes on true and on false ones; an
    abstention says nothing.
    """
    posterior: dict[tuple[int, tuple[int, ...]], float] = {}
    for kind in sorted({p[0] for p in patterns}):
        counts: dict[tuple[int, ...], int] = {}
        for k, votes, _, n in patterns:
            if k == kind:
                counts[votes] = counts.get(votes, 0) + n
        r = {v: 1 / (1 + math.exp(-sum(v) * 0.8)) for v in counts}
        labelers = range(len(next(iter(counts))))
        for _ in range(steps):
            total = {1: sum(n * r[v] for v, n in counts.items()), 0: sum(n * (1 - r[v]) for v, n in counts.items())}
            share = (total[1] + 1) / (total[0] + total[1] + 2)
            logs: dict[tuple[int, int, int], float] = {}
            for labeler in labelers:
                for truth in (0, 1):
                    mass = {vote: sum(n * (r[v] if truth else 1 - r[v]) for v, n in counts.items() if v[labeler] == vote) for vote in (-1, 1)}
                    for vote in (-1, 1):
                        toward = 1.0 if vote == (1 if truth else -1) else 0.5  # a weak belief that labelers are better than chance
                        logs[labeler, truth, vote] = math.log((mass[vote] + toward) / (mass[-1] + mass[1] + 1.5))
            for v in counts:
                gap = math.log(share / (1 - share)) + sum(logs[k, 1, x] - logs[k, 0, x] for k, x in enumerate(v) if x)
                r[v] = 1 / (1 + math.exp(-max(-40.0, min(40.0, gap))))
        posterior |= {(kind, v): x for v, x in r.items()}
    return posterior


#: Shape classes, and the classifier's weights of one kind: a level, each labeler's three votes, the shapes.
SHAPES = 9
PER_KIND = 1 + 3 * len(LABELERS) + SHAPES


def _features(kind: int, votes: tuple[int, ...], shape: int) -> list[int]:
    """Indices of a candidate's features that are 1, all of its kind."""
    base = PER_KIND * kind
    return [base, *(base + 2 + 3 * k + v for k, v in enumerate(votes)), base + 1 + 3 * len(LABELERS) + shape]


def train_classifier(patterns: Sequence[tuple[int, tuple[int, ...], int, int]], posterior: dict, rounds: int = 300) -> list[float]:
    """Logistic regression of the posteriors on the features, by gradient steps on the counted patterns; each kind counts alike."""
    weights = [0.0] * (PER_KIND * len(KINDS))
    scale = {kind: sum(p[3] for p in patterns if p[0] == kind) for kind in range(len(KINDS))}
    rows = [(_features(k, v, s), posterior[k, v], n / scale[k]) for k, v, s, n in patterns]
    for _ in range(rounds):
        slope = [0.002 * w for w in weights]
        for active, target, share in rows:
            z = sum(weights[i] for i in active)
            gap = share * (1 / (1 + math.exp(-max(-40.0, min(40.0, z)))) - target)
            for i in active:
                slope[i] += gap
        weights = [w - 0.5 * s for w, s in zip(weights, slope, strict=True)]
    return weights


def _probability(c: Column, weights: list[float]) -> Column:
    known = F.array(*(F.lit(float(w)) for w in weights))
    base = c["kind"] * PER_KIND
    z = F.get(known, base) + F.get(known, base + 1 + 3 * len(LABELERS) + c["votes"]["shape"])
    for k, name in enumerate(LABELERS):
        z = z + F.get(known, base + 2 + 3 * k + c["votes"][name])
    return 1 / (1 + F.exp(-z))


def _settled(out: DataFrame) -> DataFrame:
    """spans: base and what of extra touches no base span of its kind and, of extra, no earlier one. Sorted sweeps, so linear for any number of spans.

    Extra spans are few (loose and failed forms), and so are the segments that hold any; only these come here.
    """
    held = out.withColumn("piece", F.monotonically_increasing_id())
    every = F.concat(F.transform("base", lambda x: F.struct(F.lit(0).alias("own"), x.alias("x"))), F.transform("extra", lambda x: F.struct(F.lit(1).alias("own"), x.alias("x"))))
    each = held.select("row", "doc_id", "n_segments", "piece", F.explode(every).alias("y")).select("row", "doc_id", "n_segments", "piece", "y.own", "y.x", "y.x.*")
    rising = Window.partitionBy("piece", "kind").orderBy("start", "own", "end")
    falling = Window.partitionBy("piece", "kind").orderBy(F.desc("start"), F.desc("own"), F.desc("end"))
    up_to = lambda w, last: w.rowsBetween(Window.unboundedPreceding, last)
    a_base = F.col("own") == 0
    swept = each.select(
        "*",
        F.max(F.when(a_base, F.col("end"))).over(up_to(rising, 0)).alias("base_before"),
        F.max(F.when(~a_base, F.col("end"))).over(up_to(rising, -1)).alias("extra_before"),
        F.min(F.when(a_base, F.col("start"))).over(up_to(falling, 0)).alias("base_after"),
    )
    free = (F.coalesce("base_before", F.lit(-1)) <= F.col("start")) & (F.coalesce("extra_before", F.lit(-1)) <= F.col("start")) & (F.coalesce(F.col("base_after") >= F.col("end"), F.lit(True)))
    listed_ = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("x"))))
    kept = swept.groupBy("piece").agg(F.first("row").alias("row"), F.first("doc_id").alias("doc_id"), F.first("n_segments").alias("n_segments"), listed_(a_base).alias("base"), listed_(a_base | free).alias("spans"))
    return kept.drop("piece")


def find_personal_data(docs: DataFrame) -> DataFrame:
    """Spans of personal data in every text.

    docs: doc_id, text; other columns are ignored. Returns a row for each row of docs: doc_id, base and spans, arrays of
    struct(start, kind, end) in code points, end exclusive, by start and then kind (0 email, 1 ip, 2 card, 3 phone). base has the
    strict spans that pass their test; spans has these and the other candidates (loose forms, and strict forms that fail the test) that
    the classifier takes and that overlap no base span of their kind nor, among themselves, an earlier loose or failed one. A null or empty
    text has none. Without any candidate nothing is trained and nothing is added. Equal rows each get their spans.
    """
    found = written(candidates(docs), "candidates")
    votes = found.select(F.explode("cands").alias("c")).select("c.kind", "c.votes.*").groupBy("kind", *LABELERS, "shape").count()
    rows: list[Row] = votes.collect()  # bounded: kinds, votes and shapes
    patterns = sorted((r["kind"], tuple(r[k] for k in LABELERS), r["shape"], r["count"]) for r in rows)
    weights = train_classifier(patterns, estimate(patterns))
    brief = lambda c: F.struct(c["s"].alias("start"), c["kind"].alias("kind"), c["e"].alias("end"))
    base = F.array_sort(F.transform(F.filter("cands", lambda c: c["ok"]), brief))
    extra = F.array_sort(F.transform(F.filter("cands", lambda c: ~c["ok"] & (_probability(c, weights) >= 0.5)), brief))
    out = found.select("row", "doc_id", "n_segments", base.alias("base"), extra.alias("extra"))
    quiet = out.where(F.size("extra") == 0).select("row", "doc_id", "n_segments", "base", F.col("base").alias("spans"))
    out = quiet.unionByName(_settled(out.where(F.size("extra") > 0)))
    whole = out.where(F.col("n_segments") == 1).select("doc_id", "base", "spans")
    joined = out.where(F.col("n_segments") > 1).groupBy("row").agg(F.first("doc_id").alias("doc_id"), *(F.array_sort(F.flatten(F.collect_list(c))).alias(c) for c in ("base", "spans")))
    return whole.unionByName(joined.select("doc_id", "base", "spans"))


def listed(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["end"])), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == KINDS.index(kind))).cast("long")
