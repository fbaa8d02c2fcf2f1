import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from sitelark.operators import intervals, signal, windows

SITES, POINTS = "site long, chrom string, strand string, pos long", "chrom string, strand string, at long, cond string, val double, depth long"


@pytest.mark.parametrize(("inner", "outer"), [(1, 2), (5, 20), (30, 31)])
def test_windows_equal_brute_force(spark, inner, outer):
    """Windows on block edges, below 0, with hot places, null values and keys, repeated sites and equal values."""
    rng = random.Random(inner)
    points = [(rng.choice(["a", "b", None]), rng.choice("+-"), rng.choice([None, 7, *range(-90, 90)]), rng.choice(["native", "fixed", "other"]), rng.choice([None, 1e3, 1e3 + 1, 3.5]), rng.randrange(1, 8)) for _ in range(900)]
    points += [("c", "+", k % 3, c, 0.1, 1) for k in range(60) for c in ("native", "fixed")]
    sites = [(k, rng.choice(["a", "b", "c", None]), rng.choice("+-"), rng.choice([None, 5, *range(-120, 120)])) for k in range(150)]
    s, p = spark.createDataFrame(sites, SITES), spark.createDataFrame(points, POINTS)
    got = {r["site"]: r.asDict() for r in signal.window_moments(s, p, inner, outer).collect()}
    flat = {r["site"]: r.asDict() for r in signal.window_summary(s, p, signal.ranges(inner, outer)["out"], conds=("native", "fixed"), threshold=2).collect()}
    for site, chrom, strand, pos in sites:
        near = [x for x in points if None not in (chrom, pos, x[2]) and x[:2] == (chrom, strand) and pos - outer <= x[2] < pos + outer]
        assert bool(near) == (site in got)
        for cond in ("native", "fixed"):
            inside = [x for x in near if x[3] == cond and pos - inner <= x[2] < pos + inner]
            flanks = [x for x in near if x[3] == cond and (x[2] <= pos - inner or x[2] >= pos + inner)]
            for name, part in (("in", inside), ("out", flanks)):
                row, v = got.get(site, {}), [x[4] for x in part if x[4] is not None]
                assert (row.get(f"n_{cond}_{name}") or 0) == len(v) and (row.get(f"w_{cond}_{name}") or 0) == sum(x[5] for x in part)
                if v:
                    assert np.isclose(row[f"mean_{cond}_{name}"], np.mean(v), rtol=1e-12) and np.isclose(row[f"var_{cond}_{name}"], np.var(v), rtol=1e-8)
                    assert len(set(v)) > 1 or row[f"var_{cond}_{name}"] == 0
            row = flat.get(site, {})
            assert row.get(f"n_{cond}") == (len(flanks) if len(flanks) > 1 else None)
            known = [x for x in flanks if x[4] is not None]
            if len(flanks) > 1 and known:
                assert np.isclose(row[f"total_{cond}"], sum(x[4] for x in known)) and np.isclose(row[f"wmean_{cond}"], sum(x[4] * x[5] for x in known) / sum(x[5] for x in flanks))


def test_rounded_summary_has_the_digits_of_rows_added_in_order(spark, monkeypatch):
    """Ties of the rounding, where the order of adding decides: only places near one make pairs, and their digits are those of the rows as they come."""
    rng = random.Random(2)
    points = [("a", "+", rng.randrange(400), rng.choice([None, *(k / 100 for k in range(9000))]), rng.choice([1, 2, 4, 8]), k) for k in range(1500)]
    sites = [(k, "a", "+", rng.randrange(-20, 420)) for k in range(300)]
    seen, opened = signal.point_pairs, []
    monkeypatch.setattr(signal, "point_pairs", lambda left, *a: (opened.append(left.count()), seen(left, *a))[1])
    s, p = spark.createDataFrame(sites, SITES), spark.createDataFrame(points, "chrom string, strand string, at long, val double, depth long, id long")
    got = {r["site"]: r for r in signal.rounded_summary(s, p, (-4, 4), {"mean": 7, "var": 6, "wmean": 7, "wvar": 6}, "id", threshold=2).collect()}
    places, found = {}, 0
    for site, _, _, pos in sites:
        near = [x for x in points if pos - 4 <= x[2] < pos + 4]
        assert (len(near) >= 2) == (site in got)
        if len(near) < 2:
            continue
        k = mean = dd = total = x = xx = 0.0
        for _, _, _, v, w, _ in near:  # one after the other, as an aggregation does
            if v is not None:
                k, old = k + 1, mean
                mean += (v - old) / k
                dd, total, x, xx = dd + (v - old) * (v - mean), total + v, x + v * w, xx + w * v * v
        w = float(sum(x[4] for x in near))
        want = {"mean": (total / k, 7), "var": (dd / k, 6), "wmean": (x / w, 7), "wvar": (xx / w - (x / w) * (x / w), 6)}
        ties = {c: abs(v * 10**d % 1 - 0.5) < 1e-4 for c, (v, d) in want.items()}
        found += any(ties.values())
        places[pos] = any(ties.values())
        assert (got[site]["n"], got[site]["w"]) == (len(near), w)
        assert all(got[site][c] == np.floor(v * 10.0**d + 0.5) / 10.0**d for c, (v, d) in want.items())
    assert found and sum(places.values()) <= opened[0] < len(places) / 2


def test_places_covered_by_spans(spark):
    rng = random.Random(4)
    spans = [(rng.choice("ab"), s := rng.randrange(-300, 300), s + rng.choice([0, 1, 2, 7, 64, 255]), rng.randrange(9)) for _ in range(200)]
    marks = [(c, k) for c in "abz" for k in range(-320, 600, 3)]
    got = {(r["c"], r["p"]): (r["n"], r["m"]) for r in windows.covering(spark.createDataFrame(marks, "c string, p long"), spark.createDataFrame([(*x, x[3]) for x in spans], "c string, s long, e long, n long, m long"), ("c",), "p", ("s", "e"), ["n"], ["m"]).collect()}
    hits = {(c, p): [v for k, s, e, v in spans if k == c and s <= p < e] for c, p in marks}
    assert got == {k: (sum(v), min(v)) for k, v in hits.items() if v}


def test_transcripts_of_hot_places(spark):
    """Many transcripts over one place, ties of length, both strands, exons of one transcript that overlap."""
    rng = random.Random(9)
    exons = [(c, s, t, a := rng.randrange(60), a + rng.choice([1, 2, 9, 30])) for t in range(80) for c, s in [(rng.choice("ab"), rng.choice("+-"))] for _ in range(rng.randrange(1, 4))]
    sites = [(k, rng.choice(["a", "b", None]), rng.choice("+-"), rng.randrange(-5, 95)) for k in range(200)]
    got = {r["id"]: (r["transcript_id"], r["transcript_start"], r["transcript_length"]) for r in intervals.map_to_transcripts(spark.createDataFrame(sites, "id long, chrom string, strand string, pos long"), spark.createDataFrame(exons, "chrom string, strand string, transcript_id long, exon_start long, exon_end long"), "id", "pos").collect()}
    assert len(got) == len(sites)
    for k, chrom, strand, pos in sites:
        hits = []
        for t in {x[2] for x in exons if x[:2] == (chrom, strand)}:
            own = sorted((a, b) for c, s, u, a, b in exons if (c, s, u) == (chrom, strand, t))
            length = sum(b - a for a, b in own)
            if len({a for a, _ in own}) < len(own):
                continue  # the order of exons that start together is open
            for i, (a, b) in enumerate(own):
                inside = sum(d - c for c, d in own[:i]) + pos - a
                hits += [(-length, t, length - 1 - inside if strand == "-" else inside)] if a <= pos < b else []
        tied = [t for t in {x[2] for x in exons} if len({x[3] for x in exons if x[2] == t}) < sum(x[2] == t for x in exons)]
        if got[k][0] not in tied:
            assert got[k] == (min(hits)[1], min(hits)[2], -min(hits)[0]) if hits else got[k][0] is None


def test_left_join_shuffles_no_pair(spark):
    """A pair goes through no exchange: left rows without a hit are added beside the pairs, spans decide which."""
    left = spark.range(2000).select("id", F.lit("a").alias("c"), (F.col("id") % 5).alias("s"), (F.col("id") % 5 + 3).alias("e"))
    right = spark.range(1500).select(F.col("id").alias("r"), F.lit("a").alias("c"), (F.col("id") % 4 + 4).alias("rs"), (F.col("id") % 4 + 6).alias("re"))
    out = intervals.overlap_join(left, right, ("c",), ("s", "e"), ("rs", "re"), "left", ("id",), 10)
    want = sum(len([1 for b in range(1500) if i % 5 < b % 4 + 6 and b % 4 + 4 < i % 5 + 3]) or 1 for i in range(5)) * 400
    assert out.count() == want
    assert "Join LeftOuter" not in out._jdf.queryExecution().optimizedPlan().toString()
    facts = intervals.overlap_facts(left, right, ("c",), ("s", "e"), ("rs", "re"), {"odd": F.col("r") % 2 == 1}, width=10).collect()
    near = lambda i: [b for b in range(1500) if i % 5 < b % 4 + 6 and b % 4 + 4 < i % 5 + 3]
    assert {(r["id"] % 5, r["n"], r["odd"]) for r in facts} == {(i, len(near(i)), any(b % 2 for b in near(i))) for i in range(5) if near(i)}
