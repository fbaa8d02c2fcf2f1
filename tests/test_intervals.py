import random

import pytest
from pyspark.sql import functions as F

from sitelark.functions import expressions as X
from sitelark.operators import features, intervals, signal


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("width", [1, 7, 100, 5000])
def test_overlap_joins_equal_all_pairs(spark, width):
    rng = random.Random(width)
    a = [(i, rng.choice("xy"), s := rng.randrange(400), s + rng.randrange(1, 60)) for i in range(60)]
    b = [(i, rng.choice("xy"), s := rng.randrange(400), s + rng.choice([1, 5, 300])) for i in range(50)]
    left, right = frame(spark, a, "i long, c string, s long, e long"), frame(spark, b, "j long, c string, rs long, re long")
    want = sorted((x[0], y[0]) for x in a for y in b if x[1] == y[1] and x[2] < y[3] and y[2] < x[3])
    join = lambda how: intervals.overlap_join(left, right, ("c",), ("s", "e"), ("rs", "re"), how, ("i",), width)
    assert sorted((r["i"], r["j"]) for r in join("inner").collect()) == want
    hit = {i for i, _ in want}
    assert sorted(r["i"] for r in join("semi").collect()) == sorted(hit)
    assert sorted(r["i"] for r in join("anti").collect()) == sorted({x[0] for x in a} - hit)
    outer = [(r["i"], r["j"]) for r in join("left").collect()]
    assert sorted(p for p in outer if p[1] is not None) == want and sorted(i for i, j in outer if j is None) == sorted({x[0] for x in a} - hit)


def test_asof_with_ties_and_containment(spark):
    cover = frame(spark, [("a", 10, 14), ("a", 20, 24), ("b", 1, 2)], "c string, s long, e long")
    sites = frame(spark, [("a", p) for p in (9, 12, 17, 24)] + [("z", 5)], "c string, p long")
    got = {(r["c"], r["p"]): r["s"] for r in intervals.asof_backward(sites, cover, ("c",), "p", "s", ("s",)).collect()}
    assert got == {("a", 9): None, ("a", 12): 10, ("a", 17): 10, ("a", 24): 20, ("z", 5): None}
    kept = intervals.asof_contains(sites, cover, ("c",), "p", "s", "e", ("s",)).collect()
    assert sorted((r["p"], r["s"]) for r in kept) == [(12, 10), (24, 20)]


def test_window_membership(spark):
    df = frame(spark, [(p,) for p in (79, 80, 95, 104, 105, 119, 120)], "at long")
    pos = F.lit(100)
    row = df.select("at", signal.in_inner(pos, F.col("at"), 5).alias("i"), signal.in_flanks(pos, F.col("at"), 5, 20).alias("o"), signal.in_flanks(pos, F.col("at"), 5, 20, True).alias("d")).orderBy("at").collect()
    assert [r["i"] for r in row] == [False, False, True, True, False, False, False]
    assert [r["o"] for r in row] == [False, True, True, False, True, True, False]
    assert [r["d"] for r in row] == [False, True, False, False, True, True, False]


def test_contrast_threshold_and_scores(spark):
    points = [("c", "+", at, cond, v, d) for cond in ("native", "fixed") for at, v, d in ((100, 1.0, 2), (101, 3.0, 2), (110, 0.0, 1), (111, 2.0, 3))]
    pts = frame(spark, points, "chrom string, strand string, at long, cond string, val double, depth long")
    sites = frame(spark, [(1, "c", "+", 100), (2, "c", "+", 5000)], "site long, chrom string, strand string, pos long")
    got = signal.site_score(sites, pts, 5, 20, 2).collect()
    assert [(r["site"], r["t_native"], r["s_l"]) for r in got] == [(1, 2.0, 8.0)]
    assert signal.site_score(sites, pts, 5, 20, 3).count() == 0
    dense = {r["site"]: (r["t_native"], r["s_l"]) for r in signal.site_score_dense(sites, pts.withColumns({"start": F.col("at"), "end": F.col("at") + 1}), 5, 20, 2).collect()}
    assert dense == {1: (1.0, 2.0), 2: (None, 0.0)}
    w = signal.weighted_summary(pts.where("cond = 'native' and at >= 110"), ["chrom"]).first()
    assert (w["mean"], w["var"], w["w"], w["wmean"], w["wvar"]) == (1.0, 1.0, 4, 1.5, 0.75)


def test_expressions(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("v")).first()["v"]
    parsed = one.select(*X.parsed_site_id(F.lit("chr1_KI270706v1_random_12_+"))).first()
    assert tuple(parsed) == ("chr1_KI270706v1_random", 12, "+")
    assert value(X.reverse_complement(F.lit("ACGTN"))) == "NACGT" and value(X.reverse_complement(F.lit("AUG"))) == "CAT"
    assert value(X.tss_proximity(F.lit(1000))) == 0.5 and value(X.tss_proximity(F.lit(None).cast("long"))) == 0
    assert round(value(X.transcript_share(F.lit(500), F.lit(1000))), 6) == 0.666667
    assert value(X.transcript_share(F.lit(None).cast("long"), F.lit(1000))) == float("inf")
    assert value(X.overlap_fraction(F.lit(50), F.lit(150), F.lit(100), F.lit(120))) == 0.2
    assert value(X.overlap_fraction(F.lit(50), F.lit(150), F.lit(None).cast("int"), F.lit(None).cast("int"))) == 0
    assert value(X.sigmoid(F.lit(1000.0))) == 1 / (1 + 4.248354255291589e-18)


def test_features(spark):
    sites = frame(spark, [("a", 0.5), ("b", 0.5), ("c", 2.0), ("d", None), ("e", 0.5)], "id string, score double")
    bound, structured = frame(spark, [("a",), ("a",)], "id string"), frame(spark, [("b",)], "id string")
    labels = {r["id"]: r["label"] for r in features.label_sites(sites, bound, structured, "id", "score").collect()}
    assert labels == {"a": "clip_bound", "b": "non_determined", "c": "non_determined", "d": "non_determined", "e": "clip_unbound"}
    z = features.zscored(frame(spark, [(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)], "x double, k double"), ["x", "k"]).orderBy("x").collect()
    assert [round(r["x_z"], 6) for r in z] == [-1.224745, 0.0, 1.224745] and [r["k_z"] for r in z] == [0, 0, 0]
    p = features.percentiles(frame(spark, [(float(v),) for v in (1, 2, 3, 4)], "x double"), "x").collect()
    assert [r["value"] for r in p] == [1.75, 2.5, 3.25]
    dirty = frame(spark, [(1.0, 1.0), (float("nan"), 1.0), (None, 1.0), (float("inf"), 1.0), (1.0, float("nan"))], "x double, s double")
    assert features.model_input(dirty, ["x"], "s").count() == 1 and features.model_input(dirty, ["x"], "s", legacy=True).count() == 2
    with pytest.raises(ValueError):
        features.model_input(dirty, ["absent"], "s")
    for cons, want in (([5.0, 1.0], [0.95, 0.05]), ([1.0, 5.0], [0.05, 0.95]), ([None, 1.0], [0.95, 0.05])):
        df = frame(spark, list(zip([0.95, 0.05], cons, strict=True)), "p double, c double")
        assert sorted(round(r["p"], 6) for r in features.oriented(df, "p", "c", ["p"]).collect()) == sorted(want)
