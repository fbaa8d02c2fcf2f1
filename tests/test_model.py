import math

import numpy as np
import pytest

from sitelark.operators import baselines, metrics, mixture
from sitelark.plans import pipeline


def test_ranking_metrics(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.4), (1, 0.35), (1, 0.8)], "y int, s double")
    assert metrics.roc_auc(df, "s", "y").first()[0] == 0.75
    assert round(metrics.average_precision(df, "s", "y").first()[0], 6) == 0.833333
    f1 = metrics.best_f1(df, "s", "y").first()
    assert (round(f1["f1"], 6), f1["threshold"]) == (0.8, 0.35)
    at = metrics.precision_at_fpr(df, "s", "y", 0.1).first()
    assert (round(at["precision"], 6), at["threshold"]) == (1.0, 0.8)
    tied = spark.createDataFrame([(0, 1.0), (1, 1.0), (1, 1.0)], "y int, s double")
    assert metrics.roc_auc(tied, "s", "y").first()[0] == 0.5
    assert metrics.roc_auc(tied.where("y = 1"), "s", "y").first()[0] is None


def test_auc_equals_pair_counting(spark):
    rng = np.random.default_rng(2)
    y, s = rng.integers(0, 2, 300), rng.integers(0, 40, 300).astype(float)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s, strict=True)], "y int, s double")
    pos, neg = s[y == 1], s[y == 0]
    want = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    assert abs(metrics.roc_auc(df, "s", "y").first()[0] - want) < 1e-12


def _two_normals(n=3000, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=n)
    z = rng.random(n) < 1 / (1 + np.exp(-(0.3 + 1.2 * x)))
    return np.where(z, rng.normal(5, 1, n), rng.normal(1, 0.7, n)), x


def test_local_fit_recovers_parameters():
    s, x = _two_normals()
    m, p, r = mixture.fit_local(s, x[:, None])
    assert m.converged and abs(m.mu0 - 1) < 0.1 and abs(m.mu1 - 5) < 0.15 and abs(m.sigma0 - 0.7) < 0.1 and abs(m.sigma1 - 1) < 0.1
    assert abs(m.beta[0] - 0.3) < 0.2 and abs(m.beta[1] - 1.2) < 0.25 and abs(m.mean_p - m.mean_r) < 0.0015


@pytest.mark.parametrize("local_rows", [mixture.LOCAL_ROWS, 0])
def test_group_fit_agrees_with_local_fit(spark, monkeypatch, local_rows):
    monkeypatch.setattr(mixture, "LOCAL_ROWS", local_rows)
    a, b = _two_normals(1200, 4), _two_normals(900, 5)
    rows = [("a", float(s), float(x)) for s, x in zip(*a, strict=True)] + [("b", float(s), float(x)) for s, x in zip(*b, strict=True)] + [(None, 1.0, 1.0)]
    got = mixture.fit_groups(spark.createDataFrame(rows, "g string, s double, x double"), "g", "s", ["x"], steps=40)
    assert set(got) == {"a", "b"}
    for name, (s, x) in (("a", a), ("b", b)):
        want, _, _ = mixture.fit_local(s, x[:, None])
        for k in ("mu0", "mu1", "sigma0", "sigma1", "mean_p"):
            assert abs(getattr(got[name], k) - getattr(want, k)) < 0.01
        assert abs(got[name].final_log_likelihood - want.final_log_likelihood) < 1e-3 * abs(want.final_log_likelihood)


def test_penalised_logistic_regression(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 2))
    y = (rng.random(400) < 1 / (1 + np.exp(-(0.5 + x @ [1.0, -2.0])))).astype(int)
    df = spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(x, y, strict=True)], "a double, b double, y int")
    m = baselines.fit_logistic(df, ["a", "b"], "y")
    w = np.array(m.coefficients)
    p = 1 / (1 + np.exp(-(m.intercept + x @ w)))
    assert np.allclose(x.T @ (p - y) + w, 0, atol=1e-6) and abs((p - y).sum()) < 1e-6  # the penalised gradient vanishes
    one = baselines.fit_logistic(df.where("y = 1"), ["a", "b"], "y")
    assert one.one_class and baselines.with_probability(df, one, ["a", "b"]).select("probability").distinct().collect()[0][0] == 0.5


def test_distribution_fits(spark):
    rng = np.random.default_rng(7)
    g = spark.createDataFrame([(float(v),) for v in rng.gamma(3.0, 2.0, 4000)], "v double")
    k, scale = baselines.fit_gamma(g, "v")
    assert abs(k - 3) < 0.3 and abs(scale - 2) < 0.25
    t = spark.createDataFrame([(float(v),) for v in 4 + 2 * rng.standard_t(5, 4000)], "v double")
    nu, mu, sigma = baselines.fit_student(t, "v", 40)
    assert 3.5 < nu < 8 and abs(mu - 4) < 0.15 and abs(sigma - 2) < 0.2
    n = spark.createDataFrame([(float(v),) for v in rng.normal(1, 3, 4000)], "v double")
    assert baselines.qq_normal(n, "v")["r2"] > 0.995
    assert abs(baselines.digamma(1.0) + 0.5772156649) < 1e-8 and abs(baselines.trigamma(1.0) - math.pi**2 / 6) < 1e-8
    assert np.allclose(baselines.normal_quantile(np.array([0.025, 0.5, 0.975])), [-1.959964, 0, 1.959964], atol=1e-5)


def test_gamma_and_student_quantiles():
    p = np.array([0.025, 0.5, 0.975])
    assert np.allclose(baselines.gamma_quantile(p, 1.0, 2.0), -2 * np.log1p(-p))  # exponential
    assert np.allclose(baselines.gamma_quantile(p, 0.5, 2.0), [0.000982069, 0.454936, 5.023886], rtol=1e-5)  # chi-square of 1
    assert np.allclose(baselines.gamma_quantile(p, 10.0, 2.0), [9.590777, 19.337429, 34.169607], rtol=1e-6)  # of 20
    assert np.allclose(baselines.student_quantile(p, 1.0, 1.0, 3.0), 1 + 3 * np.tan(np.pi * (p - 0.5)))  # Cauchy
    assert np.allclose(baselines.student_quantile(p, 5.0), [-2.570582, 0, 2.570582], atol=1e-6)
    assert np.allclose(baselines.student_quantile(p, 1e6), baselines.normal_quantile(p), atol=1e-5)


def test_qq_deviations_use_all_points(spark):
    v = np.sort(np.random.default_rng(17).gamma(3.0, 2.0, 3000))
    df = spark.createDataFrame([(float(x),) for x in np.random.default_rng(1).permutation(v)], "v double")
    got, n = baselines.qq_deviations(df, "v"), len(v)
    p = (np.arange(1, n + 1) - 0.3175) / (n + 0.365)
    p[-1] = 0.5 ** (1 / n)
    p[0] = 1 - p[-1]
    theory = {"gamma": baselines.gamma_quantile(p, *baselines.fit_gamma(df, "v")), "normal": v.mean() + v.std() * baselines.normal_quantile(p), "student": baselines.student_quantile(p, *baselines.fit_student(df, "v"))}
    assert set(got) == set(theory) and all(abs(got[k] - np.abs(v - t).mean()) < 1e-9 for k, t in theory.items())
    assert got["gamma"] < 0.2 < got["normal"]


def test_evaluation_fills_all_metrics(spark):
    rng = np.random.default_rng(3)
    rows = [(f"c_{100 * (k + 1)}_+", float(rng.random()), float(rng.random()), float(rng.gamma(2.0, 3.0)), float(rng.normal()), float(rng.random()), float(rng.random())) for k in range(200)]
    modelled = spark.createDataFrame(rows, "id string, posterior_r double, prior_p double, s_l double, inner_mean_logPWM double, score_phastcons100 double, PhastCons100_percent double")
    peaks = spark.createDataFrame([("c", "+", 0, 8000)], "chrom string, strand string, start long, end long")
    row = pipeline.evaluation(modelled, peaks, peaks.limit(0), feature_columns=("inner_mean_logPWM", "PhastCons100_percent"))["metrics"].first().asDict()
    qq = {k: v for k, v in row.items() if k.startswith("qq_")}
    assert len(qq) == 6 and all(v is not None and v >= 0 for v in qq.values())


@pytest.mark.parametrize("mode", ["vb", ""])
def test_unknown_mode_is_an_error(spark, mode):
    from sitelark.plans import pipeline

    with pytest.raises(ValueError):
        pipeline.model(spark.range(1), mode=mode)


def test_quantiles_by_brackets_are_exact(spark, monkeypatch):
    from sitelark.operators import quantiles

    rng = np.random.default_rng(8)
    values = np.r_[rng.normal(size=3000), np.zeros(500), rng.exponential(5, 1500)]
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "v double")
    points = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    want = np.quantile(values, points)
    assert np.allclose(quantiles.quantile_values(df, "v", points), want)
    monkeypatch.setattr(quantiles, "MOST_DISTINCT", 10)
    monkeypatch.setattr(quantiles, "MOST_LEFT", 60)
    assert np.allclose(quantiles.quantile_values(df, "v", points), want)
    assert quantiles.quantile_values(df.limit(0), "v", points) is None
    grouped = df.where("v is not null").withColumn("g", df["v"] > 0)
    got = {r["g"]: r["q50"] for r in mixture.initial_table(grouped.where("not isnan(v)"), "v", ["g"]).collect()}
    assert abs(got[True] - np.median(values[values > 0])) < 1e-12


@pytest.mark.parametrize("local_rows", [mixture.LOCAL_ROWS, 0])
def test_repeated_rows_are_fitted_once(spark, monkeypatch, local_rows):
    """Every row three times and some more often: the fit of all rows, from passes that see each distinct row once."""
    monkeypatch.setattr(mixture, "LOCAL_ROWS", local_rows)
    s, x = _two_normals(400, 8)
    often = np.random.default_rng(1).integers(3, 7, 400)
    want, _, _ = mixture.fit_local(np.repeat(s, often), np.repeat(x, often)[:, None], 6, 0.0)
    seen, sizes = mixture.counted, []
    monkeypatch.setattr(mixture, "counted", lambda df, *c: (out := seen(df, *c), sizes.append(out.count()))[0])
    got = mixture.fit_groups(spark.createDataFrame([("a", float(a), float(b)) for a, b in zip(np.repeat(s, often), np.repeat(x, often), strict=True)], "g string, s double, x double"), "g", "s", ["x"], 6, 0.0)["a"]
    assert sizes == [400]
    for k in ("mu0", "mu1", "sigma0", "sigma1", "mean_p", "mean_r", "final_log_likelihood"):
        assert np.isclose(getattr(got, k), getattr(want, k), rtol=1e-6)
    assert np.allclose(got.beta, want.beta, rtol=1e-4)


def test_few_vectors_of_features_take_one_pass_a_step(spark, monkeypatch):
    """Large groups whose features repeat: nothing is counted or shuffled by row, least squares take no pass, and the fit is that of one table."""
    rng = np.random.default_rng(3)
    s, x = _two_normals(3000, 8)
    x, y = rng.integers(0, 4, 3000) / 2, rng.integers(0, 3, 3000) * 1.0
    s = np.round(s, 2) - 2  # ties, both signs, zeros
    monkeypatch.setattr(mixture, "counted", None)
    monkeypatch.setattr(mixture, "group_sums", None)
    monkeypatch.setattr(mixture, "MOST_LEFT", 20)
    monkeypatch.setattr(mixture, "PIECE", 50)
    seen, passes = mixture._piece_sums, []
    monkeypatch.setattr(mixture, "_piece_sums", lambda *a: (passes.append(a[3]), seen(*a))[1])
    rows = [(g, float(a), float(b), float(c)) for g, m in (("a", 3000), ("b", 1001)) for a, b, c in zip(s[:m], x[:m], y[:m], strict=True)]
    got = mixture.fit_groups(spark.createDataFrame(rows, "g string, s double, x double, y double"), "g", "s", ["x", "y"], 5, 0.0, local_rows=0)
    assert passes.count(8) == 5 + 2
    for g, m in (("a", 3000), ("b", 1001)):
        want, _, _ = mixture.fit_local(s[:m], np.column_stack([x, y])[:m], 5, 0.0)
        assert got[g].iters == want.iters == 5 and not got[g].converged
        for k in ("mu0", "mu1", "sigma0", "sigma1", "mean_p", "mean_r", "final_log_likelihood"):
            assert np.isclose(getattr(got[g], k), getattr(want, k), rtol=1e-9)
        assert np.allclose(got[g].beta, want.beta, rtol=1e-6)


def test_quantiles_of_counted_values(spark, monkeypatch):
    from sitelark.operators import quantiles

    monkeypatch.setattr(quantiles, "MOST_LEFT", 60)
    rng = np.random.default_rng(2)
    v, n = rng.normal(size=700), rng.integers(1, 9, 700)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(v, n, strict=True)], "v double, n long")
    points = [0.0, 0.1, 0.5, 0.77, 1.0]
    assert np.allclose(quantiles.quantile_values(df, "v", points, "n"), np.quantile(np.repeat(v, n), points), rtol=1e-12)
