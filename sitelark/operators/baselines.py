"""Supervised baselines and distribution checks, on the sums that one aggregation gives per pass."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import sigmoid
from ..shared import dropped, written
from .mixture import gram_sums, newton, solve
from .quantiles import quantile_values
from .ranks import numbered
from .sums import group_numbers, group_sums, packed


#: The distributions that values are held against.
FITTED = ("gamma", "normal", "student")
#: The group of a table that is fitted as a whole.
ONE = "_one"
#: Times that a step which raises the loss is halved at most.
HALVINGS = 40


@dataclass
class Logistic:
    intercept: float
    coefficients: list[float]
    converged: bool = False
    steps: int = 0

    @property
    def one_class(self) -> bool:
        return not math.isfinite(self.intercept)


@dataclass
class _Path:
    """Where a group's fit stands: the accepted coefficients and their loss, and the step that is tried from them."""

    beta: np.ndarray
    step: np.ndarray
    loss: float = math.inf
    halved: int = 0
    steps: int = 0
    converged: bool = False


def _parameters(df: DataFrame, by: Sequence[str], rows: dict[tuple, Sequence[float]], names: Sequence[str]) -> DataFrame:
    """A row a group, to be sent: its key and some numbers."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*by).schema.fields)
    return F.broadcast(df.sparkSession.createDataFrame([(*g, *map(float, v)) for g, v in rows.items()], kinds + "".join(f", {n} double" for n in names)))


def fit_logistic_groups(df: DataFrame, by: Sequence[str], features: Sequence[str], y: str, c: float = 1.0, steps: int = 100, tol: float = 1e-8) -> dict[tuple, Logistic]:
    """L2 logistic regression (free intercept, penalty w'w / 2c beside the summed loss) for each group, by Newton steps that never raise the loss.

    A pass is one aggregation that gives loss, gradient and curvature of all groups at the coefficients that each of them tries. A step that raises
    a group's loss is halved and tried again, so separable data end as well; ``converged`` says whether the last step was as small as ``tol``. Groups with
    one class only have no fit: intercept and coefficients are NaN, and the probability is 0.5. Rows with a null in y, a feature or the group are left out.
    """
    names = [f"_x{k}" for k in range(len(features))]
    clean = df.select(*by, F.col(y).cast("double").alias("_y"), *(F.col(f).cast("double").alias(n) for f, n in zip(features, names, strict=True))).dropna()
    rows, groups = group_numbers(clean, by)
    rows = written(rows.select("_g", "_y", *names), "logistic-rows")  # many passes over a short plan
    penalty, n = np.array([0.0] + [1 / c] * len(features)), len(names) + 1
    try:
        classes = rows.groupBy("_g").agg(F.min("_y").alias("a"), F.max("_y").alias("b")).collect()  # a row a group
        out = {g: Logistic(math.nan, [math.nan] * len(features)) for g in groups}
        live = {r["_g"]: _Path(np.zeros(n), np.zeros(n)) for r in classes if r["a"] != r["b"]}
        done: dict[int, _Path] = {}
        for _ in range(steps):
            if not live:
                break
            tried = {g: path.beta + path.step for g, path in live.items()}

            def sums(g: int, m: np.ndarray, tried: dict[int, np.ndarray] = tried) -> np.ndarray:
                if g not in tried:
                    return np.zeros(1 + n * n + n)
                x = np.column_stack([np.ones(len(m)), m[:, 1:]])
                z = x @ tried[g]
                p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
                w = np.maximum(p * (1 - p), 1e-9)
                return packed((np.maximum(z, 0) + np.log1p(np.exp(-np.abs(z))) - m[:, 0] * z).sum(), (x * w[:, None]).T @ x, x.T @ (m[:, 0] - p))

            for g, v in group_sums(rows, ["_y", *names], sums).items():
                if g not in live:
                    continue
                path, at = live[g], tried[g]
                loss = v[0] + 0.5 * float(penalty @ (at * at))
                if loss > path.loss + 1e-12 * (1 + abs(path.loss)) and path.halved < HALVINGS:
                    path.step, path.halved = path.step / 2, path.halved + 1
                    continue
                path.beta, path.loss, path.halved, path.steps = at, loss, 0, path.steps + 1
                path.step = solve(v[1 : 1 + n * n].reshape(n, n) + np.diag(penalty), v[1 + n * n :] - penalty * at)
                if np.abs(path.step).max() < tol * (1 + np.abs(at + path.step).max()):
                    path.beta, path.converged = at + path.step, True
                    done[g] = live.pop(g)
    finally:
        dropped(rows)
    for g, path in (done | live).items():
        out[groups[g]] = Logistic(float(path.beta[0]), path.beta[1:].tolist(), path.converged, path.steps)
    return out


def fit_logistic(df: DataFrame, features: Sequence[str], y: str, c: float = 1.0, steps: int = 100, tol: float = 1e-8) -> Logistic:
    """fit_logistic_groups() of a table as one group; without a row as with one class only."""
    found = fit_logistic_groups(df.withColumn(ONE, F.lit(0)), [ONE], features, y, c, steps, tol)
    return found.get((0,), Logistic(math.nan, [math.nan] * len(features)))


def with_probability(df: DataFrame, model: Logistic, features: Sequence[str], name: str = "probability") -> DataFrame:
    if model.one_class:
        return df.withColumn(name, F.lit(0.5))
    return df.withColumn(name, sigmoid(sum((b * F.col(f) for b, f in zip(model.coefficients, features, strict=True)), F.lit(model.intercept))))


def with_probabilities(df: DataFrame, by: Sequence[str], models: dict[tuple, Logistic], features: Sequence[str], name: str = "probability") -> DataFrame:
    """with_probability() by the model of each row's group; rows of groups without a model are left out."""
    betas = [f"_b{k}" for k in range(len(features) + 1)]
    rows = {g: [0.0] * len(betas) if m.one_class else [m.intercept, *m.coefficients] for g, m in models.items()}
    z = sum((F.col(b) * F.col(f) for b, f in zip(betas[1:], features, strict=True)), F.col(betas[0]))
    return df.join(_parameters(df, by, rows, betas), list(by)).withColumn(name, sigmoid(z)).drop(*betas)


def irls_step(df: DataFrame, features: Sequence[str], r: str, beta: Sequence[float]) -> list[float]:
    """One reweighted least-squares step from beta for fractional targets r."""
    x = [F.lit(1.0), *(F.col(f).cast("double") for f in features)]
    p = sigmoid(sum((b * v for b, v in zip(beta, x, strict=True)), F.lit(0.0)))
    return newton(df.agg(*gram_sums(x, p, F.col(r))).first().asDict(), list(beta))


def digamma(x: float) -> float:
    out = 0.0
    while x < 8:
        out -= 1 / x
        x += 1
    f = 1 / (x * x)
    return out + math.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f / 240)))


def trigamma(x: float) -> float:
    out = 0.0
    while x < 8:
        out += 1 / (x * x)
        x += 1
    f = 1 / (x * x)
    return out + 1 / x + f / 2 + f / x * (1 / 6 - f * (1 / 30 - f * (1 / 42 - f / 30)))


def fit_normal(df: DataFrame, column: str) -> tuple[float, float]:
    r = df.agg(F.avg(column), F.stddev_pop(column)).first()
    return r[0], r[1]


def fit_gamma(df: DataFrame, column: str) -> tuple[float, float]:
    """Shape and scale (location 0) of the positive values by maximum likelihood; only the mean and the mean log are needed."""
    r = df.where(F.col(column) > 0).agg(F.avg(column), F.avg(F.ln(column))).first()
    return gamma_of(r[0], r[1])


def gamma_of(mean: float | None, mean_log: float | None) -> tuple[float, float]:
    """Shape and scale of the gamma distribution with these means."""
    if mean is None:
        return math.nan, math.nan
    gap = math.log(mean) - mean_log
    if gap <= 0:
        return math.inf, 0.0
    k = (3 - gap + math.sqrt((gap - 3) ** 2 + 24 * gap)) / (12 * gap)
    for _ in range(50):
        step = (math.log(k) - digamma(k) - gap) / (1 / k - trigamma(k))
        k = max(k - step, k / 2)
        if abs(step) < 1e-12 * k:
            break
    return k, mean / k


def plain_values(df: DataFrame, column: str, by: Sequence[str]) -> DataFrame:
    """by and v, the column as a number; null and NaN are left out."""
    return df.select(*by, F.col(column).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))


def value_facts(values: DataFrame, by: Sequence[str]) -> list[dict]:
    """n, mean, deviation, middle, and mean and mean log of the positive values, of plain_values() by group, in the groups' order; one pass."""
    up = F.when(F.col("v") > 0, F.col("v"))
    sums = values.groupBy(*by).agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("deviation"), F.avg(up).alias("up_mean"), F.avg(F.ln(up)).alias("up_log"), F.percentile_approx("v", 0.5, 10_000).alias("mid"))
    return [r.asDict() for r in sums.orderBy(*by).collect()]  # a row a group


#: Bins of a unit of asinh((v - middle) / deviation): values that share a bin lie within 1/4000 of each other, beside the deviation or their distance from the middle.
BINS = 4000


def student_em(v: np.ndarray, n: np.ndarray, mu: float, sigma: float, steps: int) -> tuple[float, float, float]:
    """Degrees of freedom, location and scale of values v that occur n times, by EM with weights (nu + 1) / (nu + z**2)."""
    nu, sigma = 10.0, max(sigma, 1e-6)
    for _ in range(steps):
        d = v - mu
        w = (nu + 1) / (nu + (d / sigma) ** 2)
        wd, weight = n @ (w * d), n @ w
        new_mu = mu + wd / weight
        new_sigma = max(math.sqrt(max(n @ (w * d * d) - wd * wd / weight, 0.0) / n.sum()), 1e-9)
        level = 1 + n @ (np.log(w) - w) / n.sum() + digamma((nu + 1) / 2) - math.log((nu + 1) / 2)
        low, high = 0.05, 1e6  # the root of log(nu/2) - digamma(nu/2) + level
        for _ in range(80):
            mid = math.sqrt(low * high)
            low, high = (mid, high) if math.log(mid / 2) - digamma(mid / 2) + level > 0 else (low, mid)
        new_nu = math.sqrt(low * high)
        done = abs(new_mu - mu) < 1e-9 * (1 + abs(mu)) and abs(new_sigma - sigma) < 1e-9 * sigma and abs(new_nu - nu) < 1e-6 * nu
        nu, mu, sigma = new_nu, new_mu, new_sigma
        if done:
            break
    return nu, mu, sigma


def student_groups(values: DataFrame, by: Sequence[str], facts: Sequence[dict], steps: int = 60) -> dict[tuple, tuple[float, float, float]]:
    """Degrees of freedom, location and scale for each group of plain_values(): one pass over the rows, whatever the number of steps.

    Values are counted in bins whose width follows their distance from the middle; a bin stands for its values by their mean, so the error of a step's
    sums is of second order in the bins' width, some 1e-8. All steps of a group then run over its bins, of which there are some tens of thousands for any number of
    rows (5.7 million for numbers at the ends of double precision), in one task.
    """
    key = lambda r: tuple(r[g] for g in by)
    starts = {key(f): (k, f["mid"], max(f["deviation"] or 0.0, 1e-6)) for k, f in enumerate(facts)}
    known = values.join(_parameters(values, by, starts, ["_k", "_mid", "_dev"]), list(by))
    at = F.floor(F.asinh((F.col("v") - F.col("_mid")) / F.col("_dev")) * BINS)
    bins = known.groupBy(F.col("_k").cast("int").alias("k"), at.alias("bin")).agg(F.avg("v").alias("v"), F.count("v").alias("n"))
    where = {k: (mid, dev) for k, mid, dev in starts.values()}

    def fit(part: pa.Table) -> pa.Table:
        k = part["k"][0].as_py()
        order = np.argsort(part["bin"].to_numpy())  # the same sums whatever order the rows come in
        found = student_em(part["v"].to_numpy()[order], part["n"].to_numpy()[order].astype(float), *where[k], steps)
        return pa.table({"k": pa.array([k], pa.int32()), **{c: [float(x)] for c, x in zip(("nu", "mu", "sigma"), found, strict=True)}})

    fits = {r["k"]: (r["nu"], r["mu"], r["sigma"]) for r in bins.groupBy("k").applyInArrow(fit, "k int, nu double, mu double, sigma double").collect()}
    return {g: fits[k] for g, (k, _, _) in starts.items()}


def fit_student(df: DataFrame, column: str, steps: int = 60) -> tuple[float, float, float]:
    """Degrees of freedom, location and scale of a column."""
    values = plain_values(df.withColumn(ONE, F.lit(0)), column, [ONE])
    return student_groups(values, [ONE], value_facts(values, [ONE]), steps)[(0,)]


def normal_quantile(p: np.ndarray) -> np.ndarray:
    """Inverse of the standard normal distribution, by Newton steps on erfc from a rough start."""
    p = np.clip(np.asarray(p, float), 1e-300, 1 - 1e-16)
    t = np.sqrt(-2 * np.log(np.minimum(p, 1 - p)))
    x = np.where(p < 0.5, -1, 1) * (t - (2.30753 + 0.27061 * t) / (1 + 0.99229 * t + 0.04481 * t * t))
    cdf = np.vectorize(lambda v: 0.5 * math.erfc(-v / math.sqrt(2)))
    for _ in range(4):
        x = x - (cdf(x) - p) * math.sqrt(2 * math.pi) * np.exp(x * x / 2)
    return x


def _gamma_cdf(x: np.ndarray, k: float) -> np.ndarray:
    """Of shape k and scale 1: a series below k + 1, a continued fraction above."""
    out, low = np.zeros(len(x)), (x > 0) & (x < k + 1)
    high = x >= k + 1
    front = np.exp(k * np.log(np.where(x > 0, x, 1.0)) - x - math.lgamma(k))
    a = x[low]
    term = total = np.full(len(a), 1 / k)
    n = k
    while len(a) and (term > 1e-17 * total).any():
        n += 1
        term = term * a / n
        total = total + term
    out[low] = front[low] * total
    b = x[high] + 1 - k
    c, d = np.full(len(b), 1e300), 1 / b
    h, n = d, 0
    while len(b):
        n += 1
        b = b + 2
        an = -n * (n - k)
        d, c = an * d + b, b + an / c
        d = 1 / np.where(d == 0, 1e-300, d)
        c = np.where(c == 0, 1e-300, c)
        h = h * d * c
        if (np.abs(d * c - 1) < 1e-15).all() or n > 100_000:
            break
    out[high] = 1 - front[high] * h
    return out


def _beta_tail(x: np.ndarray, a: float, b: float) -> np.ndarray:
    """The regularized incomplete beta function, by its continued fraction on the side where that converges fast."""
    swap = x > (a + 1) / (a + b + 2)
    y, p, q = np.where(swap, 1 - x, x), np.where(swap, b, a), np.where(swap, a, b)
    inner = (y > 0) & (y < 1)
    front = np.where(inner, np.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + p * np.log(np.where(inner, y, 0.5)) + q * np.log1p(-np.where(inner, y, 0.5))) / p, 0.0)
    tiny = lambda v: np.where(np.abs(v) < 1e-300, 1e-300, v)
    c, d = np.ones(len(y)), 1 / tiny(1 - (p + q) * y / (p + 1))
    h = d
    for m in range(1, 100_000):
        e = m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m))
        d, c = 1 / tiny(1 + e * d), tiny(1 + e / c)
        h = h * d * c
        e = -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))
        d, c = 1 / tiny(1 + e * d), tiny(1 + e / c)
        h = h * d * c
        if (np.abs(d * c - 1) < 1e-15).all():
            break
    return np.where(swap, 1 - front * h, front * h)


def _inverse(cdf, p: np.ndarray, high: float) -> np.ndarray:
    """Of a continuous distribution on the positive axis, by halving; high is doubled until it is above all of p."""
    while len(p) and cdf(np.array([high]))[0] < p.max() and high < 1e300:
        high *= 2
    low, top = np.zeros(len(p)), np.full(len(p), high)
    for _ in range(200):
        mid = (low + top) / 2
        under = cdf(mid) < p
        low, top = np.where(under, mid, low), np.where(under, top, mid)
        if (top - low <= 1e-13 * top).all():
            break
    return (low + top) / 2


def gamma_quantile(p: np.ndarray, k: float, scale: float) -> np.ndarray:
    """Inverse of the gamma distribution at location 0."""
    return scale * _inverse(lambda x: _gamma_cdf(x, k), np.asarray(p, float), k + 1)


def student_quantile(p: np.ndarray, nu: float, mu: float = 0.0, sigma: float = 1.0) -> np.ndarray:
    """Inverse of Student's t distribution."""
    p = np.asarray(p, float)
    size = _inverse(lambda t: 1 - _beta_tail(nu / (nu + t * t), nu / 2, 0.5), np.abs(2 * p - 1), 4.0)
    return mu + sigma * np.where(p < 0.5, -size, size)


def qq_deviations_groups(df: DataFrame, column: str, by: Sequence[str]) -> dict[tuple, dict[str, float]]:
    """For each group the mean distance of all its values from the quantiles of its fitted gamma, normal and student distributions.

    The gamma distribution is fitted to the positive values. Ranks have the median positions of order statistics. Values are written once as they are
    numbered in order side by side; fits read their facts and bins, and only a few numbers a group reach the driver. NaN without a fit.
    """
    by = list(by)
    values = plain_values(df, column, by)
    facts = value_facts(values, by)
    if not facts:
        return {}
    students = student_groups(values, by, facts)
    key = lambda r: tuple(r[g] for g in by)
    fits, starts, seen = [], [], 0
    for f in facts:
        fits.append((f["n"], seen, gamma_of(f["up_mean"], f["up_log"]), f["up_mean"], (f["mean"], f["deviation"]), students[key(f)]))
        starts.append((*key(f), len(starts)))
        seen += f["n"]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*by).schema.fields)
    groups = F.broadcast(df.sparkSession.createDataFrame(starts, f"{kinds}, _group int"))  # a row a group
    rows = values.join(groups, by).select("_group", "v")
    ordered, _ = numbered(rows, [F.col("_group"), F.col("v")], "_row")

    def distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group, v, row = (batch.column(c).to_numpy() for c in ("_group", "v", "_row"))
            for g in np.unique(group):
                n, start, (k, scale), mean, (mu, sigma), (nu, mid, spread) = fits[g]
                at = np.flatnonzero(group == g)
                rank, edge = row[at] - start + 1, 0.5 ** (1 / n)
                p = np.where(rank == n, edge, np.where(rank == 1, 1 - edge, (rank - 0.3175) / (n + 0.365)))
                gamma = np.full(len(p), math.nan if mean is None else mean) if not math.isfinite(k) else gamma_quantile(p, k, scale)
                theory = (gamma, mu + sigma * normal_quantile(p), student_quantile(p, nu, mid, spread))
                yield pa.RecordBatch.from_arrays([pa.array([int(g)], pa.int32()), *(pa.array([float(np.abs(v[at] - t).sum())]) for t in theory)], ["g", *FITTED])

    sums = ordered.mapInArrow(distances, "g int, " + ", ".join(f"{c} double" for c in FITTED)).groupBy("g").agg(*(F.sum(c).alias(c) for c in FITTED)).collect()
    return {starts[r["g"]][:-1]: {c: r[c] / fits[r["g"]][0] for c in FITTED} for r in sums}


def qq_deviations(df: DataFrame, column: str) -> dict[str, float | None]:
    """qq_deviations_groups() of a table as one group."""
    return qq_deviations_groups(df.withColumn(ONE, F.lit(0)), column, [ONE]).get((0,), dict.fromkeys(FITTED))


def qq_normal(df: DataFrame, column: str, points: int = 200) -> dict[str, float]:
    """Agreement of a column's quantiles with its fitted normal: r2 of the points and their mean distance.

    Quantiles are taken at a fixed number of evenly spaced ranks, so the result that reaches the driver has a bound.
    """
    mu, sigma = fit_normal(df, column)
    at = (np.arange(points) + 0.5) / points
    own = np.array(quantile_values(df, column, at.tolist()), float)
    theory = mu + sigma * normal_quantile(at)
    return {"r2": float(np.corrcoef(theory, own)[0, 1] ** 2), "qq_deviation": float(np.abs(own - theory).mean())}


def qq_points(df: DataFrame, column: str, points: int = 200) -> DataFrame:
    """The table behind a quantile plot: p, observed, gamma, normal, student at evenly spaced ranks; no rows without a value."""
    schema = "p double, observed double, gamma double, normal double, student double"
    at = (np.arange(points) + 0.5) / points
    own = quantile_values(df, column, at.tolist())
    if own is None:
        return df.sparkSession.createDataFrame([], schema)
    values = df.select(F.col(column).cast("double").alias("v")).where(F.col(column).isNotNull() & ~F.isnan(column))
    (k, scale), (mu, sigma), (nu, mid, spread) = fit_gamma(values, "v"), fit_normal(values, "v"), fit_student(values, "v")
    gamma = gamma_quantile(at, k, scale) if math.isfinite(k) else np.full(points, math.nan)
    rows = np.column_stack([at, own, gamma, mu + sigma * normal_quantile(at), student_quantile(at, nu, mid, spread)])
    return df.sparkSession.createDataFrame([tuple(map(float, r)) for r in rows], schema)
