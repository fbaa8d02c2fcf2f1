"""Two-Gaussian mixture whose prior is a logistic function of features, fitted by expectation-maximisation.

There is one algorithm: each step fits the logistic part to the posteriors by reweighted least squares from its last coefficients on, until these
stand still (at most NEWTON_STEPS passes), and takes the moments of both parts. ``fit_local`` runs it on arrays, one model at a time.
``fit_groups`` runs it for any number of groups: those of at most ``LOCAL_ROWS`` distinct rows, which are counted first, in a task each; larger ones side
by side, where each pass is one aggregation of sums by group over a written table and only the parameters (a few numbers a group) come back to the
driver, so that no large group is ever gathered. Where a group is fitted changes nothing but the order in which its sums are added.

The logistic part sees the posteriors only through their sums by distinct vector of features. Where these are few, least squares run on the vectors, and a step
is one pass over the rows, however many passes least squares take; large groups with at most ``MOST_VECTORS`` are laid out by vector for that.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import normal_pdf, sigmoid
from ..shared import dropped, written
from .quantiles import few_distinct, quantile_values
from .sums import group_numbers, group_sums, packed

EPS = 1e-10
#: Passes of a step's least squares at most, and the relative change of coefficients at which it ends.
NEWTON_STEPS, NEWTON_TOL = 20, 1e-6
#: Rows of a group that one task fits by itself: about 100 bytes a row with ten features, and some five times that while it works.
LOCAL_ROWS = 1_000_000
#: Distinct vectors of features up to which a large group is laid out by them (a few numbers of each come to the driver), and rows to a vector for that.
MOST_VECTORS, VECTOR_ROWS = 4096, 64
#: Rows that a task lays out at once, values of a piece, and the bits of a value by which ranks are found in a pass, and values that come to the driver for them.
LAID_ROWS, PIECE, RANK_BITS, MOST_LEFT = 1 << 20, 1 << 13, 12, 100_000
FITTED_ARROW = pa.schema([("_g", pa.string()), ("beta", pa.list_(pa.float64())), *((n, pa.float64()) for n in ("mu0", "sigma0", "mu1", "sigma1")), ("iters", pa.int32()), ("converged", pa.bool_()), *((n, pa.float64()) for n in ("ll", "mp", "mr"))])
FITTED = "_g string, beta array<double>, mu0 double, sigma0 double, mu1 double, sigma1 double, iters int, converged boolean, ll double, mp double, mr double"


@dataclass
class Mixture:
    beta: list[float]
    mu0: float
    sigma0: float
    mu1: float
    sigma1: float
    iters: int = 0
    converged: bool = False
    final_log_likelihood: float = -math.inf
    mean_p: float = math.nan
    mean_r: float = math.nan
    mode: str = "em"
    warnings: list[str] = field(default_factory=list)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _pdf(x: np.ndarray, mu: float, sigma: float) -> np.ndarray:
    return np.exp(-0.5 * ((x - mu) / sigma) ** 2) / (sigma * math.sqrt(2 * math.pi))


def _log_likelihood(s: np.ndarray, p: np.ndarray, mu0: float, sigma0: float, mu1: float, sigma1: float, times: np.ndarray | float = 1.0) -> float:
    both = (1 - p + EPS) * _pdf(s, mu0, sigma0) + (p + EPS) * _pdf(s, mu1, sigma1)
    if len(both) and both.min() > 1e-290:
        return float((times * np.log(both)).sum())
    # densities that small lose digits
    a = np.log(1 - p + EPS) - 0.5 * ((s - mu0) / sigma0) ** 2 - math.log(sigma0 * math.sqrt(2 * math.pi))
    b = np.log(p + EPS) - 0.5 * ((s - mu1) / sigma1) ** 2 - math.log(sigma1 * math.sqrt(2 * math.pi))
    return float((times * np.logaddexp(a, b)).sum())


def irls(x: np.ndarray, r: np.ndarray, steps: int = 100, tol: float = NEWTON_TOL, start: np.ndarray | None = None, times: np.ndarray | float = 1.0) -> np.ndarray:
    """Logistic regression of fractional targets r by reweighted least squares; the first column of x is the intercept's. times: how often a row counts."""
    beta = np.zeros(x.shape[1]) if start is None else start.copy()
    for _ in range(steps):
        p = _sigmoid(x @ beta)
        w = times * np.maximum(p * (1 - p), 1e-9)
        gram, right = (x * w[:, None]).T @ x, x.T @ (w * (x @ beta) + times * (r - p))
        new = solve(gram, right)
        done = np.linalg.norm(new - beta) < tol * (1 + np.linalg.norm(beta))
        beta = new
        if done:
            break
    return beta


def solve(gram: np.ndarray, right: np.ndarray) -> np.ndarray:
    try:
        return np.linalg.solve(gram, right)
    except np.linalg.LinAlgError:
        return np.linalg.solve(gram + 1e-6 * np.eye(len(gram)), right)


def initial(s: np.ndarray, times: np.ndarray | None = None) -> tuple[float, float, float, float]:
    """Means and deviations (ddof 0, at least 0.1) of the halves up to and above the median. times: how often a row counts."""
    times = np.ones(len(s), np.int64) if times is None else times
    order = np.argsort(s, kind="stable")
    ends, last = np.cumsum(times[order]), int(times.sum()) - 1
    low, high = (float(s[order[np.searchsorted(ends, k, "right")]]) for k in (last // 2, (last + 1) // 2))
    below = s <= low + 0.5 * (high - low)

    def moments(part: np.ndarray, other: float) -> tuple[float, float]:
        x, n = s[part], times[part]
        if not len(x):
            return other, 0.1
        mean = float((n @ x) / n.sum())
        return mean, max(math.sqrt(float(n @ (x - mean) ** 2) / float(n.sum())), 0.1)

    mu0, sigma0 = moments(below, float((times @ s) / times.sum()))
    mu1, sigma1 = moments(~below, mu0)
    return mu0, sigma0, mu1, sigma1


def fit_local(s: np.ndarray, features: np.ndarray, steps: int = 900, tol: float = 1e-5, times: np.ndarray | None = None) -> tuple[Mixture, np.ndarray, np.ndarray]:
    """The fit of one table: s is ln(score + 1), features has no intercept column; times: how often a row counts. Also returns prior and posterior of each row."""
    mu0, sigma0, mu1, sigma1 = initial(s, times)
    times = np.ones(len(s)) if times is None else times.astype(np.float64)
    distinct, of = np.unique(features, axis=0, return_inverse=True) if features.shape[1] else (features[:1], np.zeros(len(s), np.int64))
    few, of = len(distinct) <= len(s) / 2, of.ravel()
    x = np.column_stack([np.ones(len(distinct)), distinct]) if few else np.column_stack([np.ones(len(s)), features])
    often = np.bincount(of, times) if few else times

    def logistic(r: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
        return irls(x, np.bincount(of, times * r) / often if few else r, NEWTON_STEPS, start=start, times=often)

    def prior(beta: np.ndarray) -> np.ndarray:
        return _sigmoid(x @ beta)[of] if few else _sigmoid(x @ beta)

    n0, n1 = _pdf(s, mu0, sigma0), _pdf(s, mu1, sigma1)
    beta = logistic(np.clip(n1 / (n0 + n1 + EPS), 0.01, 0.99))
    before, it, converged = -math.inf, 0, False
    for it in range(1, steps + 1):
        p = prior(beta)
        n0, n1 = _pdf(s, mu0, sigma0), _pdf(s, mu1, sigma1)
        r = np.clip(p * n1 / ((1 - p) * n0 + p * n1 + EPS), EPS, 1 - EPS)
        try:
            beta = logistic(r, beta)
        except np.linalg.LinAlgError:
            beta = beta * 0.95
        r0, r1 = times * (1 - r), times * r
        mu0, mu1 = float((r0 @ s) / (r0.sum() + EPS)), float((r1 @ s) / (r1.sum() + EPS))
        sigma0 = math.sqrt(max(float((r0 @ (s - mu0) ** 2) / (r0.sum() + EPS)), EPS))
        sigma1 = math.sqrt(max(float((r1 @ (s - mu1) ** 2) / (r1.sum() + EPS)), EPS))
        now = _log_likelihood(s, prior(beta), mu0, sigma0, mu1, sigma1, times)
        if abs(now - before) < tol * (1 + abs(before)):
            before, converged = now, it < steps
            break
        before = now
    p = prior(beta)
    n0, n1 = _pdf(s, mu0, sigma0), _pdf(s, mu1, sigma1)
    r = p * n1 / ((1 - p) * n0 + p * n1 + EPS)
    whole = times.sum()
    model = Mixture(beta.tolist(), mu0, sigma0, mu1, sigma1, it, converged, before, float((times @ p) / whole), float((times @ r) / whole))
    return warned(model), p, r


def warned(model: Mixture) -> Mixture:
    """Notes coefficients that have run away, which a converged likelihood does not show."""
    if max(map(abs, model.beta)) > 50:
        model.warnings.append("a coefficient is above 50: the prior may separate the classes")
    return model


def counted(df: DataFrame, *columns: str) -> DataFrame:
    """The distinct rows of these columns with _times, how often each occurs."""
    return df.select(*columns).groupBy(*columns).agg(F.count(F.lit(1)).alias("_times"))


def initial_table(df: DataFrame, s: str, group: Sequence[str] = (), times: str | None = None) -> DataFrame:
    """Exact median, and mean and deviation of the halves, by group. times: how often a row counts."""
    n = F.col(times) if times else F.lit(1)
    if not group:
        found = quantile_values(df, s, [0.5], times)
        both = df.withColumn("q50", F.lit(found[0] if found else None).cast("double"))
    elif few_distinct(df, s, group):
        both = df.join(F.broadcast(df.groupBy(*group).agg(F.percentile(s, 0.5, n).alias("q50"))), list(group))
    else:  # a group at a time; there are as many groups as models
        keys = [tuple(r) for r in df.select(*group).distinct().collect()]
        mine = lambda k: df.where(reduce(lambda a, b: a & b, (F.col(g).eqNullSafe(v) for g, v in zip(group, k, strict=True))))
        medians = df.sparkSession.createDataFrame([(*k, *(quantile_values(mine(k), s, [0.5], times) or [None])) for k in keys], df.select(*group).withColumn("q50", F.lit(0.0)).schema)
        both = df.join(F.broadcast(medians), list(group))
    # from the median, so that squares do not cancel
    d = F.col(s) - F.col("q50")
    halves = {"0": F.col(s) <= F.col("q50"), "1": F.col(s) > F.col("q50")}
    sums = [F.sum(F.when(c, x)).alias(f"_{k}{h}") for h, c in halves.items() for k, x in (("n", n), ("d", n * d), ("q", n * d * d))]
    mean = {h: F.col("q50") + F.col(f"_d{h}") / F.col(f"_n{h}") for h in halves}
    sigma = {h: F.sqrt(F.greatest(F.col(f"_q{h}") / F.col(f"_n{h}") - F.pow(F.col(f"_d{h}") / F.col(f"_n{h}"), 2), F.lit(0.0))) for h in halves}
    whole = both.groupBy(*group).agg(F.max("q50").alias("q50"), *sums)
    return whole.select(
        *group,
        "q50",
        mean["0"].alias("mu0"),
        F.greatest(sigma["0"], F.lit(0.1)).alias("sigma0"),
        F.coalesce(mean["1"], mean["0"]).alias("mu1"),
        F.greatest(F.coalesce(sigma["1"], F.lit(0.1)), F.lit(0.1)).alias("sigma1"),
    )


def posterior(s: Column, p: Column, mu0: Column | float, sigma0: Column | float, mu1: Column | float, sigma1: Column | float) -> Column:
    n0, n1 = normal_pdf(s, mu0, sigma0), normal_pdf(s, mu1, sigma1)
    return p * n1 / ((1 - p) * n0 + p * n1 + EPS)


def gram_sums(x: Sequence[Column], p: Column, r: Column) -> list[Column]:
    """X'WX and X'Wz of one reweighted least-squares step, as p(p+1)/2 + p sums of one aggregation."""
    w = F.greatest(p * (1 - p), F.lit(1e-9))
    n = len(x)
    gram = [F.sum(w * x[i] * x[j]).alias(f"g_{i}_{j}") for i in range(n) for j in range(i, n)]
    return gram + [F.sum(x[i] * (r - p)).alias(f"b_{i}") for i in range(n)]


def newton(row: dict, beta: list[float]) -> list[float]:
    n = len(beta)
    gram = np.zeros((n, n))
    for i in range(n):
        for j in range(i, n):
            gram[i, j] = gram[j, i] = row[f"g_{i}_{j}"]
    return (np.array(beta) + solve(gram, np.array([row[f"b_{i}"] for i in range(n)]))).tolist()


def moment_sums(s: Column, r: Column, times: Column | None = None) -> list[Column]:
    """Sums for means and variances of both parts; s should be centred, so that squares do not cancel. times: how often a row counts."""
    a, b = (r, 1 - r) if times is None else (times * r, times * (1 - r))
    return [F.sum(a).alias("r1"), F.sum(b).alias("r0"), F.sum(a * s).alias("s1"), F.sum(b * s).alias("s0"), F.sum(a * s * s).alias("q1"), F.sum(b * s * s).alias("q0")]


def log_likelihood(s: Column, p: Column, mu0: Column, sigma0: Column, mu1: Column, sigma1: Column) -> Column:
    half = 0.5 * math.log(2 * math.pi)
    a = F.ln(1 - p + EPS) - 0.5 * F.pow((s - mu0) / sigma0, 2) - F.ln(sigma0) - half
    b = F.ln(p + EPS) - 0.5 * F.pow((s - mu1) / sigma1, 2) - F.ln(sigma1) - half
    most = F.greatest(a, b)
    return most + F.ln(F.exp(a - most) + F.exp(b - most))


def fit_groups(df: DataFrame, group: str, s: str, features: Sequence[str], steps: int = 900, tol: float = 1e-5, local_rows: int | None = None) -> dict[str, Mixture]:
    """One model for each value of group (null groups are left out); s is ln(score + 1).

    Groups with few vectors of features and more distinct rows than that are laid out as they are, so that no row is shuffled. Of the others equal rows are counted and written once, and
    every pass reads the distinct ones. In groups of more than local_rows distinct rows (LOCAL_ROWS if None) every pass covers all such groups that have not stopped.
    """
    whole = df.where(F.col(group).isNotNull()).select(F.col(group).cast("string").alias("_g"), F.col(s).cast("double").alias("_s"), *(F.col(f).cast("double").alias(f) for f in features))
    most = LOCAL_ROWS if local_rows is None else local_rows
    sizes = {r["_g"]: r["count"] for r in whole.groupBy("_g").count().collect()}  # a row a model
    some = [g for g, n in sizes.items() if n > 0.8 * most]
    laid = _few_vectors(whole.where(F.col("_g").isin(some)), features, sum(sizes[g] for g in some), 0.8 * most) if some else []
    models = _fit_laid(whole.where(F.col("_g").isin(laid)), features, steps, tol) if laid else {}
    if len(laid) < len(sizes):
        rest = written(counted(whole.where(~F.col("_g").isin(laid)) if laid else whole, "_g", "_s", *features), "mixture-counted")
        try:
            models |= _fit_counted(rest, features, steps, tol, most)
        finally:
            dropped(rest)
    return {g: warned(m) for g, m in sorted(models.items())}


def _few_vectors(whole: DataFrame, features: Sequence[str], n: int, least: float) -> list[str]:
    """Groups of more than least distinct rows and at most MOST_VECTORS vectors of features, as one class of the distinct rows by hash tells: this decides on the way only, never on a result."""
    classes = max(n // 200_000, 1)
    mine = whole.where(F.pmod(F.xxhash64("_s", *features), F.lit(classes)) == 0).distinct().groupBy("_g")
    vectors = F.count_distinct(F.xxhash64(*features)) if features else F.lit(1)
    return [r["_g"] for r in mine.agg(F.count(F.lit(1)).alias("d"), vectors.alias("v")).collect() if r["d"] * classes > least and r["v"] <= min(MOST_VECTORS, r["d"] * classes / VECTOR_ROWS)]


def _fit_counted(whole: DataFrame, features: Sequence[str], steps: int, tol: float, local_rows: int) -> dict[str, Mixture]:
    sizes = {r["_g"]: r["count"] for r in whole.groupBy("_g").count().collect()}  # a row a model
    large = [g for g, n in sizes.items() if n > local_rows]

    def fit_one(part: pa.Table) -> pa.Table:
        x = np.column_stack([part.column(f).to_numpy() for f in features]) if features else np.zeros((part.num_rows, 0))
        m, _, _ = fit_local(part.column("_s").to_numpy(), x, steps, tol, part.column("_times").to_numpy())
        return pa.Table.from_pylist([{"_g": part.column("_g")[0].as_py(), "beta": m.beta, **{n: getattr(m, n) for n in ("mu0", "sigma0", "mu1", "sigma1", "iters", "converged")}, "ll": m.final_log_likelihood, "mp": m.mean_p, "mr": m.mean_r}], schema=FITTED_ARROW)

    models: dict[str, Mixture] = {}
    if len(large) < len(sizes):
        small = whole.where(~F.col("_g").isin(large)) if large else whole
        for r in small.groupBy("_g").applyInArrow(fit_one, FITTED).collect():
            models[r["_g"]] = Mixture(list(r["beta"]), r["mu0"], r["sigma0"], r["mu1"], r["sigma1"], r["iters"], r["converged"], r["ll"], r["mp"], r["mr"])
    if large:
        models |= _fit_large(whole.where(F.col("_g").isin(large)), features, steps, tol)
    return models


#: A piece: the values of some rows of one group and vector of features, as doubles.
LAID = pa.schema([("_g", pa.string()), ("x", pa.binary()), ("s", pa.binary())])


def _lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cuts rows of _g, _s and features into pieces, some LAID_ROWS at a time."""

    def pieces(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        part = pa.Table.from_batches(held)
        code, columns = np.zeros(part.num_rows, np.int64), [part.column(k).combine_chunks().dictionary_encode() for k in (0, *range(2, part.num_columns))]
        for c in columns:
            code = code * (len(c.dictionary) + 1) + c.indices.fill_null(len(c.dictionary)).to_numpy()
            code = pa.array(code).dictionary_encode().indices.to_numpy().astype(np.int64)  # stays below the number of rows
        order = np.argsort(code.astype(np.uint16) if code.max() < 1 << 16 else code, kind="stable")  # 16 bits: a radix sort
        code, s = code[order], part.column(1).to_numpy()[order]
        cuts = [0, *(np.flatnonzero(code[1:] != code[:-1]) + 1).tolist(), len(s)]
        heads = part.take(pa.array(order[cuts[:-1]]))
        x = np.array([heads.column(k).to_numpy() for k in range(2, part.num_columns)], np.float64).reshape(part.num_columns - 2, len(cuts) - 1)
        out = [(g, x[:, i].tobytes(), s[k : min(k + PIECE, b)].tobytes()) for i, (g, (a, b)) in enumerate(zip(heads.column(0).to_pylist(), pairwise(cuts), strict=True)) for k in range(a, b, PIECE)]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), LAID, strict=True)], schema=LAID)

    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= LAID_ROWS:
            yield pieces(held)
            held, n = [], 0
    if n:
        yield pieces(held)


Sums = Callable[[int, np.ndarray], Iterator[tuple[int, int, np.ndarray]]]


def _piece_sums(pieces: DataFrame, numbers: dict[tuple[str, bytes], int], f: Sums, width: int) -> dict[tuple[int, int], np.ndarray]:
    """The sums over all pieces of the vectors that f(number of group and features, values) gives, each with two keys.

    Vectors longer than width are handed on by entry, those that are not 0: the second key is then that of the vector times its length and the place in it.
    """
    names = [f"c{k}" for k in range(width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for g, x, held in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                for a, b, add in f(numbers[g, x], np.frombuffer(held.as_buffer())):
                    total[a, b] = total[a, b] + add if (a, b) in total else add
        long = [(a, b, v) for (a, b), v in total.items() if len(v) > width]
        total = {k: v for k, v in total.items() if len(v) <= width} | {(a, b * len(v) + k): v[k : k + 1] for a, b, v in long for k in np.flatnonzero(v).tolist()}
        if total:
            a, b = zip(*total, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int64()), *map(pa.array, np.array(list(total.values()), np.float64).T)], ["a", "b", *names])

    found = pieces.mapInArrow(run, "a int, b bigint, " + ", ".join(f"{c} double" for c in names)).groupBy("a", "b").agg(*(F.sum(c).alias(c) for c in names))
    return {(r[0], r[1]): np.array(r[2:]) for r in found.collect()}


def _in_order(s: np.ndarray) -> np.ndarray:
    """Whole numbers that are ordered as these values are."""
    bits = s.view(np.int64)
    return (bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))).view(np.uint64) ^ np.uint64(1 << 63)


def _in_value(order: int) -> float:
    bits = np.array([order], np.uint64) ^ np.uint64(1 << 63)
    return float((bits.view(np.int64) ^ ((bits.view(np.int64) >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))).view(np.float64)[0])


def _medians(sums: Callable[[Sums, int], dict[tuple[int, int], np.ndarray]], group: np.ndarray) -> dict[int, float]:
    """The exact median of each group: its two middle ranks are followed down by RANK_BITS of the values at a time, all of them once few are left."""
    shift, wanted, before = 64 - RANK_BITS, {}, None  # by group: for both ranks the leading bits and the rank among the values that have them
    while True:

        def count(v: int, s: np.ndarray, shift: int = shift, before: int | None = before, wanted: dict = wanted) -> Iterator[tuple[int, int, np.ndarray]]:
            g, x = int(group[v]), _in_order(s[~np.isnan(s)])
            for lead in {k for k, _ in wanted.get(g, [(0, 0)])}:
                inside = x if before is None else x[x >> np.uint64(before) == np.uint64(lead)]
                if shift:
                    yield g, lead, np.bincount((inside >> np.uint64(shift) & np.uint64((1 << RANK_BITS) - 1)).astype(np.int64), minlength=1 << RANK_BITS)
                else:
                    for k, n in zip(*np.unique(inside, return_counts=True), strict=True):
                        yield g, int(k.astype(np.int64)), np.array([n])

        counts: dict[int, dict[int, int]] = {}
        for (g, k), n in sums(count, 1).items():
            counts.setdefault(g, {})[k % (1 << 64)] = int(n[0])
        most = 0
        for g, found in counts.items():
            if before is None:
                n = sum(found.values())
                wanted[g] = [(0, (n - 1) // 2), (0, n // 2)]
            new = []
            for lead, rank in wanted[g]:
                for k in sorted(found):
                    if before is not None and k >> (before - shift) != lead:
                        continue
                    if rank < found[k]:
                        most = max(most, found[k])
                        new.append((k, rank))
                        break
                    rank -= found[k]
            wanted[g] = new
        if not shift:
            values = {g: [_in_value(k) for k, _ in w] for g, w in wanted.items()}
            return {g: low + 0.5 * (high - low) for g, (low, high) in values.items()}
        wanted, before, shift = dict(wanted), shift, 0 if most <= MOST_LEFT or shift <= RANK_BITS else shift - RANK_BITS


def _fit_laid(df: DataFrame, features: Sequence[str], steps: int, tol: float) -> dict[str, Mixture]:
    """df: _g (a name), _s and the features, of few distinct vectors. A step is one pass, which also tells the likelihood that the step before has reached."""
    data = written(df.select("_g", "_s", *features).mapInArrow(_lay, "_g string, x binary, s binary"), "mixture-laid", "none")
    try:
        found = sorted((r["_g"], bytes(r["x"]), r["n"]) for r in data.groupBy("_g", "x").agg((F.sum(F.octet_length("s")) / 8).alias("n")).collect())  # about MOST_VECTORS a group
        names, numbers = sorted({g for g, *_ in found}), {(g, b): k for k, (g, b, _) in enumerate(found)}
        group, often = np.array([names.index(g) for g, *_ in found]), np.array([n for *_, n in found])
        x = np.column_stack([np.ones(len(found)), np.array([np.frombuffer(b) for _, b, _ in found]).reshape(len(found), len(features))])
        of = {g: np.flatnonzero(group == g) for g in range(len(names))}
        mid = {g: math.nan for g in of} | _medians(lambda f, width: _piece_sums(data, numbers, f, width), group)

        def halves(v: int, s: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
            d = s - mid[int(group[v])]
            for h, part in enumerate((d[~(d > 0)], d[d > 0])):
                yield int(group[v]), h, np.array([len(part), part.sum(), (part * part).sum()])

        part, models = _piece_sums(data, numbers, halves, 3), {}
        for g in of:
            (n0, d0, q0), (n1, d1, q1) = part[g, 0], part[g, 1]
            low = mid[g] + d0 / n0, max(math.sqrt(max(q0 / n0 - (d0 / n0) ** 2, 0.0)), 0.1)
            high = (mid[g] + d1 / n1, max(math.sqrt(max(q1 / n1 - (d1 / n1) ** 2, 0.0)), 0.1)) if n1 else (low[0], 0.1)
            models[g] = Mixture([0.0] * x.shape[1], *map(float, (*low, *high)))

        def passed(live: set[int], first: bool = False) -> dict[int, np.ndarray]:
            """By group, a row a vector: sums of a step's moments, of the likelihood and of posteriors at the parameters as they are."""
            prior = np.zeros(len(found))
            for g in live:
                prior[of[g]] = _sigmoid(x[of[g]] @ np.array(models[g].beta))
            fits = {g: (m.mu0, m.sigma0, m.mu1, m.sigma1, mid[g]) for g, m in models.items() if g in live}

            def step(v: int, s: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
                if int(group[v]) not in fits:
                    return
                (mu0, sigma0, mu1, sigma1, middle), p = fits[int(group[v])], float(prior[v])
                n0, n1 = _pdf(s, mu0, sigma0), _pdf(s, mu1, sigma1)
                if first:
                    r, ll = n1 / (n0 + n1 + EPS), 0.0
                else:
                    r, both = p * n1 / ((1 - p) * n0 + p * n1 + EPS), (1 - p + EPS) * n0 + (p + EPS) * n1
                    ll = float(np.log(both).sum()) if both.min() > 1e-290 else _log_likelihood(s, np.float64(p), mu0, sigma0, mu1, sigma1)
                r1 = np.clip(r, *((0.01, 0.99) if first else (EPS, 1 - EPS)))
                d, r0 = s - middle, 1 - r1  # from the group's median, so that squares do not cancel
                dd = d * d
                yield v, 0, np.array([r1.sum(), r0.sum(), r1 @ d, r0 @ d, r1 @ dd, r0 @ dd, ll, r.sum()])

            sums = _piece_sums(data, numbers, step, 8)
            return {g: np.array([sums[int(v), 0] for v in of[g]]) for g in live}

        for g, v in passed(set(models), True).items():
            models[g].beta = irls(x[of[g]], v[:, 0] / often[of[g]], NEWTON_STEPS, times=often[of[g]]).tolist()
        live, last = set(models), {g: -math.inf for g in models}
        for it in range(steps + 1):
            if not live:
                break
            for g, v in passed(live).items():
                m, here, n, (r1, r0, s1, s0, q1, q0, ll, mr) = models[g], x[of[g]], often[of[g]], v.sum(axis=0).tolist()
                m.mean_p, m.mean_r = float(n @ _sigmoid(here @ np.array(m.beta)) / n.sum()), mr / float(n.sum())
                if it:
                    still = abs(ll - last[g]) < tol * (1 + abs(last[g]))
                    m.iters, m.final_log_likelihood, m.converged, last[g] = it, ll, still and it < steps, ll
                    if still or it == steps:
                        live.discard(g)
                        continue
                try:
                    m.beta = irls(here, v[:, 0] / n, NEWTON_STEPS, start=np.array(m.beta), times=n).tolist()
                except np.linalg.LinAlgError:
                    m.beta = [0.95 * b for b in m.beta]
                d0, d1 = s0 / (r0 + EPS), s1 / (r1 + EPS)
                m.sigma0 = math.sqrt(max((q0 - 2 * d0 * s0 + d0**2 * r0) / (r0 + EPS), EPS))
                m.sigma1 = math.sqrt(max((q1 - 2 * d1 * s1 + d1**2 * r1) / (r1 + EPS), EPS))
                m.mu0, m.mu1 = mid[g] + d0, mid[g] + d1
        return {names[g]: m for g, m in models.items()}
    finally:
        dropped(data)


def _fit_large(df: DataFrame, features: Sequence[str], steps: int, tol: float) -> dict[str, Mixture]:
    """df: _g (a name), _s, the features and _times."""
    numbered, groups = group_numbers(df.withColumnRenamed("_g", "_name"), ["_name"])
    data, n = written(numbered.select("_g", "_s", *features, "_times"), "mixture-rows"), len(features) + 1
    try:
        start = {r["_g"]: r for r in initial_table(data, "_s", ["_g"], "_times").collect()}
        models = {g: Mixture([0.0] * n, r["mu0"], r["sigma0"], r["mu1"], r["sigma1"]) for g, r in start.items()}
        live, last = set(models), {g: -math.inf for g in models}
        for it in range(steps + 1):  # the first one only starts the logistic part
            if not live:
                break
            old = {g: (np.array(models[g].beta), models[g].mu0, models[g].sigma0, models[g].mu1, models[g].sigma1, start[g]["q50"]) for g in live}
            open_, sums = set(live), {}
            for _ in range(NEWTON_STEPS):
                now = {g: np.array(models[g].beta) for g in open_}

                def step(g: int, m: np.ndarray, now: dict = now, old: dict = old, first: bool = it == 0) -> np.ndarray:
                    if g not in now:
                        return np.zeros(n * n + n + 6)
                    beta, mu0, sigma0, mu1, sigma1, mid = old[g]
                    s, x, times = m[:, 0], np.column_stack([np.ones(len(m)), m[:, 1:-1]]), m[:, -1]
                    n0, n1 = _pdf(s, mu0, sigma0), _pdf(s, mu1, sigma1)
                    p = _sigmoid(x @ beta)
                    r = np.clip(n1 / (n0 + n1 + EPS), 0.01, 0.99) if first else np.clip(p * n1 / ((1 - p) * n0 + p * n1 + EPS), EPS, 1 - EPS)
                    p = _sigmoid(x @ now[g])
                    w = times * np.maximum(p * (1 - p), 1e-9)
                    d, r0, r1 = s - mid, times * (1 - r), times * r  # from the group's median, so that squares do not cancel
                    return packed((x * w[:, None]).T @ x, x.T @ (times * (r - p)), r1.sum(), r0.sum(), r1 @ d, r0 @ d, r1 @ (d * d), r0 @ (d * d))

                sums |= {g: v for g, v in group_sums(data, ["_s", *features, "_times"], step).items() if g in open_}
                for g in sorted(open_):
                    v = sums[g]
                    try:
                        new = now[g] + solve(v[: n * n].reshape(n, n), v[n * n : n * n + n])
                    except np.linalg.LinAlgError:
                        new = 0.95 * old[g][0]
                        open_.discard(g)
                    if np.linalg.norm(new - now[g]) < NEWTON_TOL * (1 + np.linalg.norm(now[g])):
                        open_.discard(g)
                    models[g].beta = new.tolist()
                if not open_:
                    break
            if it == 0:
                continue
            for g, v in sums.items():
                m, (r1, r0, s1, s0, q1, q0) = models[g], v[n * n + n :].tolist()
                d0, d1 = s0 / (r0 + EPS), s1 / (r1 + EPS)
                m.sigma0 = math.sqrt(max((q0 - 2 * d0 * s0 + d0**2 * r0) / (r0 + EPS), EPS))
                m.sigma1 = math.sqrt(max((q1 - 2 * d1 * s1 + d1**2 * r1) / (r1 + EPS), EPS))
                m.mu0, m.mu1 = start[g]["q50"] + d0, start[g]["q50"] + d1
            fits = {g: models[g] for g in live}

            def end(g: int, m: np.ndarray, fits: dict = fits) -> np.ndarray:
                if g not in fits:
                    return np.zeros(4)
                f, s, times = fits[g], m[:, 0], m[:, -1]
                p = _sigmoid(np.column_stack([np.ones(len(m)), m[:, 1:-1]]) @ np.array(f.beta))
                n0, n1 = _pdf(s, f.mu0, f.sigma0), _pdf(s, f.mu1, f.sigma1)
                return packed(_log_likelihood(s, p, f.mu0, f.sigma0, f.mu1, f.sigma1, times), times @ p, times @ (p * n1 / ((1 - p) * n0 + p * n1 + EPS)), times.sum())

            for g, v in group_sums(data, ["_s", *features, "_times"], end).items():
                if g not in live:
                    continue
                m = models[g]
                m.iters, m.final_log_likelihood, m.mean_p, m.mean_r = it, float(v[0]), float(v[1] / v[3]), float(v[2] / v[3])
                if abs(v[0] - last[g]) < tol * (1 + abs(last[g])):
                    m.converged = it < steps
                    live.discard(g)
                last[g] = v[0]
        return {groups[g][0]: m for g, m in models.items()}
    finally:
        dropped(data)


def with_posterior(df: DataFrame, model: Mixture, s: str, features: Sequence[str]) -> DataFrame:
    """Adds prior_p and posterior_r."""
    z = sum((b * F.col(f) for b, f in zip(model.beta[1:], features, strict=True)), F.lit(model.beta[0]))
    out = df.withColumn("prior_p", sigmoid(z))
    return out.withColumn("posterior_r", posterior(F.col(s), F.col("prior_p"), model.mu0, model.sigma0, model.mu1, model.sigma1))


def with_posteriors(df: DataFrame, models: dict[str, Mixture], group: str, s: str, features: Sequence[str]) -> DataFrame:
    """Adds prior_p and posterior_r by the model of each row's group; rows of groups without a model are left out."""
    names = [*(f"_b{k}" for k in range(len(features) + 1)), "_mu0", "_sigma0", "_mu1", "_sigma1"]
    rows = [(g, *map(float, (*m.beta, m.mu0, m.sigma0, m.mu1, m.sigma1))) for g, m in models.items()]
    table = df.sparkSession.createDataFrame(rows, "_g string, " + ", ".join(f"{c} double" for c in names))
    out = df.join(F.broadcast(table), F.col(group).cast("string") == F.col("_g"))  # a row a model
    z = sum((F.col(f"_b{k + 1}") * F.col(f) for k, f in enumerate(features)), F.col("_b0"))
    out = out.withColumn("prior_p", sigmoid(z))
    return out.withColumn("posterior_r", posterior(F.col(s), F.col("prior_p"), *(F.col(c) for c in names[-4:]))).drop("_g", *names)
