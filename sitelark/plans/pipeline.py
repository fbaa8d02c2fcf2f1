"""The five stages as functions from DataFrames to DataFrames: scan, accessibility, annotation, model, evaluation."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import asdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..operators import baselines, features, intervals, metrics, mixture, sequence
from ..operators import signal as sig
from ..shared import dropped, written

FEATURES = ("inner_mean_logPWM", "outer_mean_logPWM", "GC_inner_pct", "GC_outer_pct", "TSS_proximity", "PhastCons100_percent", "TPM", "score_phastcons100", "score_phylop100")
#: In legacy mode the columns are scaled with their indices off by one: these are scaled, the rest stay raw.
LEGACY_SCALED = (0, 1, 2, 5, 7)
FIXED_SCALED = (0, 1, 2, 3, 6, 8)
RAW = ("TSS_proximity", "PhastCons100_percent", "score_phastcons100")


def scan(seqs: DataFrame, logp: np.ndarray, inner: int = 50, outer: int = 500, top: int = 2_000_000, bottom: int = 2_000_000, background: Sequence[float] | None = None, background_from_seqs: bool = False) -> tuple[DataFrame, DataFrame]:
    """The top and bottom sites over all contigs and both strands, each in output order. A background from the sequences wins over a given one."""
    if background_from_seqs:
        share = {r["base"]: r["share"] for r in sequence.base_composition(seqs).collect()}  # four rows
        background = [share[b] for b in "ACGT"]
    weights = sequence.log_ratios(logp, np.full(4, 0.25) if background is None else np.asarray(background))
    names = {"inner_mean": "inner_mean_logPWM", "outer_mean": "outer_mean_logPWM", "gc_inner_pct": "GC_inner_pct", "gc_outer_pct": "GC_outer_pct"}

    best, worst = sequence.scan_ends(seqs, weights, inner, outer, top, bottom)
    return tuple(sequence.in_output_order(x).withColumnsRenamed(names) for x in (best, worst))


def accessibility(sites: DataFrame, native: DataFrame, fixed: DataFrame, inner: int = 50, outer: int = 500, threshold: int = sig.THRESHOLD, dense: bool = False, by: Sequence[str] = (), tracks: Sequence[str] = ()) -> DataFrame:
    """Adds id, t_native, t_fixed and s_l to scanned sites (chrom, pos1, strand). native and fixed: chrom, strand, at, val, depth.

    By points only sites whose four windows have threshold rows stay; dense tracks (chrom, strand, start, end, val: a value per base, as runs) keep
    every site. by: columns that, with the site, tell rows apart where several tables of sites are scored at once. tracks: columns of sites, native and
    fixed alike that say which tracks a site is scored by.
    """
    named = sites.withColumn("id", X.site_id(F.col("chrom"), F.col("pos1"), F.col("strand"))).withColumn("site", F.concat_ws("\u0001", *by, "id"))
    both = native.withColumn("cond", F.lit("native")).unionByName(fixed.withColumn("cond", F.lit("fixed")))
    score = sig.site_score_dense if dense else sig.site_score
    scored = score(named.select("site", "chrom", "strand", *tracks, F.col("pos1").alias("pos")), both, inner, outer, threshold, ("chrom", "strand", *tracks))
    return named.join(scored, "site", "inner").select("id", *(c for c in named.columns if c not in ("id", "site")), *(c for c in scored.columns if c != "site"))


def annotation(sites: DataFrame, exons: DataFrame, regions: DataFrame, expression: DataFrame, phastcons: DataFrame, phylop: DataFrame, half: int = 50, collapse: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Adds transcript, conservation and expression features.

    sites: id, chrom, pos1, strand and others. exons: chrom, strand, transcript_id, exon_start, exon_end. regions: chrom, start, end. expression:
    transcript_id, TPM. phastcons, phylop: chrom, start, end, score; sites that no interval of both covers are dropped. A site with several
    regions has a row for each; collapse='max' keeps the most covered. by: columns that, with id, tell rows apart where several tables of sites are
    annotated at once.
    """
    base = sites.withColumn("chrom", X.bare_chromosome(F.col("chrom"))).withColumn("_key", F.concat_ws("\u0001", *by, "id"))
    tx = intervals.map_to_transcripts(base, exons, "_key", "pos1")
    tx = tx.withColumn("TSS_proximity", X.tss_proximity(F.col("transcript_start"))).withColumn("Tx_percent", X.transcript_share(F.col("transcript_start"), F.col("transcript_length")))
    spans = tx.withColumn("_s", F.col("pos1") - half).withColumn("_e", F.col("pos1") + half)
    r = regions.select("chrom", F.col("start").alias("_rs"), F.col("end").alias("_re"))
    joined = intervals.overlap_join(spans, r, ("chrom",), ("_s", "_e"), ("_rs", "_re"), "left", ("_key",))
    joined = joined.withColumn("PhastCons100_percent", X.overlap_fraction(F.col("_s"), F.col("_e"), F.col("_rs"), F.col("_re"), 2 * half)).drop("_rs", "_re")
    if collapse == "max":
        names = [c for c in joined.columns if c not in ("_key", "PhastCons100_percent")]
        joined = joined.groupBy("_key").agg(*(F.first(c).alias(c) for c in names), F.max("PhastCons100_percent").alias("PhastCons100_percent"))
    filled = features.lookup_or(joined, expression, "transcript_id", "TPM")
    near = filled.groupBy("chrom").agg(F.min("_s").alias("_a"), F.max("_s").alias("_b")).where(F.col("chrom").isNotNull()).collect()  # a row a chromosome
    for table, name in ((phastcons, "score_phastcons100"), (phylop, "score_phylop100")):
        scores = near_scores(table, {r["chrom"]: (r["_a"], r["_b"]) for r in near}).select("chrom", F.col("start").alias("_c0"), F.col("end").alias("_c1"), F.col("score").alias(name))
        filled = intervals.asof_contains(filled, scores, ("chrom",), "_s", "_c0", "_c1", (name,)).drop("_c0", "_c1")
    return filled.drop("_s", "_e", "_key")


def near_scores(scores: DataFrame, spans: dict[str, tuple[int, int]]) -> DataFrame:
    """Of chrom, start, end, score the rows that touch the span of their own chromosome.

    Chromosomes without a span are never read where the table is partitioned by chrom; the widest span bounds what is read in the others' files, and
    each chromosome's own span what of it goes on.
    """
    if not spans:
        return scores.where("false")
    inside = (F.col("start") <= max(b for _, b in spans.values())) & (F.col("end") >= min(a for a, _ in spans.values()))
    pruned = scores.where(F.col("chrom").isin(sorted(spans)) & inside)
    own = scores.sparkSession.createDataFrame([(c, a, b) for c, (a, b) in spans.items()], "chrom string, _from bigint, _to bigint")
    return pruned.join(F.broadcast(own), "chrom").where((F.col("start") <= F.col("_to")) & (F.col("end") >= F.col("_from"))).drop("_from", "_to")  # a row a chromosome


def scaled_columns(feature_columns: Sequence[str], legacy: bool = False) -> list[str]:
    """The features that are z-scored; the others of FEATURES are ratios and stay raw. Other lists are scaled whole."""
    which = LEGACY_SCALED if legacy else FIXED_SCALED if tuple(feature_columns) == FEATURES else [k for k, c in enumerate(feature_columns) if c not in RAW]
    return [feature_columns[k] for k in which if k < len(feature_columns)]


def model(sites: DataFrame, feature_columns: Sequence[str] = FEATURES, score: str = "s_l", mode: str = "em", steps: int = 900, tol: float = 1e-5, legacy: bool = False) -> tuple[DataFrame, mixture.Mixture]:
    """Fits the mixture on all rows as one group; returns the usable rows with prior_p and posterior_r, and the model."""
    rows, fitted = model_groups(sites.withColumn("_one", F.lit("all")), "_one", feature_columns, score, mode, steps, tol, legacy)
    if "all" not in fitted:
        raise ValueError("no row has a finite score and finite features")
    return rows.drop("_one"), fitted["all"]


def model_groups(sites: DataFrame, group: str, feature_columns: Sequence[str] = FEATURES, score: str = "s_l", mode: str = "em", steps: int = 900, tol: float = 1e-5, legacy: bool = False) -> tuple[DataFrame, dict[str, mixture.Mixture]]:
    """A mixture for each value of group, all fitted side by side; features are scaled within their group.

    Returns the usable rows with prior_p and posterior_r, and the models. Groups without a usable row, and rows without a group, are left out.
    """
    if mode != "em":
        raise ValueError(f"no such mode: {mode}")
    clean = features.model_input(sites, feature_columns, score, legacy).where(F.col(group).isNotNull())
    scaled_names = scaled_columns(feature_columns, legacy)
    scaled = features.zscored(clean, scaled_names, by=(group,))
    used = [f"{c}_z" if c in scaled_names else c for c in feature_columns]
    ready = scaled.withColumn("_log", F.ln(F.col(score) + 1))
    fitted = mixture.fit_groups(ready, group, "_log", used, steps, tol)
    out = mixture.with_posteriors(ready, fitted, group, "_log", used)
    return out.drop("_log", *(f"{c}_z" for c in scaled_names)), fitted


#: The column that tells models apart, and what metrics are taken of: the matrix score, the posterior, and both baselines.
TITLE, SCORES = "_title", ("control", "em", "lr", "lr_sl")


def evaluation(modelled: DataFrame, peaks: DataFrame, structured: DataFrame, fitted: mixture.Mixture | None = None, feature_columns: Sequence[str] = FEATURES, limit: float = 1.0, half: int = 50, title: str = "", legacy: bool = False) -> dict[str, DataFrame]:
    """evaluation_groups() of one model: tables labelled, metrics, coefficients, coefficients_sl."""
    one = lambda df: df.withColumn(TITLE, F.lit(title))
    out = evaluation_groups(one(modelled), one(peaks), structured, {title: fitted} if fitted else {}, feature_columns, limit, half, legacy)
    return {name: table.drop(TITLE) for name, table in out.items()}


def evaluation_groups(modelled: DataFrame, peaks: DataFrame, structured: DataFrame, fitted: dict[str, mixture.Mixture], feature_columns: Sequence[str] = FEATURES, limit: float = 1.0, half: int = 50, legacy: bool = False) -> dict[str, DataFrame]:
    """Labels sites by overlap and measures the posterior and two supervised baselines, of any number of models in the same passes.

    modelled: TITLE, id, posterior_r, prior_p, s_l, score_phastcons100 and the features. peaks: TITLE, chrom, strand, start, end; structured, the same for all
    models, without TITLE. All sites are labelled and counted (``motif_df``); those with a finite score and finite features are measured (``out_df``),
    as the model saw them: of the features only scaled_columns() are z-scored, over all these sites of the model and before the undetermined ones are left
    out. Returns tables labelled, metrics, coefficients and coefficients_sl, each with TITLE; the number of jobs does not depend on the number of models.
    """
    spark, by = modelled.sparkSession, [TITLE]
    features.require_columns(modelled, [TITLE, "id", "posterior_r", "prior_p", "s_l", "score_phastcons100", "PhastCons100_percent", *feature_columns])
    for table, names in ((peaks, by), (structured, [])):
        features.require_columns(table, [*names, "chrom", "strand", "start", "end"])
    chrom, pos, strand = X.parsed_site_id(F.col("id"))
    keyed = modelled.withColumn("_key", F.concat(TITLE, F.lit("\u0001"), "id"))
    placed = keyed.select("_key", TITLE, chrom.alias("chrom"), pos.alias("_p"), strand.alias("strand"))
    spans = placed.select("_key", TITLE, "chrom", "strand", (F.col("_p") - half).alias("_s"), (F.col("_p") + half).alias("_e"))
    hit = lambda t, *key: intervals.overlap_pairs(spans, t.select(*key, F.col("start").alias("_a"), F.col("end").alias("_b")), key, ("_s", "_e"), ("_a", "_b")).select("_key")
    every = written(features.label_sites(keyed, hit(peaks, TITLE, "chrom", "strand"), hit(structured, "chrom", "strand"), "_key", "score_phastcons100", limit).drop("_key"), "labelled-sites")
    clean = features.model_input(every, feature_columns, "s_l", legacy)
    labelled = written(features.oriented(clean, "posterior_r", "PhastCons100_percent", ["posterior_r", "prior_p"], by), "measured-sites")  # stays: it is returned
    scratch = [every]
    labels = ("clip_bound", "clip_unbound", "non_determined")
    rows_of = lambda df: {r[TITLE]: r.asDict() for r in df.collect()}  # noqa: E731  a row a model
    try:
        numbers = lambda df: rows_of(df.groupBy(TITLE).agg(*(F.count_if(F.col("label") == k).alias(k) for k in labels)))
        counts, all_counts = numbers(labelled), numbers(every)
        titles = sorted(all_counts)
        scaled_names = scaled_columns(feature_columns, legacy)
        scaled = features.zscored(labelled.withColumn("log_s", F.ln(F.col("s_l") + 1)), [*scaled_names, "log_s"], by=by)
        scaled = written(scaled.where("label <> 'non_determined'").withColumn("y", F.when(F.col("label") == "clip_bound", 1).otherwise(0)), "scaled-sites")
        scratch.append(scaled)
        zs = [f"{c}_z" if c in scaled_names else c for c in feature_columns]
        plain, with_s = baselines.fit_logistic_groups(scaled, by, zs, "y"), baselines.fit_logistic_groups(scaled, by, ["log_s_z", *zs], "y")
        guessed = baselines.with_probabilities(baselines.with_probabilities(scaled, by, plain, zs, "_lr"), by, with_s, ["log_s_z", *zs], "_lr_sl") if plain else scaled.withColumns({"_lr": F.lit(0.5), "_lr_sl": F.lit(0.5)})
        control = F.col("inner_mean_logPWM").cast("double") if "inner_mean_logPWM" in modelled.columns else F.lit(None).cast("double")
        by_score = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), c.alias("value")) for k, c in zip(SCORES, (control, F.col("posterior_r"), F.col("_lr"), F.col("_lr_sl")), strict=True))))
        long = guessed.select(TITLE, "y", by_score.alias("_v")).select(TITLE, "y", "_v.kind", "_v.value")
        run = written(metrics.running_by_score(long, "value", "y", by=[TITLE, "kind"]), "running-totals")
        scratch.append(run)
        aucs = {(r[TITLE], r["kind"]): r["auc"] for r in metrics.roc_auc_of(run, [TITLE, "kind"]).collect()}  # four rows a model
        em = run.where("kind = 'em'")
        aps, f1s = rows_of(metrics.average_precision_of(em, by)), rows_of(metrics.best_f1_of(em, by))
        at_fpr = {name: rows_of(metrics.precision_at_fpr_of(em, t, by)) for t, name in ((0.1, "10pct"), (0.01, "1pct"))}
        enough = [(t, k) for t in titles for k in labels[:2] if counts.get(t, {}).get(k, 0) > 1]
        part = labelled.where(F.col("label") != labels[2]).select(TITLE, "label", F.ln(F.col("s_l") + 1).alias("v"))
        if enough:
            part = part.join(F.broadcast(spark.createDataFrame(enough, f"{TITLE} string, label string")), [TITLE, "label"])  # two rows a model
        deviations = baselines.qq_deviations_groups(part, "v", [TITLE, "label"]) if enough else {}
    finally:
        for table in scratch:
            dropped(table)
    rows, beta_rows, beta_s_rows = [], [], []
    for t in titles:
        lr, lr_s = (m.get((t,), baselines.Logistic(math.nan, [math.nan] * k)) for m, k in ((plain, len(zs)), (with_s, len(zs) + 1)))
        f1 = f1s.get(t, {})
        row: dict[str, object] = {"file_title": t, "auc_control": aucs.get((t, "control")), "auc_em": aucs.get((t, "em")), "ap_em": aps.get(t, {}).get("ap"), "f1_best_em": f1.get("f1"), "f1_best_threshold_em": f1.get("threshold")}
        for name, found in at_fpr.items():
            r = found.get(t, {})
            row |= {f"precision_at_{name}_fpr_em": r.get("precision"), f"actual_fpr_at_{name}_target": r.get("fpr"), f"tpr_at_{name}_fpr_em": r.get("tpr"), f"threshold_at_{name}_fpr_em": r.get("threshold")}
        row["auc_lr"] = math.nan if lr.one_class else aucs.get((t, "lr"))
        row["auc_lr_sl"] = math.nan if lr_s.one_class else aucs.get((t, "lr_sl"))
        row |= {f"n_{k}_out_df": counts.get(t, {}).get(k, 0) for k in labels} | {f"n_{k}_motif_df": all_counts[t][k] for k in labels}
        for k in labels[:2]:
            row |= {f"qq_{k}_{name}": v for name, v in deviations.get((t, k), dict.fromkeys(baselines.FITTED)).items()}
        rows.append((t, *row.values()))
        beta = fitted[t].beta if t in fitted else [math.nan] * (len(feature_columns) + 1)
        beta_rows += [(t, n, float(b), float(c)) for n, b, c in zip(["intercept", *feature_columns], beta, [lr.intercept, *lr.coefficients], strict=True)]
        beta_s_rows += [(t, n, float(c)) for n, c in zip(["intercept", "s_l", *feature_columns], [lr_s.intercept, *lr_s.coefficients], strict=True)]
    kinds = ", ".join(f"{k} {'string' if k == 'file_title' else 'bigint' if k.startswith('n_') else 'double'}" for k in METRICS)
    return {
        "labelled": labelled,
        "metrics": spark.createDataFrame(rows, f"{TITLE} string, {kinds}"),
        "coefficients": spark.createDataFrame(beta_rows, f"{TITLE} string, feature string, beta_em double, beta_lr double"),
        "coefficients_sl": spark.createDataFrame(beta_s_rows, f"{TITLE} string, feature string, beta_lr_s_l double"),
    }


#: The metrics' columns, in their order.
METRICS = (
    "file_title", "auc_control", "auc_em", "ap_em", "f1_best_em", "f1_best_threshold_em",
    *(f"{a}{name}{b}" for name in ("10pct", "1pct") for a, b in (("precision_at_", "_fpr_em"), ("actual_fpr_at_", "_target"), ("tpr_at_", "_fpr_em"), ("threshold_at_", "_fpr_em"))),
    "auc_lr", "auc_lr_sl",
    *(f"n_{k}_{part}" for part in ("out_df", "motif_df") for k in ("clip_bound", "clip_unbound", "non_determined")),
    *(f"qq_{k}_{name}" for k in ("clip_bound", "clip_unbound") for name in baselines.FITTED),
)


#: Keys of a model's record, by where they stand in it.
PARAMETERS, DIAGNOSTICS = ("mu0", "sigma0", "mu1", "sigma1"), ("iters", "converged", "final_log_likelihood", "mean_p", "mean_r")


def model_record(fitted: mixture.Mixture) -> dict:
    """mode, beta, gaussian_params and diagnostics; warnings beside them."""
    flat = asdict(fitted)
    return {"mode": "em_gaussian", "beta": flat["beta"], "gaussian_params": {k: flat[k] for k in PARAMETERS}, "diagnostics": {k: flat[k] for k in DIAGNOSTICS}, "warnings": flat["warnings"]}


def model_of_record(record: dict) -> mixture.Mixture:
    """The model that model_record() wrote; numbers that were not finite come back as NaN."""
    known = record["gaussian_params"] | record["diagnostics"]
    return mixture.Mixture(beta=[math.nan if b is None else b for b in record["beta"]], warnings=list(record.get("warnings", [])), **{k: math.nan if known[k] is None else known[k] for k in (*PARAMETERS, *DIAGNOSTICS)})
