"""Command line: ``python -m sitelark.cli STAGE ...``, one subcommand a stage; files in, files out."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .plans import batch, pipeline
from .sources import genes, text
from .sources.bigwig import read_bigwig


def _signal(spark: SparkSession, path: str):
    """A track: one tab-separated table, one BigWig for both strands, or two (plus,minus). Returns the table and whether it is dense."""
    parts = path.split(",")
    if not parts[0].lower().endswith((".bw", ".bigwig")):
        return text.read_signal(spark, path), False
    tracks = [read_bigwig(spark, p).select("chrom", "start", "end", F.col("value").alias("val")) for p in parts]  # runs, not bases
    strands = [F.explode(F.array(F.lit("+"), F.lit("-")))] if len(parts) == 1 else [F.lit("+"), F.lit("-")]
    both = [t.withColumn("strand", s) for t, s in zip(tracks, strands, strict=True)]
    return (both[0] if len(both) == 1 else both[0].unionByName(both[1])), True


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sitelark", description="Score, annotate, model and evaluate positions along sequences.")
    sub = p.add_subparsers(dest="stage", required=True)
    window = lambda s: (s.add_argument("--inner", type=int, default=50), s.add_argument("--outer", type=int, default=500))
    s = sub.add_parser("scan", help="score all windows of sequences with a matrix")
    for a in ("fasta", "pwm"):
        s.add_argument(a)
    s.add_argument("--out", default=None)
    window(s)
    s.add_argument("--top", type=int, default=2_000_000)
    s.add_argument("--bottom", type=int, default=2_000_000)
    s.add_argument("--background")
    s.add_argument("--background-from-fasta", action="store_true")
    s = sub.add_parser("accessibility", help="score sites by their signal tracks")
    for a in ("sites", "native", "fixed", "out"):
        s.add_argument(a)
    window(s)
    s.add_argument("--threshold", type=int, default=8)
    s = sub.add_parser("annotate", help="add transcript, conservation and expression features")
    for a in ("sites", "exons", "regions", "expression", "phastcons", "phylop", "out"):
        s.add_argument(a)
    s.add_argument("--collapse", choices=["max"])
    s = sub.add_parser("lay-out", help="lay conservation scores out by chromosome and start, for reads of a part")
    s.add_argument("scores")
    s.add_argument("out")
    s = sub.add_parser("model", help="fit the mixture")
    s.add_argument("sites")
    s.add_argument("out")
    s.add_argument("--features", default=",".join(pipeline.FEATURES))
    s.add_argument("--score", default="s_l")
    s.add_argument("--mode", default="em")
    s.add_argument("--legacy", action="store_true")
    s = sub.add_parser("evaluate", help="label sites and measure the model")
    for a in ("model", "peaks", "structured", "out"):
        s.add_argument(a)
    s.add_argument("--limit", type=float, default=1.0)
    s.add_argument("--title", default="")
    many = lambda s: [s.add_argument(x) for x in ("motifs", "names", "peaks", "out")] and (s.add_argument("--suffix", default=".parquet"), s.add_argument("--peaks-suffix", default="_HeLa.bed"))
    s = sub.add_parser("batch-fit", help="fit all motif files of a folder, past failures")
    many(s)
    s.add_argument("--legacy", action="store_true")
    s = sub.add_parser("batch-evaluate", help="evaluate all fitted models of a folder, past failures")
    many(s)
    s.add_argument("structured")
    s.add_argument("--limit", type=float, default=1.0)
    s = sub.add_parser("workflow", help="from scanned tables to metrics for all motif files of a folder")
    many(s)
    for x in ("structured", "native", "fixed", "exons", "regions", "expression", "phastcons", "phylop"):
        s.add_argument(x)
    window(s)
    s.add_argument("--threshold", type=int, default=8)
    s.add_argument("--variant", nargs=3, action="append", default=[], metavar=("NAME", "NATIVE", "FIXED"), help="score each motif by these tracks as well")
    s.set_defaults(suffix=".tsv.gz")
    return p


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName(f"sitelark-{a.stage}").getOrCreate()
    if a.stage == "scan":
        out = a.out or text.stamped("scan")
        seqs = text.check_unique_contigs(text.read_fasta(spark, a.fasta))
        background = text.parse_background(a.background) if a.background else None
        best, worst = pipeline.scan(seqs, text.read_pwm(spark, a.pwm), a.inner, a.outer, a.top, a.bottom, background, a.background_from_fasta)
        text.write_table(best.drop("contig_order"), f"{out}_topA.tsv.gz")
        text.write_table(worst.drop("contig_order"), f"{out}_botB.tsv.gz")
    elif a.stage == "accessibility":
        (native, dense), (fixed, _) = _signal(spark, a.native), _signal(spark, a.fixed)
        scored = pipeline.accessibility(text.read_sites(spark, a.sites), native, fixed, a.inner, a.outer, a.threshold, dense)
        text.write_parquet(scored, a.out, ("chrom", "pos1", "strand"))
    elif a.stage == "annotate":
        done = pipeline.annotation(spark.read.parquet(a.sites), genes.read_exons(spark, a.exons), text.read_regions(spark, a.regions), spark.read.parquet(a.expression), text.read_scores(spark, a.phastcons), text.read_scores(spark, a.phylop), collapse=a.collapse)
        text.write_parquet(done, a.out, ("chrom", "pos1", "strand"))
    elif a.stage == "lay-out":
        text.write_scores(spark.read.parquet(a.scores), a.out)
    elif a.stage == "model":
        rows, fitted = pipeline.model(spark.read.parquet(a.sites), a.features.split(","), a.score, a.mode, legacy=a.legacy)
        text.write_parquet(rows, f"{a.out}.model.parquet")
        text.write_json(spark, pipeline.model_record(fitted), f"{a.out}.model.json")
    elif a.stage == "evaluate":
        fitted = pipeline.model_of_record(text.read_json(spark, a.model.replace(".model.parquet", ".model.json")))
        tables = pipeline.evaluation(spark.read.parquet(a.model), text.read_peaks(spark, a.peaks), spark.read.parquet(a.structured), fitted, limit=a.limit, title=a.title)
        for name in ("metrics", "coefficients", "coefficients_sl"):
            text.write_table(tables[name].coalesce(1), f"{a.out}/{name}", compress=False)
    elif a.stage == "workflow":
        (native, dense), (fixed, _) = _signal(spark, a.native), _signal(spark, a.fixed)
        resources = {"exons": genes.read_exons(spark, a.exons), "expression": spark.read.parquet(a.expression), "regions": text.read_regions(spark, a.regions)}
        resources |= {n: text.read_scores(spark, getattr(a, n)) for n in ("phastcons", "phylop")}
        done = batch.workflow(spark, a.motifs, a.names, a.peaks, a.structured, native, fixed, resources, a.out, dense, a.suffix, a.peaks_suffix, a.inner, a.outer, a.threshold, {n: (_signal(spark, x)[0], _signal(spark, y)[0]) for n, x, y in a.variant})
        text.write_table(done.coalesce(1), f"{a.out}/status", compress=False)
    else:
        jobs = batch.jobs_table(text.discover(spark, f"{a.motifs}/*{a.suffix}", a.suffix), text.read_motif_map(spark, a.names), text.discover(spark, f"{a.peaks}/*{a.peaks_suffix}", a.peaks_suffix)).collect()
        if a.stage == "batch-fit":
            done = batch.batch_fit(spark, [(r["title"], r["path"]) for r in jobs], a.out, legacy=a.legacy)
        else:
            done = batch.batch_evaluate(spark, [(r["title"], r["peaks_path"]) for r in jobs], a.structured, a.out, limit=a.limit)
        text.write_table(done.coalesce(1), f"{a.out}/{a.stage}-status", compress=False)


if __name__ == "__main__":
    main()
