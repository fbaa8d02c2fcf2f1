"""Incremental scan of sequences for a motif: the best and worst sites over all contigs that ever arrived.

A file stream takes the contig files that are new since the last run (``availableNow``; the checkpoint knows the rest). Each micro-batch is scanned with the
position-weight matrix, and its own highest and lowest sites are written to ``increments/batch=<id>``, which a repeated batch overwrites. The
output ``sites`` (partitioned by end: top or bottom) is then made anew from the increments, so a run that stops anywhere is mended by the next.

    python -m jobs.motif_scan --input contigs.parquet --output sites --checkpoint ckpt [--config jobs/conf/motif_scan.json]
"""

from __future__ import annotations

import argparse
import logging
from collections.abc import Sequence

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sitelark.operators import sequence

from .common import configuration, note

DEFAULTS = {
    "id": "doc_id",
    "text": "text",
    "translate": ["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ACGTACGTACGTACGTACGTACGTAN"],
    "matrix": [[0.7, 0.1, 0.1, 0.1], [0.1, 0.6, 0.2, 0.1], [0.25, 0.25, 0.3, 0.2]],
    "background": [0.25, 0.25, 0.25, 0.25],
    "inner": 5,
    "outer": 20,
    "top": 100,
    "bottom": 100,
    "digits": 5,
    "files_per_batch": 1000,
}
SITES = "contig_order bigint, pos1 bigint, strand string, score double, gc_inner_pct double, kmers int, end string"


def contigs(rows: DataFrame, config: dict) -> DataFrame:
    """chrom, contig_order and seq: the letters of a text, upper-cased and, where the configuration has a translation, mapped to bases. Rows without an id are left out."""
    letters = F.upper(F.regexp_replace(F.coalesce(F.col(config["text"]).cast("string"), F.lit("")), "[^A-Za-z]", ""))
    seq = F.translate(letters, *config["translate"]) if config["translate"] else letters
    own = F.col(config["id"])
    return rows.where(own.isNotNull()).select(own.cast("string").alias("chrom"), own.cast("bigint").alias("contig_order"), seq.alias("seq"))


def ends(scan: DataFrame, config: dict) -> DataFrame:
    """The wanted numbers of highest and lowest scores, ties by contig, position and strand; both are small numbers of the configuration."""
    by = {"top": F.desc("score"), "bottom": F.asc("score")}
    parts = [scan.orderBy(order, *sequence.TIE).limit(int(config[end])).withColumn("end", F.lit(end)) for end, order in by.items()]
    return parts[0].unionByName(parts[1])


def scanned(rows: DataFrame, config: dict) -> DataFrame:
    p = np.asarray(config["matrix"], np.float64) + 1e-9
    weights = sequence.log_ratios(np.log(p / p.sum(axis=1, keepdims=True)), np.asarray(config["background"]))
    columns = ("contig_order", "pos1", "strand", "inner_mean", "gc_inner_pct", "kmer_count_inner")
    scan = sequence.scan_windows(contigs(rows, config), weights, config["inner"], config["outer"], columns=columns, keep=(config["top"], config["bottom"]), slack=2 * 10.0 ** -config["digits"])
    return scan.select(*sequence.TIE, F.round("inner_mean", config["digits"]).alias("score"), "gc_inner_pct", F.col("kmer_count_inner").alias("kmers"))


def run(spark: SparkSession, source: str, output: str, checkpoint: str, config: dict | None = None) -> DataFrame:
    """Takes what is new at source; returns the whole output: contig_order, pos1, strand, score, gc_inner_pct, kmers, rank and end."""
    config = DEFAULTS | (config or {})
    increments, sites = f"{output}/increments", f"{output}/sites"
    now = spark.read.parquet(source)
    # a file stream takes a folder or a pattern; one single file is given as a pattern that fits nothing else
    single = [f.rpartition("/")[2] for f in now.inputFiles()] == [source.rpartition("/")[2]]
    stream = spark.readStream.schema(now.schema).option("maxFilesPerTrigger", config["files_per_batch"]).parquet(f"{source[:-1]}[{source[-1]}]" if single else source)

    def take(batch: DataFrame, number: int) -> None:
        found = scanned(batch, config).persist()
        try:
            ends(found, config).write.mode("overwrite").parquet(f"{increments}/batch={number}")
        finally:
            found.unpersist()

    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    note("jobs.motif_scan", read=source, rows=sum(p["numInputRows"] for p in query.recentProgress), batches=len(query.recentProgress))
    try:
        known = spark.read.schema(f"{SITES}, batch bigint").parquet(increments)
    except AnalysisException:  # nothing has ever arrived
        known = spark.createDataFrame([], f"{SITES}, batch bigint")
    both = []
    for end, order in (("top", F.desc("score")), ("bottom", F.asc("score"))):
        own = known.where(F.col("end") == end).select("contig_order", "pos1", "strand", "score", "gc_inner_pct", "kmers", "end")
        rank = F.row_number().over(Window.partitionBy("end").orderBy(order, *sequence.TIE))
        both.append(own.withColumn("rank", rank).where(F.col("rank") <= int(config[end])))
    both[0].unionByName(both[1]).write.mode("overwrite").partitionBy("end").parquet(sites)
    out = spark.read.schema(f"{SITES.replace(', end string', '')}, rank int, end string").parquet(sites)
    note("jobs.motif_scan", wrote=sites, rows=out.count())
    return out


def main(argv: Sequence[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="jobs.motif_scan", description="Scan the contigs that are new and keep the best and worst sites of all.")
    for name in ("input", "output", "checkpoint"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--config")
    args = p.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("motif_scan").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        run(spark, args.input, args.output, args.checkpoint, configuration(spark, args.config, DEFAULTS))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
