"""Transcript references: exons of GTF and GFF3 annotations, with their places in their transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The nine columns of both formats.
FEATURES = "chrom string, source string, feature string, first bigint, last bigint, score string, strand string, frame string, attributes string"


def attribute(name: str, column: str = "attributes") -> Column:
    """The value of an attribute, written as ``name "value"`` (GTF, with or without quotes) or ``name=value`` (GFF3); null without it."""
    gtf = F.regexp_extract(column, rf'(?:^|;)\s*{name}\s+"?([^";]*)"?', 1)
    gff = F.regexp_extract(column, rf"(?:^|;)\s*{name}=([^;]*)", 1)
    return F.coalesce(F.nullif(F.trim(gff), F.lit("")), F.nullif(F.trim(gtf), F.lit("")))


def _unescaped(c: Column) -> Column:
    """GFF3 writes reserved characters as %XX."""
    return F.when(c.contains("%"), F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))).otherwise(c)


def read_annotation(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a GTF or GFF3 text (plain or gz), FEATURES; comment lines, blank lines and a trailing FASTA part are left out."""
    lines = spark.read.text(path).where(~F.col("value").startswith("#") & F.col("value").contains("\t"))
    cells = F.split("value", "\t")
    names = [c.strip().split() for c in FEATURES.split(",")]
    return lines.select(*(F.try_element_at(cells, F.lit(k + 1)).try_cast(kind).alias(n) for k, (n, kind) in enumerate(names))).where("feature is not null")


def exons_of(annotation: DataFrame) -> DataFrame:
    """chrom, strand, gene_id, transcript_id, exon_number, exon_start, exon_end (half-open, 0-based), before (exon bases of the transcript ahead of the exon, in its
    own direction), transcript_length, and start_codon and stop_codon: the offsets in the transcript where its coding part begins and ends, null without one.

    Transcripts are told apart by chromosome, strand and id (some stand on two chromosomes). GFF3 exons take transcript_id or, without it, their Parent, one row
    for each parent; equal rows count once. ``chr`` is taken off, rows without a transcript or a valid span are left out, exon numbers are counted anew
    in the direction of the transcript.
    """
    bare = annotation.withColumn("chrom", F.regexp_replace("chrom", "^chr", "")).where("strand IN ('+', '-') AND first <= last AND chrom IS NOT NULL")
    parent = F.regexp_replace(_unescaped(attribute("Parent")), "(^|,)(transcript|rna|mRNA):", "$1")
    owner = F.coalesce(_unescaped(attribute("transcript_id")), parent)
    placed = bare.where(F.lower("feature").isin("exon", "cds")).withColumn("transcript_id", F.explode(F.split(owner, ","))).withColumn("transcript_id", F.trim("transcript_id")).where("transcript_id <> ''")
    key = ["chrom", "strand", "transcript_id"]
    exon = placed.where("lower(feature) = 'exon'").groupBy(*key, (F.col("first") - 1).alias("exon_start"), F.col("last").alias("exon_end")).agg(F.min(_unescaped(attribute("gene_id"))).alias("gene_id"))
    coding = placed.where("lower(feature) = 'cds'").groupBy(*key).agg((F.min("first") - 1).alias("_c0"), F.max("last").alias("_c1"))
    size = F.col("exon_end") - F.col("exon_start")
    along = F.when(F.col("strand") == "+", F.col("exon_start")).otherwise(-F.col("exon_end"))
    ahead = Window.partitionBy(*key).orderBy(along)
    whole = Window.partitionBy(*key)
    numbered = exon.select("*", F.row_number().over(ahead).alias("exon_number"), (F.sum(size).over(ahead) - size).alias("before"), F.sum(size).over(whole).alias("transcript_length"))
    both = numbered.join(coding, key, "left")
    plus = F.col("strand") == "+"
    at = lambda p: F.col("before") + F.when(plus, p - F.col("exon_start")).otherwise(F.col("exon_end") - p)  # noqa: E731  offset of an edge between bases
    begin, end = F.when(plus, F.col("_c0")).otherwise(F.col("_c1")), F.when(plus, F.col("_c1")).otherwise(F.col("_c0"))
    touches = lambda p: (p >= F.col("exon_start")) & (p <= F.col("exon_end"))
    codons = {"start_codon": F.max(F.when(touches(begin), at(begin))).over(whole), "stop_codon": F.max(F.when(touches(end), at(end))).over(whole)}
    return both.withColumns(codons).select(*key[:2], "gene_id", "transcript_id", "exon_number", "exon_start", "exon_end", "before", "transcript_length", "start_codon", "stop_codon")


def read_exons(spark: SparkSession, path: str) -> DataFrame:
    """Exons from a GTF or GFF3 file (by its suffix), or from a Parquet table that has them already."""
    name = path.lower().removesuffix(".gz").removesuffix(".bgz")
    return exons_of(read_annotation(spark, path)) if name.endswith((".gtf", ".gff", ".gff3")) else spark.read.parquet(path)
