"""Readers of sequence, matrix and table files, and the writers that match. Paths may be anything that Spark reads; .gz is unpacked by suffix."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from datetime import datetime

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIGNAL = "chrom string, at bigint, strand string, val double, depth bigint, motif string"
REGIONS = "chrom string, start bigint, end bigint, name string"
PEAKS = "chrom string, start bigint, end bigint, peak_id string, score double, strand string, rbp string, method string, cell_line string, datasource string"
SITES = "chrom string, pos1 bigint, strand string, inner_mean_logPWM double, outer_mean_logPWM double, GC_inner_pct double, GC_outer_pct double, kmer_count_inner int, kmer_count_outer int"


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """contig_order, chrom, seq: the first word of each header, the record's lines joined in upper case.

    Records are split by ``>`` at a line's start while reading, so files need not fit anywhere whole, and no step gathers a file. Text before
    the first header is left out. Contig names that repeat are an error, as is a header without a name.
    """
    raw = spark.read.option("lineSep", "\n>").text(path).select(F.monotonically_increasing_id().alias("contig_order"), F.col("value"), F.input_file_name().alias("file"))
    first = raw.groupBy("file").agg(F.min("contig_order").alias("contig_order")).select("contig_order", F.lit(True).alias("_first"))  # a row a file
    marked = raw.join(first, "contig_order", "left")
    begins = F.regexp_extract("value", r"(?s)(?:^|\n)>(.*)$", 1)  # a file's first record keeps its mark, or is the text before any
    is_record = F.col("_first").isNull() | F.col("value").rlike(r"(?:^|\n)>")
    parts = marked.where(is_record).select("contig_order", F.when(F.col("_first"), begins).otherwise(F.col("value")).alias("r"))
    head = F.regexp_extract("r", r"^[ \t]*([^\s]*)", 1)
    body = F.regexp_replace(F.regexp_extract("r", r"(?s)^[^\n]*\n(.*)$", 1), r"\s", "")
    named = F.when(head == "", F.raise_error(F.lit("a sequence header has no name"))).otherwise(head)
    return parts.select("contig_order", named.alias("chrom"), F.upper(body).alias("seq"))


def check_unique_contigs(seqs: DataFrame) -> DataFrame:
    twice = seqs.groupBy("chrom").count().where("count > 1").select("chrom").limit(1).collect()
    if twice:
        raise ValueError(f"the contig {twice[0][0]} occurs more than once")
    return seqs


def parse_pwm(text: str) -> np.ndarray:
    """Natural-log probabilities [L, 4] (A, C, G, T). Header in any case and order, U for T; each row plus 1e-9, made to sum to 1."""
    rows = [line.split() for line in text.splitlines() if line.strip() and not line.startswith("#")]
    head = [h.upper() for h in rows[0]]
    if "U" in head and "T" in head:
        raise ValueError("a matrix has either U or T")
    head = ["T" if h == "U" else h for h in head]
    missing = [b for b in ("POS", *"ACGT") if b not in head]
    if missing:
        raise ValueError(f"the matrix lacks {', '.join(missing)}")
    p = np.array([[float(r[head.index(b)]) for b in "ACGT"] for r in rows[1:]]) + 1e-9
    return np.log(p / p.sum(axis=1, keepdims=True))


def read_pwm(spark: SparkSession, path: str) -> np.ndarray:
    """A matrix is a few rows; it is read through Spark so that any path works."""
    return parse_pwm("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))


def parse_background(text: str) -> np.ndarray:
    """Four positive finite numbers, made to sum to 1."""
    q = np.array([float(x) for x in text.replace(",", " ").split()])
    if len(q) != 4 or not np.isfinite(q).all() or (q <= 0).any():
        raise ValueError("a background is four positive numbers: A C G T")
    return q / q.sum()


def read_sites(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SITES).option("header", True).option("sep", "\t").option("nanValue", "nan").csv(path)


def read_signal(spark: SparkSession, path: str) -> DataFrame:
    """Headerless rows of a signal track without the motif column; only the asked columns are parsed."""
    return spark.read.schema(SIGNAL).option("sep", "\t").csv(path).drop("motif")


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    """Headerless BED4, ``#`` lines left out, ``chr`` taken off."""
    return spark.read.schema(REGIONS).option("sep", "\t").option("comment", "#").csv(path).withColumn("chrom", F.regexp_replace("chrom", "^chr", ""))


def read_peaks(spark: SparkSession, path: str) -> DataFrame:
    """Headerless BED10; rows that do not parse keep nulls where they fail."""
    return spark.read.schema(PEAKS).option("sep", "\t").option("mode", "PERMISSIVE").csv(path)


SCORES = "start bigint, end bigint, score double, chrom string"


def read_scores(spark: SparkSession, path: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """Parquet chrom, start, end, score, as one folder of files or as write_scores() lays it out; a range of starts is pushed into the scan."""
    df = spark.read.schema(SCORES).parquet(path).select("chrom", "start", "end", "score")
    if start is not None:
        df = df.where(F.col("start") >= start)
    return df if end is None else df.where(F.col("start") <= end)


def write_scores(df: DataFrame, path: str, stretch: int = 10_000_000) -> None:
    """chrom, start, end, score laid out for reads of a part: a folder a chromosome, and in it a file for each stretch of starts, sorted.

    Readers then open the chromosomes they ask for and, by the files' own statistics, the row groups of the positions they ask for.
    """
    bare = df.select(F.regexp_replace(F.col("chrom").cast("string"), "^chr", "").alias("chrom"), *(F.col(c).cast(k).alias(c) for c, k in (("start", "bigint"), ("end", "bigint"), ("score", "double"))))
    placed = bare.withColumn("_stretch", F.floor(F.col("start") / stretch))
    placed.repartition("chrom", "_stretch").sortWithinPartitions("chrom", "start").drop("_stretch").write.mode("overwrite").partitionBy("chrom").parquet(path)


def read_motif_map(spark: SparkSession, path: str) -> DataFrame:
    """motif, rbp of a headed table; ``.`` and blank names are left out, and of several rows for a motif the last counts."""
    raw = spark.read.option("header", True).option("sep", "\t").csv(path).withColumn("_row", F.monotonically_increasing_id())
    named = raw.where(F.trim("RBP_Name").isNotNull() & ~F.trim("RBP_Name").isin("", "."))
    return named.groupBy(F.col("Motif_ID").alias("motif")).agg(F.max_by("RBP_Name", "_row").alias("rbp"))


def discover(spark: SparkSession, pattern: str, suffix: str) -> DataFrame:
    """motif, path of the files that a glob matches: base name without suffix, sorted and distinct. File contents are not read."""
    files = spark.read.format("binaryFile").load(pattern).select("path")
    name = F.element_at(F.split("path", "/"), -1)
    return files.where(name.endswith(suffix)).select(F.left(name, F.length(name) - len(suffix)).alias("motif"), "path").distinct().orderBy("motif")


def write_table(df: DataFrame, path: str, compress: bool = True, by: str | None = None) -> None:
    """Headed tab-separated text; NaN as nan. by: a column that gives a folder for each of its values, of which those that df has are replaced."""
    real = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")]
    df = df.withColumns({c: F.when(F.isnan(df[c]), "nan").otherwise(df[c].cast("string")) for c in real})  # the writer itself says NaN
    writer = df.write.mode("overwrite").option("header", True).option("sep", "\t").option("compression", "gzip" if compress else "none")
    (writer.partitionBy(by).option("partitionOverwriteMode", "dynamic") if by else writer).csv(path)


def write_parquet(df: DataFrame, path: str, order: Sequence[str] = ()) -> None:
    (df.orderBy(*order) if order else df).write.mode("overwrite").parquet(path)


def write_json(spark: SparkSession, record: dict, path: str) -> None:
    """One indented JSON document, NaN and infinities as null wherever they stand."""

    def clean(v):
        if isinstance(v, dict):
            return {k: clean(x) for k, x in v.items()}
        if isinstance(v, list | tuple):
            return [clean(x) for x in v]
        return None if isinstance(v, float) and not math.isfinite(v) else v

    spark.createDataFrame([(json.dumps(clean(record), indent=2),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str) -> dict:
    """The document that write_json() wrote."""
    return json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def stamped(stem: str, now: datetime | None = None) -> str:
    return f"{stem}.{(now or datetime.now()):%Y%m%d_%H%M%S}"
