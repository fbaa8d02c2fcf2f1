"""The views that the registered queries take from the driver's tables, in Spark and as DuckDB text."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Half-widths and threshold that fit the events' density.
INNER, OUTER, THRESHOLD = 1500, 5000, 2
#: Windows, k-mer length and matrix of the sequence queries.
SEQ_INNER, SEQ_OUTER, SIZE = 5, 20, 3
PWM = ((0.7, 0.1, 0.1, 0.1), (0.1, 0.6, 0.2, 0.1), (0.25, 0.25, 0.3, 0.2))
ALPHABET, CODED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ACGTACGTACGTACGTACGTACGTAN"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def log_weights() -> np.ndarray:
    p = np.array(PWM) + 1e-9
    return np.log(p / p.sum(axis=1, keepdims=True)) - np.log(0.25)


def minute(ts: Column) -> Column:
    """Whole minutes since 1970, of the wall clock: the session's time zone has no part in it."""
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))
    return F.floor(micros / 60_000_000).cast("bigint")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    strand = F.when(F.col("event_id") % 2 == 0, "+").otherwise("-")
    return e.select("event_id", (F.col("user_id") % 4).alias("chrom"), minute(F.col("ts")).alias("pos"), strand.alias("strand"), "event_type", F.col("value").alias("val"), (F.col("event_id") % 7 + 1).alias("depth"))


def of_type(pts: DataFrame, kind: str) -> DataFrame:
    return pts.where(F.col("event_type") == kind)


def sites(pts: DataFrame) -> DataFrame:
    return of_type(pts, "purchase").select(F.col("event_id").alias("site"), "chrom", "pos", "strand")


def signal(pts: DataFrame) -> DataFrame:
    cond = F.when(F.col("event_type") == "view", "native").when(F.col("event_type") == "click", "fixed")
    return pts.withColumn("cond", cond).where(F.col("cond").isNotNull()).select("chrom", "strand", F.col("pos").alias("at"), "cond", "val", "depth", "event_id")


def regions(pts: DataFrame) -> DataFrame:
    return of_type(pts, "signup").select(F.col("event_id").alias("region"), "chrom", F.col("pos").alias("r_start"), (F.col("pos") + 60).alias("r_end"), F.col("val").alias("score"))


def cover(pts: DataFrame) -> DataFrame:
    """Disjoint intervals by chromosome: from each signup position up to the next."""
    from pyspark.sql.window import Window

    starts = of_type(pts, "signup").select("chrom", F.col("pos").alias("c_start")).distinct()
    after = F.lead("c_start").over(Window.partitionBy("chrom").orderBy("c_start"))
    return starts.withColumn("_after", after).where("_after is not null").select("chrom", "c_start", F.least(F.col("_after") - 1, F.col("c_start") + 20).alias("c_end"))


DUCK_POINTS = """
pts AS (
  SELECT event_id, user_id % 4 AS chrom, CAST(floor(epoch_us(ts) / 60000000) AS BIGINT) AS pos,
         CASE WHEN event_id % 2 = 0 THEN '+' ELSE '-' END AS strand, event_type, value AS val, event_id % 7 + 1 AS depth
  FROM events
), sites AS (
  SELECT event_id AS site, chrom, pos, strand FROM pts WHERE event_type = 'purchase'
), signal AS (
  SELECT chrom, strand, pos AS at_, CASE event_type WHEN 'view' THEN 'native' ELSE 'fixed' END AS cond, val, depth
  FROM pts WHERE event_type IN ('view', 'click')
), regions AS (
  SELECT event_id AS region, chrom, pos AS r_start, pos + 60 AS r_end, val AS score FROM pts WHERE event_type = 'signup'
), cover AS (
  SELECT * FROM (
    SELECT chrom, c_start, least(lead(c_start) OVER (PARTITION BY chrom ORDER BY c_start) - 1, CASE WHEN lead(c_start) OVER (PARTITION BY chrom ORDER BY c_start) IS NULL THEN NULL ELSE c_start + 20 END) AS c_end
    FROM (SELECT DISTINCT chrom, pos AS c_start FROM pts WHERE event_type = 'signup')
  ) WHERE c_end IS NOT NULL
)
"""


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A contig for each document: its ASCII letters, mapped to bases (Z to a letter that is none)."""
    letters = F.upper(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]", ""))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("chrom"), F.col("doc_id").alias("contig_order"), F.translate(letters, ALPHABET, CODED).alias("seq"))


def _llr(k: int, base: str) -> str:
    """Log ratio of a base at place k of the matrix, in SQL; null for a letter that is none."""
    row, total = PWM[k], sum(PWM[k])
    return "CASE " + base + " " + " ".join(f"WHEN '{b}' THEN ln((CAST({p} AS DOUBLE) + 1e-9) / ({total} + 4e-9)) - ln(CAST(0.25 AS DOUBLE))" for b, p in zip("ACGT", row, strict=True)) + " END"


_COMP = "translate(seq, 'ACGTU', 'TGCAA')"
DUCK_SEQS = f"""
seqs AS (
  SELECT CAST(doc_id AS VARCHAR) AS chrom, doc_id AS contig_order,
         translate(upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')), '{ALPHABET}', '{CODED}') AS seq
  FROM documents
), w(k, base, llr) AS (
  SELECT CAST(k AS BIGINT), base, ln((CAST(p AS DOUBLE) + 1e-9) / (t + 4e-9)) - ln(CAST(0.25 AS DOUBLE))
  FROM (VALUES {", ".join(f"({k}, '{b}', {p}, {sum(row)})" for k, row in enumerate(PWM) for b, p in zip("ACGT", row, strict=True))}) v(k, base, p, t)
)
"""
#: Bases of both strands with their 0-based place, k-mer scores, and window means of each centre.
#: A window that would leave the contig keeps the value of the last centre where it fitted: last_value over the earlier rows.
DUCK_SCAN = (
    DUCK_SEQS
    + f""", oriented AS (
  SELECT contig_order, '+' AS strand, seq, length(seq) AS n FROM seqs WHERE length(seq) >= {2 * SEQ_OUTER + 1}
  UNION ALL
  SELECT contig_order, '-', reverse({_COMP}), length(seq) FROM seqs WHERE length(seq) >= {2 * SEQ_OUTER + 1}
), bases AS (
  SELECT contig_order, strand, n, unnest(string_split(seq, '')) AS b, unnest(range(0, n)) AS i FROM oriented
), near AS (
  SELECT contig_order, strand, n, i, b IN ('C', 'G') AS gc, {_llr(0, "b")} AS a0, {_llr(1, "lead(b, 1) OVER o")} AS a1, {_llr(2, "lead(b, 2) OVER o")} AS a2
  FROM bases WINDOW o AS (PARTITION BY contig_order, strand ORDER BY i)
), kmers AS (
  SELECT contig_order, strand, n, i, gc, CASE WHEN i <= n - {SIZE} THEN a0 + a1 + a2 IS NOT NULL END AS ok, coalesce(CAST(CAST(a0 + a1 + a2 AS FLOAT) AS DOUBLE), 0) AS s FROM near
), raw AS (
  SELECT contig_order, strand, n, i,
         CASE WHEN i <= n - 1 - {SEQ_INNER} THEN sum(s) OVER (o ROWS BETWEEN {SEQ_INNER} PRECEDING AND {SEQ_INNER - SIZE + 1} FOLLOWING) END AS s_in,
         CASE WHEN i <= n - 1 - {SEQ_INNER} THEN sum(CAST(ok AS INT)) OVER (o ROWS BETWEEN {SEQ_INNER} PRECEDING AND {SEQ_INNER - SIZE + 1} FOLLOWING) END AS n_in,
         CASE WHEN i < {SEQ_INNER + SIZE} THEN first_value(s) OVER o ELSE sum(s) OVER (o ROWS BETWEEN {SEQ_OUTER} PRECEDING AND {SEQ_INNER + SIZE} PRECEDING) END AS s_l,
         CASE WHEN i < {SEQ_INNER + SIZE} THEN first_value(CAST(ok AS INT)) OVER o ELSE sum(CAST(ok AS INT)) OVER (o ROWS BETWEEN {SEQ_OUTER} PRECEDING AND {SEQ_INNER + SIZE} PRECEDING) END AS n_l,
         CASE WHEN i <= n - 1 - {SEQ_OUTER} THEN sum(s) OVER (o ROWS BETWEEN {SEQ_INNER + 1} FOLLOWING AND {SEQ_OUTER - SIZE + 1} FOLLOWING) END AS s_r,
         CASE WHEN i <= n - 1 - {SEQ_OUTER} THEN sum(CAST(ok AS INT)) OVER (o ROWS BETWEEN {SEQ_INNER + 1} FOLLOWING AND {SEQ_OUTER - SIZE + 1} FOLLOWING) END AS n_r,
         sum(CAST(gc AS INT)) OVER (o ROWS BETWEEN {SEQ_INNER} PRECEDING AND {SEQ_INNER} FOLLOWING) AS g_in,
         sum(CAST(gc AS INT)) OVER (o ROWS BETWEEN {SEQ_OUTER} PRECEDING AND {SEQ_OUTER} FOLLOWING) AS g_all
  FROM kmers WINDOW o AS (PARTITION BY contig_order, strand ORDER BY i)
), held AS (
  SELECT contig_order, strand, n, i, g_in, g_all, least(i, {SEQ_INNER}) + least(n - 1 - i, {SEQ_INNER}) + 1 AS l_in, least(i, {SEQ_OUTER}) + least(n - 1 - i, {SEQ_OUTER}) + 1 AS l_all,
         last_value(s_in IGNORE NULLS) OVER o AS s_in, last_value(n_in IGNORE NULLS) OVER o AS n_in,
         s_l + last_value(s_r IGNORE NULLS) OVER o AS s_out, n_l + last_value(n_r IGNORE NULLS) OVER o AS n_out
  FROM raw WINDOW o AS (PARTITION BY contig_order, strand ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), scan AS (
  SELECT contig_order, strand, CASE WHEN strand = '+' THEN i + 1 ELSE n - i END AS pos1, s_in / n_in AS inner_mean,
         CASE WHEN n_out > 0 THEN s_out / n_out END AS outer_mean, g_in * 100.0::DOUBLE / l_in AS gc_in,
         CASE WHEN l_all > l_in THEN (g_all - g_in) * 100.0::DOUBLE / (l_all - l_in) END AS gc_out, CAST(n_in AS BIGINT) AS kin, CAST(n_out AS BIGINT) AS kout
  FROM held WHERE n_in > 0
)
"""
)


def scan_table(spark: SparkSession, sf_dir: str, *columns: str, keep: tuple[int, int] | None = None, weighted: dict[str, tuple[str, float]] | None = None) -> DataFrame:
    """keep: the highest and lowest inner means that are wanted, with a margin for their being rounded before they are ranked."""
    from ..operators.sequence import scan_windows

    return scan_windows(sequences(spark, sf_dir), log_weights(), SEQ_INNER, SEQ_OUTER, columns=columns or None, keep=keep, slack=1e-4, weighted=weighted)


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exons from orders: a transcript of two exons for each order, on the chromosomes and strands of the events."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 4).alias("chrom"), F.when(F.col("o_orderkey") % 2 == 0, "+").otherwise("-").alias("strand"))
    start = F.lit(28_400_000) + (F.col("o_orderkey") * 37) % 45_000
    one = o.select("chrom", "strand", F.col("o_orderkey").alias("transcript_id"), start.alias("exon_start"), (start + 20 + F.col("o_orderkey") % 11).alias("exon_end"))
    two = o.select("chrom", "strand", F.col("o_orderkey").alias("transcript_id"), (start + 60).alias("exon_start"), (start + 75 + F.col("o_orderkey") % 7).alias("exon_end"))
    return one.unionByName(two)


DUCK_TRANSCRIPTS = """
ord AS (
  SELECT o_orderkey AS t, o_custkey % 4 AS chrom, CASE WHEN o_orderkey % 2 = 0 THEN '+' ELSE '-' END AS strand, 28400000 + (o_orderkey * 37) % 45000 AS s FROM orders
), exons AS (
  SELECT chrom, strand, t, s AS es, s + 20 + t % 11 AS ee, 0 AS before, 20 + t % 11 + 15 + t % 7 AS len FROM ord
  UNION ALL
  SELECT chrom, strand, t, s + 60, s + 75 + t % 7, 20 + t % 11, 20 + t % 11 + 15 + t % 7 FROM ord
)
"""


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with their documents: y is the quality, score the length."""
    labels, docs = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents")
    return labels.join(docs, "doc_id").select("doc_id", F.col("quality").alias("y"), F.col("n_chars").cast("double").alias("score"), F.col("toxic").cast("double").alias("other"))


DUCK_RANKED = """
xy AS (SELECT doc_id, quality AS y, CAST(n_chars AS DOUBLE) AS score, CAST(toxic AS DOUBLE) AS other FROM labels JOIN documents USING (doc_id))
"""
DUCK_RUNNING = (
    DUCK_RANKED
    + """, counts AS (
  SELECT score, sum(y) AS pos, sum(1 - y) AS neg FROM xy WHERE y IS NOT NULL AND score IS NOT NULL GROUP BY score
), run AS (
  SELECT score, pos, neg, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp, sum(pos) OVER () AS np, sum(neg) OVER () AS nn FROM counts
), pr AS (
  SELECT score, CAST(tp AS DOUBLE) / (tp + fp) AS p, CAST(tp AS DOUBLE) / np AS r, CAST(fp AS DOUBLE) / nn AS f FROM run
)
"""
)


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return reduce(lambda d, c: d.withColumn(c, F.round(c, digits)), columns, df)
