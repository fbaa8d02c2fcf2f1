"""The jobs as queries: each runs its function twice into one new folder and returns the whole output as it stands then."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelark import catalog
from sitelark.plans.views import DUCK_POINTS, DUCK_SCAN, DUCK_TRANSCRIPTS

from . import motif_scan, site_features
from .common import fresh_folder


def job1_motif_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_folder(spark, "motif-scan")
    for _ in range(2):
        out = motif_scan.run(spark, f"{sf_dir}/documents.parquet", f"{folder}/out", f"{folder}/checkpoint")
    return out.withColumn("gc_inner_pct", F.round("gc_inner_pct", 6))


def _end(name: str, order: str) -> str:
    key = f"round(inner_mean, {motif_scan.DEFAULTS['digits']}) {order}, contig_order, pos1, strand"
    return f"""SELECT contig_order, CAST(pos1 AS BIGINT) AS pos1, strand, round(inner_mean, {motif_scan.DEFAULTS['digits']}) AS score, round(gc_in, 6) AS gc_inner_pct, CAST(kin AS INT) AS kmers,
CAST(row_number() OVER (ORDER BY {key}) AS INT) AS rank, '{name}' AS "end" FROM (SELECT * FROM scan WHERE contig_order IS NOT NULL ORDER BY {key} LIMIT {motif_scan.DEFAULTS[name]})"""


JOB1_SQL = f"WITH {DUCK_SCAN} {_end('top', 'DESC')} UNION ALL {_end('bottom', 'ASC')}"


def job2_site_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_folder(spark, "site-features")
    for _ in range(2):
        out = site_features.run(spark, sf_dir, folder)
    rounded = {"t_native": 4, "t_fixed": 4, "s_l": 3, "covered": 6, "tss_proximity": 6}
    return out.withColumns({c: F.round(c, k) for c, k in rounded.items()})


_C = site_features.DEFAULTS
_NEAR = f"r.chrom = s.chrom AND s.pos - {_C['half']} < r.r_end AND r.r_start < s.pos + {_C['half']}"
JOB2_SQL = f"""WITH {DUCK_POINTS}, {DUCK_TRANSCRIPTS}, {catalog._duck_moments(catalog._MOMENTS)}, t AS (
  SELECT site, {catalog._duck_t("native")} AS a, {catalog._duck_t("fixed")} AS b FROM m WHERE {catalog._FULL}
), hit AS (
  SELECT site, t, CASE WHEN x.strand = '-' THEN len - 1 - (before + pos - es) ELSE before + pos - es END AS start, row_number() OVER (PARTITION BY site ORDER BY len DESC, t) AS k
  FROM sites s JOIN exons x ON s.chrom = x.chrom AND s.strand = x.strand AND s.pos >= x.es AND s.pos < x.ee
), reg AS (
  SELECT site, count(*) AS n, max((least(s.pos + {_C["half"]}, r.r_end) - greatest(s.pos - {_C["half"]}, r.r_start)) / {2.0 * _C["half"]}::DOUBLE) AS covered,
         bool_or(r.score > {_C["bound_above"]}) AS strong, bool_or(r.score <= {_C["bound_above"]}) AS weak
  FROM sites s JOIN regions r ON {_NEAR} GROUP BY site
)
SELECT s.site, s.pos, s.strand, round(t.a, 4) AS t_native, round(t.b, 4) AS t_fixed, round(t.a * t.a + t.b * t.b, 3) AS s_l, coalesce(reg.n, 0) AS n_regions, round(coalesce(covered, 0), 6) AS covered,
       h.t AS transcript_id, round(coalesce(1 / (1 + h.start / 1000.0::DOUBLE), 0), 6) AS tss_proximity,
       CASE WHEN strong THEN 'clip_bound' WHEN NOT coalesce(weak, FALSE) AND p.val <= {_C["label_limit"]} THEN 'clip_unbound' ELSE 'non_determined' END AS label, s.chrom
FROM sites s JOIN pts p ON p.event_id = s.site LEFT JOIN t ON t.site = s.site LEFT JOIN hit h ON h.site = s.site AND h.k = 1 LEFT JOIN reg ON reg.site = s.site"""

QUERIES = {"job1_motif_scan": job1_motif_scan, "job2_site_features": job2_site_features}
ORACLES = {"job1_motif_scan": JOB1_SQL, "job2_site_features": JOB2_SQL}
