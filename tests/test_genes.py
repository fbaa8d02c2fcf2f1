"""Transcript references from GTF and GFF3, and conservation tables laid out by chromosome."""

import gzip

import pytest
from pyspark.sql import functions as F

from sitelark.operators import intervals
from sitelark.plans import pipeline
from sitelark.sources import genes, text

GTF = '''#!genome-build x
chr1\tsrc\tgene\t101\t400\t.\t+\t.\tgene_id "g1";
chr1\tsrc\texon\t301\t400\t.\t+\t.\tgene_id "g1"; transcript_id "t1"; exon_number "2";
chr1\tsrc\texon\t101\t150\t.\t+\t.\tgene_id "g1"; transcript_id "t1"; exon_number "1"; note "a; b";
chr1\tsrc\texon\t101\t150\t.\t+\t.\tgene_id "g1"; transcript_id "t1"; exon_number "1";
chr1\tsrc\tCDS\t121\t150\t.\t+\t0\tgene_id "g1"; transcript_id "t1";
chr1\tsrc\tCDS\t301\t320\t.\t+\t0\tgene_id "g1"; transcript_id "t1";
2\tsrc\texon\t1\t10\t.\t-\t.\ttranscript_id "t2"; gene_id "g2";
2\tsrc\texon\t21\t40\t.\t-\t.\ttranscript_id "t2"; gene_id "g2";
2\tsrc\tCDS\t5\t10\t.\t-\t0\ttranscript_id "t2";
2\tsrc\tCDS\t21\t30\t.\t-\t0\ttranscript_id "t2";
2\tsrc\texon\t50\t40\t.\t-\t.\ttranscript_id "bad";
2\tsrc\texon\t50\t60\t.\t-\t.\tgene_id "none";
2\tsrc\texon\tx\t60\t.\t-\t.\ttranscript_id "bad";
2\tsrc\texon
X\tsrc\texon\t1\t10\t.\t+\t.\ttranscript_id "t1"; gene_id "g3";
'''
#: chrom, strand, gene, transcript, number, start, end, before, length, start codon, stop codon
WANT = [
    ("1", "+", "g1", "t1", 1, 100, 150, 0, 150, 20, 70),
    ("1", "+", "g1", "t1", 2, 300, 400, 50, 150, 20, 70),
    ("2", "-", "g2", "t2", 1, 20, 40, 0, 30, 10, 26),
    ("2", "-", "g2", "t2", 2, 0, 10, 20, 30, 10, 26),
    ("X", "+", "g3", "t1", 1, 0, 10, 0, 10, None, None),
]
GFF = "##gff-version 3\n1\ts\tmRNA\t101\t400\t.\t+\t.\tID=transcript:t1;Parent=gene:g1\n1\ts\texon\t101\t150\t.\t+\t.\tParent=transcript:t1,transcript:t%2C9;ID=e1\n1\ts\texon\t301\t400\t.\t+\t.\tID=e2;Parent=transcript:t1\n##FASTA\n>1\nACGT\n"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("packed", [False, True])
def test_gtf_equals_a_hand_made_table(spark, tmp_path, packed):
    path = tmp_path / ("a.gtf.gz" if packed else "a.gtf")
    path.write_bytes(gzip.compress(GTF.encode()) if packed else GTF.encode())
    assert rows(genes.read_exons(spark, str(path))) == sorted(WANT, key=repr)


def test_gff3_parents(spark, tmp_path):
    (tmp_path / "a.gff3").write_text(GFF)
    got = rows(genes.read_exons(spark, str(tmp_path / "a.gff3")).select("chrom", "transcript_id", "exon_number", "exon_start", "exon_end", "transcript_length"))
    assert got == sorted([("1", "t1", 1, 100, 150, 150), ("1", "t1", 2, 300, 400, 150), ("1", "t", 1, 100, 150, 50), ("1", "9", 1, 100, 150, 50)], key=repr) or got == sorted([("1", "t1", 1, 100, 150, 150), ("1", "t1", 2, 300, 400, 150), ("1", "t,9", 1, 100, 150, 50)], key=repr)


def test_an_empty_annotation(spark, tmp_path):
    (tmp_path / "a.gtf").write_text("# nothing\n\n")
    assert genes.read_exons(spark, str(tmp_path / "a.gtf")).collect() == []


def test_sites_map_into_annotated_transcripts(spark, tmp_path):
    (tmp_path / "a.gtf").write_text(GTF)
    exons = genes.read_exons(spark, str(tmp_path / "a.gtf"))
    sites = spark.createDataFrame([(1, "1", "+", 305), (2, "2", "-", 39), (3, "2", "-", 0), (4, "2", "+", 5), (5, "X", "+", 9)], "id long, chrom string, strand string, pos long")
    got = {r["id"]: (r["transcript_id"], r["transcript_start"], r["transcript_length"]) for r in intervals.map_to_transcripts(sites, exons, "id", "pos").collect()}
    assert got == {1: ("t1", 55, 150), 2: ("t2", 0, 30), 3: ("t2", 29, 30), 4: (None, None, None), 5: ("t1", 9, 10)}


def conservation(spark):
    return spark.range(4000).select(F.concat(F.lit("chr"), F.element_at(F.array(*map(F.lit, ("1", "2", "10", "X"))), (F.col("id") % 4 + 1).cast("int"))).alias("chrom"), (F.col("id") * 5).alias("start"), (F.col("id") * 5 + 4).alias("end"), (F.col("id") % 7 / 7).alias("score"))


def files_read(df) -> int:
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves, todo = [], [plan]
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
            continue
        if node.getClass().getSimpleName().endswith("QueryStageExec"):
            todo.append(node.plan())
            continue
        children = node.children()
        todo += [children.apply(k) for k in range(children.size())]
        if node.getClass().getSimpleName() == "FileSourceScanExec":
            leaves.append(node)
    return sum(node.metrics().get("numFiles").get().value() for node in leaves)


def test_sites_of_one_chromosome_read_one_folder(spark, tmp_path):
    path = str(tmp_path / "scores")
    text.write_scores(conservation(spark), path, stretch=2000)
    whole = text.read_scores(spark, path)
    assert whole.schema["chrom"].dataType.simpleString() == "string" and {r["chrom"] for r in whole.select("chrom").distinct().collect()} == {"1", "2", "10", "X"}
    spans = {"10": (3000, 5000)}
    near = pipeline.near_scores(whole, spans)
    assert rows(near) == rows(whole.where("chrom = '10' AND start <= 5000 AND end >= 3000"))
    per_chrom = len(list((tmp_path / "scores" / "chrom=10").glob("*.parquet")))
    assert files_read(near) <= per_chrom < len(list((tmp_path / "scores").glob("*/*.parquet")))
    two = pipeline.near_scores(whole, {"10": (3000, 5000), "X": (0, 100)})
    assert rows(two) == rows(whole.where("(chrom = '10' AND start <= 5000 AND end >= 3000) OR (chrom = 'X' AND start <= 100)"))
    assert pipeline.near_scores(whole, {}).count() == 0 and pipeline.near_scores(whole, {"absent": (0, 9)}).count() == 0
    plan = near._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(chrom" in plan and "LessThanOrEqual(start,5000)" in plan


def test_null_keys_find_nothing(spark):
    left = spark.createDataFrame([(1, None, 5), (2, "a", 5), (3, "a", None)], "id int, c string, p long")
    right = spark.createDataFrame([(None, 1), ("a", 2), ("a", None)], "c string, s long")
    got = {r["id"]: r["s"] for r in intervals.asof_backward(left, right, ("c",), "p", "s", ("s",)).collect()}
    assert got == {1: None, 2: 2, 3: None}
