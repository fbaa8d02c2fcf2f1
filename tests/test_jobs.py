"""The jobs over growing copies of their input: two runs, reruns, new and lost pieces, their command lines."""

import json
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from jobs import common, motif_scan, site_features
from jobs.queries import ORACLES, QUERIES

from .duck import connect, duck_rows, spark_rows

SF = "/root/testdata/sf0.001"
SMALL = {"top": 7, "bottom": 4}


def rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_job_equals_its_sql(spark, name, tmp_path):
    df = QUERIES[name](spark, SF)
    assert spark_rows(df) == duck_rows(connect(SF, str(tmp_path)), ORACLES[name], df.columns)


def test_scan_takes_only_what_is_new(spark, tmp_path, caplog):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id")
    source, out, check = (f"file://{tmp_path}/{n}" for n in ("in", "out", "check"))
    docs.where("doc_id < 60").coalesce(1).write.parquet(source)
    with caplog.at_level("INFO"):
        first = rows(motif_scan.run(spark, source, out, check, SMALL))
        docs.where("doc_id >= 60 AND doc_id < 150").coalesce(2).write.mode("append").parquet(source)
        second = rows(motif_scan.run(spark, source, out, check, SMALL))
        third = rows(motif_scan.run(spark, source, out, check, SMALL))
    read = [json.loads(r.message)["rows"] for r in caplog.records if r.name == "jobs.motif_scan" and "read" in json.loads(r.message)]
    assert read == [docs.where("doc_id < 60").count(), docs.where("doc_id >= 60 AND doc_id < 150").count(), 0]
    assert first != second == third
    whole = f"file://{tmp_path}/whole"
    docs.where("doc_id < 150").write.parquet(whole)
    assert rows(motif_scan.run(spark, whole, f"file://{tmp_path}/out2", f"file://{tmp_path}/check2", SMALL)) == second
    # the table of sites is made anew from the increments: losing it, or half of it, is mended by the next run
    spark.createDataFrame([], "x int").write.mode("overwrite").parquet(f"{out}/sites")
    assert rows(motif_scan.run(spark, source, out, check, SMALL)) == second


def test_scan_repeats_a_batch_that_was_not_committed(spark, tmp_path):
    """A batch that wrote its increment and died before its commit is taken again and overwrites it."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    source, out, check = f"file://{tmp_path}/in", f"file://{tmp_path}/out", f"file://{tmp_path}/check"
    docs.write.parquet(source)
    want = rows(motif_scan.run(spark, source, out, check, SMALL))
    for name in ("0", ".0.crc"):
        (tmp_path / "check" / "commits" / name).unlink(missing_ok=True)
    assert rows(motif_scan.run(spark, source, out, check, SMALL)) == want


def test_scan_of_odd_and_of_no_rows(spark, tmp_path):
    odd = spark.createDataFrame([(1, None, 1.0), (2, "", 2.0), (None, "ACGTACGTACGTACGTACGTACGTACGTACGTACGTACGTACGTACGT", 3.0), (3, "12 34", 0.0), (4, "a" * 60, 0.0)], "doc_id long, text string, score double")
    for name, df, n in (("odd", odd, 7), ("none", odd.where("false"), 0)):
        source = f"file://{tmp_path}/{name}"
        df.coalesce(1).write.parquet(source)
        got = motif_scan.run(spark, source, f"{source}-out", f"{source}-check", SMALL).collect()
        assert len([r for r in got if r["end"] == "top"]) == n and {r["contig_order"] for r in got} <= {4}


def test_features_replace_the_chromosomes_that_came(spark, tmp_path):
    for name in ("events", "orders"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{tmp_path}/a/{name}.parquet")
    out = f"file://{tmp_path}/out"
    first = rows(site_features.run(spark, f"{tmp_path}/a", out))
    assert rows(site_features.run(spark, f"{tmp_path}/a", out)) == first and first
    spark.read.parquet(f"{SF}/events.parquet").where("user_id % 4 = 1 AND event_id % 10 < 7").write.parquet(f"{tmp_path}/b/events.parquet")
    spark.read.parquet(f"{SF}/orders.parquet").write.parquet(f"{tmp_path}/b/orders.parquet")
    back = site_features.run(spark, f"{tmp_path}/b", out)
    after = rows(back)
    at = sorted(back.columns).index("chrom")
    assert [r for r in after if r[at] != 1] == [r for r in first if r[at] != 1]
    assert 0 < sum(r[at] == 1 for r in after) < sum(r[at] == 1 for r in first)
    totals = spark.read.json(f"{out}/summary").agg(F.sum("n")).first()[0]
    assert totals == len(after)


def test_settings_stay_as_they_were(spark, tmp_path):
    before = dict(spark.conf.getAll)
    site_features.run(spark, SF, f"file://{tmp_path}/out")
    assert dict(spark.conf.getAll) == before


def test_configuration(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"inner": 3}')
    assert common.configuration(spark, str(tmp_path / "c.json"), {"inner": 1, "outer": 2}) == {"inner": 3, "outer": 2}
    with pytest.raises(ValueError, match="unknown"):
        common.configuration(spark, str(tmp_path / "c.json"), {"outer": 2})


@pytest.mark.parametrize("job", ["motif_scan", "site_features"])
def test_command_lines(tmp_path, job):
    given = {"motif_scan": ["--input", f"{SF}/documents.parquet", "--checkpoint", f"{tmp_path}/check"], "site_features": ["--tables", SF]}[job]
    call = [sys.executable, "-m", f"jobs.{job}", *given, "--output", f"{tmp_path}/out", "--config", f"jobs/conf/{job}.json"]
    done = subprocess.run(call, capture_output=True, text=True, timeout=300, check=False)
    assert done.returncode == 0, done.stderr[-2000:]
    notes = [line for line in done.stderr.splitlines() if f"jobs.{job} {{" in line]
    assert any('"read"' in n for n in notes) and any('"wrote"' in n for n in notes)


def test_jobs_stand_without_the_corpus_operators():
    code = "import sys; import jobs.queries; print([m for m in sys.modules if m.startswith(('sitelark.llm', 'corpus_pipeline'))])"
    assert subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.strip() == "[]"
