"""All sources and sinks, the five stages from files to files, and many models at a time, on tiny inputs made here."""

import functools
import gzip
import json
import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitelark import cli
from sitelark.operators import baselines, features, intervals, mixture, ranks, sequence
from sitelark.plans import batch, pipeline
from sitelark.sources import bigwig, text

RNG = np.random.default_rng(31)
SEQS = {"chr1": "".join(RNG.choice(list("ACGT"), 900)) + "NNNN" + "acgu" * 20, "chr2": "".join(RNG.choice(list("ACGT"), 500)), "tiny": "ACGT"}
PWM_TEXT = "Pos a c g u\n1 0.7 0.1 0.1 0.1\n2 0.1 0.6 0.2 0.1\n3 0.25 0.25 0.3 0.2\n"


def fasta(seqs: dict[str, str], width: int = 60) -> str:
    return "".join(f">{k} more words\n" + "\n".join(v[i : i + width] for i in range(0, len(v), width)) + "\n" for k, v in seqs.items())


def read(spark, path):
    return [(r["chrom"], r["seq"]) for r in text.read_fasta(spark, str(path)).orderBy("contig_order").collect()]


# ---- sources


@pytest.mark.parametrize("name", ["s.fa", "s.fa.gz"])
def test_sequences_plain_and_packed(spark, tmp_path, name):
    body = ("; a comment before\n" + fasta(SEQS)).encode()
    (tmp_path / name).write_bytes(gzip.compress(body) if name.endswith(".gz") else body)
    assert read(spark, tmp_path / name) == [(k, v.upper()) for k, v in SEQS.items()]


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ("\n\n>a\nACGT\n>b\nGG", [("a", "ACGT"), ("b", "GG")]),
        (">a\nAC\n\nGT\n\n>b x\nGG\n", [("a", "ACGT"), ("b", "GG")]),
        ("ACGT\nno header\n", []),
        ("", []),
        (">a\r\nAC\r\n>b\r\nGG\r\n", [("a", "AC"), ("b", "GG")]),
        (">only", [("only", "")]),
    ],
)
def test_sequences_at_the_edges(spark, tmp_path, body, want):
    (tmp_path / "x.fa").write_text(body, newline="")
    assert read(spark, tmp_path / "x.fa") == want


@pytest.mark.parametrize("body", [">a\nAC\n>\nTTTT\n>c\nGG\n", ">\nAC\n", ">a\nAC\n> \t\nGG\n"])
def test_a_header_without_a_name_is_an_error(spark, tmp_path, body):
    (tmp_path / "x.fa").write_text(body)
    with pytest.raises(Exception, match="no name"):
        read(spark, tmp_path / "x.fa")


def test_several_sequence_files_keep_their_first_records(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.fa").write_text(f"\n>c{k}\nAC\n>d{k}\nGT\n")
    assert sorted(read(spark, tmp_path)) == sorted((f"{x}{k}", s) for k in range(3) for x, s in (("c", "AC"), ("d", "GT")))
    (tmp_path / "again.fa").write_text(">c1\nAC\n")
    with pytest.raises(ValueError, match="more than once"):
        text.check_unique_contigs(text.read_fasta(spark, str(tmp_path)))


def test_matrices(spark, tmp_path):
    (tmp_path / "m.txt").write_text(PWM_TEXT)
    p = np.exp(text.read_pwm(spark, str(tmp_path / "m.txt")))
    assert np.allclose(p.sum(axis=1), 1) and np.allclose(p[0], [0.7, 0.1, 0.1, 0.1])
    for bad in ("Pos A C G T U\n1 1 1 1 1 1\n", "Pos A C G\n1 1 1 1\n", "A C G T\n1 1 1 1\n"):
        with pytest.raises(ValueError):
            text.parse_pwm(bad)
    assert np.allclose(text.parse_background("1, 1 2 4"), [0.125, 0.125, 0.25, 0.5])
    for bad in ("1 1 1", "1 1 1 0", "1 1 1 inf", "1 1 1 -1"):
        with pytest.raises(ValueError):
            text.parse_background(bad)


def test_tables(spark, tmp_path):
    with gzip.open(tmp_path / "sites.tsv.gz", "wt") as f:
        f.write("chrom\tpos1\tstrand\tinner_mean_logPWM\touter_mean_logPWM\tGC_inner_pct\tGC_outer_pct\tkmer_count_inner\tkmer_count_outer\nc_1\t12\t-\t-0.5\tnan\t40.0\t50.5\t9\t0\n")
    (r,) = text.read_sites(spark, str(tmp_path / "sites.tsv.gz")).collect()
    assert tuple(r)[:4] == ("c_1", 12, "-", -0.5) and math.isnan(r["outer_mean_logPWM"]) and r["kmer_count_outer"] == 0
    (tmp_path / "as.tsv").write_text("c\t5\t+\t0.25\t7\tUUUU\nc\t6\t-\t\t\tx\n")
    signal = text.read_signal(spark, str(tmp_path / "as.tsv"))
    assert signal.columns == ["chrom", "at", "strand", "val", "depth"] and [tuple(r) for r in signal.collect()] == [("c", 5, "+", 0.25, 7), ("c", 6, "-", None, None)]
    assert "motif" not in signal.select("at")._jdf.queryExecution().executedPlan().toString()
    (tmp_path / "r.bed").write_text("# first\nchr1\t10\t20\tr1\n#chr2\t1\t2\tx\nchrX\t5\t6\tr2\n")
    assert [tuple(r) for r in text.read_regions(spark, str(tmp_path / "r.bed")).collect()] == [("1", 10, 20, "r1"), ("X", 5, 6, "r2")]
    (tmp_path / "p.bed").write_text("chr1\t10\t20\tpk\t1.5\t+\tRBP\tm\tHeLa\tsrc\nchr1\tnot\t20\tpk2\tx\t-\tRBP\tm\tHeLa\tsrc\n")
    a, b = text.read_peaks(spark, str(tmp_path / "p.bed")).collect()
    assert tuple(a) == ("chr1", 10, 20, "pk", 1.5, "+", "RBP", "m", "HeLa", "src") and b["start"] is None and b["strand"] == "-"
    spark.createDataFrame([("1", k, k + 5, 0.1 * k) for k in range(0, 100, 10)], "chrom string, start long, end long, score double").write.parquet(str(tmp_path / "scores"))
    part = text.read_scores(spark, str(tmp_path / "scores"), 20, 50)
    assert sorted(r["start"] for r in part.collect()) == [20, 30, 40, 50]
    assert "PushedFilters: [IsNotNull(start), GreaterThanOrEqual(start,20), LessThanOrEqual(start,50)]" in part._jdf.queryExecution().executedPlan().toString()


def test_discovery_and_names(spark, tmp_path):
    for name in ("M2_x.parquet", "M1_x.parquet", "other.txt"):
        (tmp_path / name).write_text("x")
    (tmp_path / "names.tsv").write_text("Motif_ID\tRBP_Name\nM1\tOLD\nM1\tNEW\nM2\t.\nM3\t \nM4\tR4\n")
    files = text.discover(spark, f"{tmp_path}/*", "_x.parquet")
    assert [r["motif"] for r in files.collect()] == ["M1", "M2"]
    names = text.read_motif_map(spark, str(tmp_path / "names.tsv"))
    assert {(r["motif"], r["rbp"]) for r in names.collect()} == {("M1", "NEW"), ("M4", "R4")}
    peaks = spark.createDataFrame([("NEW", "p1"), ("R4", "p4")], "motif string, path string")
    assert [(r["title"], r["peaks_path"]) for r in batch.jobs_table(files, names, peaks).collect()] == [("NEW_M1", "p1")]
    assert [(r["title"], r["peaks_path"]) for r in batch.jobs_table(files, names, peaks, strict=False).collect()] == [("M2_M2", None), ("NEW_M1", "p1")]
    with pytest.raises(Exception, match="no rbp for M2"):
        features.lookup_strict(files, names, "motif", "rbp").collect()


def big_wig(chroms: dict[str, list[tuple[int, list, int]]], end: str = "<", packed: bool = True) -> bytes:
    """A BigWig of hand: for each chromosome its blocks (kind, rows, span or step)."""
    sizes = list(chroms)
    key = max(map(len, sizes))
    head = 64
    tree = struct.pack(end + "IIIIQQ", bigwig.TREE_MAGIC, len(sizes), key, 8, len(sizes), 0) + struct.pack(end + "BBH", 1, 0, len(sizes))
    tree += b"".join(name.encode().ljust(key, b"\0") + struct.pack(end + "II", i, 10_000) for i, name in enumerate(sizes))
    blocks, at = [], head + len(tree)
    for i, name in enumerate(sizes):
        for kind, rows, step in chroms[name]:
            first = rows[0][0] if kind != bigwig.FIXED_STEP else step[0]
            raw = struct.pack(end + "IIIIIBBH", i, first, 9999, step[1] if kind == bigwig.FIXED_STEP else 0, step[2] if kind == bigwig.FIXED_STEP else (step or 0), kind, 0, len(rows))
            form = {bigwig.BED_GRAPH: "IIf", bigwig.VARIABLE_STEP: "If", bigwig.FIXED_STEP: "f"}[kind]
            raw += b"".join(struct.pack(end + form, *(r if isinstance(r, tuple) else (r,))) for r in rows)
            body = zlib.compress(raw) if packed else raw
            blocks.append((i, at, body))
            at += len(body)
    index = struct.pack(end + "IIQIIIIQII", bigwig.INDEX_MAGIC, 256, len(blocks), 0, 0, 0, 0, 0, 1, 0) + struct.pack(end + "BBH", 1, 0, len(blocks))
    index += b"".join(struct.pack(end + "IIIIQQ", i, 0, i, 9999, o, len(b)) for i, o, b in blocks)
    header = struct.pack(end + "IHHQQQHHQQIQ", bigwig.MAGIC, 4, 0, head, head + len(tree), at, 0, 0, 0, 0, 1 << 16 if packed else 0, 0)
    return header + tree + b"".join(b for _, _, b in blocks) + index


@pytest.mark.parametrize(("end", "packed"), [("<", True), (">", False)])
def test_big_wig(spark, tmp_path, end, packed):
    nan = float("nan")
    data = big_wig({"1": [(bigwig.BED_GRAPH, [(5, 8, 1.5), (8, 9, nan)], None), (bigwig.VARIABLE_STEP, [(20, 2.0), (30, 3.0)], 2)], "X": [(bigwig.FIXED_STEP, [0.5, 0.25], (100, 10, 3))]}, end, packed)
    (tmp_path / "t.bw").write_bytes(data)
    got = [tuple(r)[1:] for r in bigwig.read_bigwig(spark, str(tmp_path / "t.bw")).orderBy("chrom", "start").collect()]
    assert got == [("1", 5, 8, 1.5), ("1", 20, 22, 2.0), ("1", 30, 32, 3.0), ("X", 100, 103, 0.5), ("X", 110, 113, 0.25)]
    assert [tuple(r) for r in bigwig.per_base(bigwig.read_bigwig(spark, str(tmp_path / "t.bw")).where("start = 5")).orderBy("at").collect()] == [("1", 5, 1.5), ("1", 6, 1.5), ("1", 7, 1.5)]
    assert sum(1 for _ in bigwig.intervals(data)) == 6
    with pytest.raises(ValueError):
        list(bigwig.intervals(b"nothing of the kind, at sixty-four bytes of length or a little more"))


# ---- sinks


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b", 1.5, 2), ("a", float("nan"), 1)], "k string, v double, n long")
    text.write_table(df.coalesce(1), str(tmp_path / "t"))
    (part,) = (tmp_path / "t").glob("part-*.gz")
    assert gzip.open(part, "rt").read() == "k\tv\tn\nb\t1.5\t2\na\tnan\t1\n"
    text.write_table(df.coalesce(1), str(tmp_path / "u"), compress=False)
    assert next((tmp_path / "u").glob("part-*.csv")).read_text().startswith("k\tv\tn\n")
    text.write_parquet(df, str(tmp_path / "p"), ("k",))
    assert [r["k"] for r in spark.read.parquet(str(tmp_path / "p")).coalesce(1).collect()] == ["a", "b"]
    record = {"a": 1, "b": [float("nan"), 2.0], "c": {"d": math.inf}}
    text.write_json(spark, record, str(tmp_path / "j.json"))
    assert text.read_json(spark, str(tmp_path / "j.json")) == {"a": 1, "b": [None, 2.0], "c": {"d": None}}
    assert json.loads(next((tmp_path / "j.json").glob("part-*")).read_text()) == text.read_json(spark, str(tmp_path / "j.json"))
    from datetime import datetime

    assert text.stamped("scan", datetime(2024, 3, 5, 6, 7, 8)) == "scan.20240305_060708"


# ---- plans


def test_tiles_of_one_contig_lie_in_many_partitions(spark):
    seqs = spark.createDataFrame([("c", 0, "ACGTTGCA" * 2500)], "chrom string, contig_order long, seq string")
    spread = sequence.tiles(seqs, 1000, 50).select(F.spark_partition_id().alias("p"), F.length("part").alias("n")).groupBy("p").agg(F.count("n").alias("n"))  # with payload
    assert spread.count() > 1 and spread.agg(F.sum("n")).first()[0] == 20
    scored = sequence.scan_windows(seqs, np.log(np.full((2, 4), 0.25)), 5, 20, tile=1000).groupBy(F.spark_partition_id().alias("p")).agg(F.sum("inner_mean"))
    assert scored.count() > 1


def test_workers_keep_the_best_alone(spark):
    w = np.log(np.array([[0.7, 0.1, 0.1, 0.1], [0.1, 0.6, 0.2, 0.1]]))
    seqs = spark.createDataFrame([(f"c{k}", k, s) for k, s in enumerate([*SEQS.values(), "A" * 300, "A" * 200])], "chrom string, contig_order long, seq string")
    whole = sequence.scan_windows(seqs, w, 5, 20, tile=128)
    for keep, pick in (((7, 0), sequence.top_sites), ((0, 7), sequence.bottom_sites)):
        few = sequence.scan_windows(seqs, w, 5, 20, tile=128, keep=keep)
        assert few.count() < whole.count() and [tuple(r) for r in pick(few, 7).collect()] == [tuple(r) for r in pick(whole, 7).collect()]
    assert sequence.scan_windows(seqs, w, 5, 20, columns=("pos1", "inner_mean")).columns == ["pos1", "inner_mean"]


@pytest.mark.parametrize(("top", "bottom"), [(7, 5), (1, 0), (0, 3), (100, 100), (100_000, 100_000), (0, 0)])
def test_both_ends_of_a_scan(spark, top, bottom):
    """Ties at the last wanted score (equal contigs, both strands) go by contig, position and strand; more than there is gives all."""
    w = np.log(np.array([[0.7, 0.1, 0.1, 0.1], [0.1, 0.6, 0.2, 0.1]]))
    seqs = spark.createDataFrame([(f"c{k}", k, s) for k, s in enumerate([*SEQS.values(), "A" * 300, "ACGT" * 60, "ACGT" * 60])], "chrom string, contig_order long, seq string")
    whole = [tuple(r) for r in sequence.scan_windows(seqs, w, 5, 20, tile=128).collect()]
    key = lambda r, up: (r[4] if up else -r[4], r[1], r[2], r[3])
    best, worst = sequence.scan_ends(seqs, w, 5, 20, top, bottom, tile=128)
    plain = lambda rows: sorted(map(repr, rows))
    assert plain(tuple(r) for r in best.collect()) == plain(sorted(whole, key=lambda r: key(r, False))[:top])
    assert plain(tuple(r) for r in worst.collect()) == plain(sorted(whole, key=lambda r: key(r, True))[:bottom])
    for end in (best, worst):
        assert "TakeOrdered" not in end._jdf.queryExecution().toString()


def test_first_rows_of_equal_keys_and_of_none(spark):
    df = spark.range(3000).select((F.col("id") % 2).alias("k"), F.col("id").alias("_row"), F.lit("x").alias("_range"))
    rows, n = ranks.numbered(df, [F.col("k")])
    got = rows.collect()
    assert n == 3000 and sorted(r["row"] for r in got) == list(range(3000)) and all((r["row"] >= 1500) == (r["k"] == 1) for r in got)
    assert rows.columns == ["k", "_row", "_range", "row"]
    assert ranks.first_rows(df, 1700, [-F.col("k")]).groupBy("k").count().orderBy("k").collect() == [(0, 200), (1, 1500)]
    assert ranks.first_rows(df.where("false"), 3, [F.col("k")]).count() == 0 and ranks.first_rows(df, 0, [F.col("k")]).count() == 0


def test_overlaps_of_all_widths(spark):
    rng = np.random.default_rng(5)
    rows = lambda n, tag: [(f"k{rng.integers(2)}", int(s), int(s + rng.choice([0, 1, 30, 900, 70_000, 5_000_000])), f"{tag}{k}") for k, s in enumerate(rng.integers(-50_000, 6_000_000, n))]
    a, b = rows(120, "a"), rows(120, "b")
    left, right = spark.createDataFrame(a, "c string, s long, e long, a string"), spark.createDataFrame(b, "c string, rs long, re long, b string")
    got = sorted((r["a"], r["b"]) for r in intervals.overlap_pairs(left, right, ("c",), ("s", "e"), ("rs", "re"), 100).collect())
    assert got == sorted((x[3], y[3]) for x in a for y in b if x[0] == y[0] and x[1] < y[2] and y[1] < x[2])


@pytest.mark.parametrize("width", [1 << 16, 7])
def test_asof_over_bins(spark, width):
    rng = np.random.default_rng(6)
    left = [(int(k), f"k{rng.integers(3)}", int(p) if k % 17 else None) for k, p in enumerate(rng.integers(-100, 400, 150))]
    right = [(f"k{rng.integers(2)}", int(p), int(p) % 13) for p in rng.integers(-50, 350, 40)]
    l, r = spark.createDataFrame(left, "i long, c string, at long"), spark.createDataFrame(right, "c string, p long, v long")  # noqa: E741
    got = {x["i"]: (x["p"], x["v"]) for x in intervals.asof_backward(l, r, ("c",), "at", "p", ("p", "v"), width).collect()}
    want = {i: max(((p, v) for k, p, v in right if k == c and at is not None and p <= at), default=(None, None)) for i, c, at in left}
    assert got == want


def test_legacy_scaling_shifts_columns(spark):
    """T24: by default the listed features are scaled; in legacy mode each column by the index before it."""
    assert pipeline.scaled_columns(pipeline.FEATURES) == ["inner_mean_logPWM", "outer_mean_logPWM", "GC_inner_pct", "GC_outer_pct", "TPM", "score_phylop100"]
    assert pipeline.scaled_columns(pipeline.FEATURES, legacy=True) == ["inner_mean_logPWM", "outer_mean_logPWM", "GC_inner_pct", "PhastCons100_percent", "score_phastcons100"]
    assert pipeline.scaled_columns(("TPM", "TSS_proximity")) == ["TPM"]


def test_run_away_coefficients_are_noted():
    """T26: a converged fit may have coefficients without bound."""
    assert mixture.warned(mixture.Mixture([1.0, -60.0], 0, 1, 1, 1)).warnings and not mixture.warned(mixture.Mixture([1.0, 2.0], 0, 1, 1, 1)).warnings


def test_variance_of_large_scores(spark, monkeypatch):
    monkeypatch.setattr(mixture, "LOCAL_ROWS", 0)
    rng = np.random.default_rng(9)
    s = np.r_[rng.normal(1e8, 1, 400), rng.normal(1e8 + 20, 2, 400)]
    m = mixture.fit_groups(spark.createDataFrame([("a", float(v), float(x)) for v, x in zip(s, rng.normal(size=800), strict=True)], "g string, s double, x double"), "g", "s", ["x"], steps=4)["a"]
    assert abs(m.sigma0 - 1) < 0.2 and abs(m.sigma1 - 2) < 0.3


def test_model_records(spark):
    m = mixture.Mixture([0.5, float("nan")], 1.0, 2.0, 3.0, 4.0, 7, True, -5.0, 0.4, 0.41, warnings=["w"])
    record = pipeline.model_record(m)
    assert set(record) == {"mode", "beta", "gaussian_params", "diagnostics", "warnings"} and record["mode"] == "em_gaussian" and record["diagnostics"]["iters"] == 7
    back = pipeline.model_of_record(json.loads(json.dumps(record).replace("NaN", "null")))
    assert back.mu1 == 3.0 and back.converged and math.isnan(back.beta[1]) and back.warnings == ["w"]


def brute_zscore(x):
    return (x - x.mean()) / x.std()


def modelled_sites(n: int = 400, seed: int = 12):
    """Rows id, s_l and all features, with a few that no model can use."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, len(pipeline.FEATURES)))
    bound = rng.random(n) < 1 / (1 + np.exp(-(x[:, 0] - x[:, 3])))
    s = np.exp(np.where(bound, rng.normal(4, 0.6, n), rng.normal(1.5, 0.5, n))) - 1 + 1e-9
    rows = [(f"c_1_{1000 * (k + 1)}_{'+-'[k % 2]}", float(s[k]), *map(float, x[k])) for k in range(n)]
    rows[3] = (*rows[3][:2], None, *rows[3][3:])
    rows[5] = (*rows[5][:1], None, *rows[5][2:])
    return rows, bound


SITE_SCHEMA = "id string, s_l double, " + ", ".join(f"{c} double" for c in pipeline.FEATURES)


def test_evaluation_scales_and_counts(spark):
    rows, bound = modelled_sites()
    modelled, fitted = pipeline.model(spark.createDataFrame(rows, SITE_SCHEMA))
    assert modelled.count() == 398 and {"prior_p", "posterior_r"} <= set(modelled.columns)
    all_sites = spark.createDataFrame(rows, SITE_SCHEMA).join(modelled.select("id", "prior_p", "posterior_r"), "id", "left")
    peaks = spark.createDataFrame([("c_1", "+-"[k % 2], 1000 * (k + 1), 1000 * (k + 1) + 5) for k in range(400) if bound[k]], "chrom string, strand string, start long, end long")
    out = pipeline.evaluation(all_sites, peaks, peaks.limit(0), fitted, limit=0.8, title="t")
    (m,) = out["metrics"].collect()
    assert len(m) == 28 and m["file_title"] == "t"
    label = ["clip_bound" if bound[k] else "clip_unbound" if r[2 + 7] is not None and r[2 + 7] <= 0.8 else "non_determined" for k, r in enumerate(rows)]
    for k in ("clip_bound", "clip_unbound", "non_determined"):
        assert m[f"n_{k}_motif_df"] == label.count(k) and m[f"n_{k}_out_df"] == sum(v == k for i, v in enumerate(label) if i not in (3, 5))
    # the supervised baseline by gradient on columns scaled by hand
    used = [i for i in range(400) if i not in (3, 5)]
    x = np.array([rows[i][2:] for i in used], float)
    for k, c in enumerate(pipeline.FEATURES):
        if c not in pipeline.RAW:
            x[:, k] = brute_zscore(x[:, k])
    known = np.array([label[i] != "non_determined" for i in used])
    y = np.array([label[i] == "clip_bound" for i in used])[known].astype(float)
    co = {r["feature"]: (r["beta_em"], r["beta_lr"]) for r in out["coefficients"].collect()}
    w = np.array([co[c][1] for c in pipeline.FEATURES])
    p = 1 / (1 + np.exp(-(co["intercept"][1] + x[known] @ w)))
    assert np.allclose(x[known].T @ (p - y) + w, 0, atol=1e-5) and abs((p - y).sum()) < 1e-5
    assert co["intercept"][0] == fitted.beta[0] and out["coefficients_sl"].count() == 11
    assert m["auc_em"] > 0.8 and m["auc_lr_sl"] > m["auc_lr"] > 0.6
    with pytest.raises(ValueError, match="missing columns"):
        pipeline.evaluation(all_sites.drop("s_l"), peaks, peaks, fitted)


def test_grouped_models_agree_with_single_ones(spark):
    a, b = (spark.createDataFrame(modelled_sites(300, k)[0], SITE_SCHEMA) for k in (1, 2))
    rows, fitted = pipeline.model_groups(a.withColumn("g", F.lit("a")).unionByName(b.withColumn("g", F.lit("b"))).withColumn("text", F.lit("clash")), "g")
    assert set(fitted) == {"a", "b"} and rows.groupBy("g").count().count() == 2
    for name, df in (("a", a), ("b", b)):
        alone_rows, alone = pipeline.model(df)
        assert abs(alone.mu0 - fitted[name].mu0) < 1e-6 and np.allclose(alone.beta, fitted[name].beta, atol=1e-5)
        got = {r["id"]: r["posterior_r"] for r in rows.where(F.col("g") == name).collect()}
        assert all(abs(got[r["id"]] - r["posterior_r"]) < 1e-6 for r in alone_rows.collect())


# ---- from files to files


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    d = tmp_path_factory.mktemp("stage")
    rng = np.random.default_rng(21)
    (d / "s.fa").write_text(fasta(SEQS))
    (d / "m.txt").write_text(PWM_TEXT)
    for name, low in (("native", 0.2), ("fixed", 0.4)):
        rows = [f"{c}\t{at}\t{s}\t{rng.normal(low, 0.3) + 0.5 * (at % 7 == 0):.6f}\t{rng.integers(1, 9)}\tU" for c, n in (("chr1", 980), ("chr2", 500)) for s in "+-" for at in range(1, n)]
        (d / f"{name}.tsv").write_text("\n".join(rows) + "\n")
    (d / "r.bed").write_text("# regions\nchr1\t100\t180\tr1\nchr1\t150\t400\tr2\nchr2\t0\t90\tr3\n")
    return d


def run(spark, *argv):
    cli.main([str(x) for x in argv], spark)


def tables(spark, d):
    chrom = lambda k: ("1", "2")[k % 2]
    spark.createDataFrame([(chrom(k), "+-"[k // 2 % 2], f"T{k}", 100 * k, 100 * k + 90) for k in range(9)], "chrom string, strand string, transcript_id string, exon_start long, exon_end long").write.mode("overwrite").parquet(str(d / "exons"))
    spark.createDataFrame([(f"T{k}", 1.5 * k) for k in range(6)], "transcript_id string, TPM double").write.mode("overwrite").parquet(str(d / "tpm"))
    for name, scale in (("phast", 0.01), ("phylo", -0.02)):
        spark.createDataFrame([(c, s, s + 19, scale * ((s * 7) % 200) + 0.1) for c in ("1", "2") for s in range(-100, 1000, 20)], "chrom string, start long, end long, score double").write.mode("overwrite").parquet(str(d / name))
    spark.createDataFrame([("chr1", "+", 300, 420), ("chr2", "-", 10, 60)], "chrom string, strand string, start long, end long").write.mode("overwrite").parquet(str(d / "pip"))


def test_all_stages_by_command_line(spark, files):
    d = files
    tables(spark, d)
    run(spark, "scan", d / "s.fa", d / "m.txt", "--out", d / "scan", "--inner", 5, "--outer", 20, "--top", 120, "--bottom", 60, "--background-from-fasta")
    top = text.read_sites(spark, str(d / "scan_topA.tsv.gz"))
    bottom = text.read_sites(spark, str(d / "scan_botB.tsv.gz"))
    assert top.count() == 120 and bottom.count() == 60
    best = [r["inner_mean_logPWM"] for r in top.collect()]
    assert min(best) >= max(r["inner_mean_logPWM"] for r in bottom.collect())
    places = [(r["chrom"], r["pos1"]) for r in top.collect()]
    assert places == sorted(places) and all(1 <= p <= 984 for _, p in places)
    # U counts as T: the share of bases has it
    joined = SEQS["chr1"].upper() + SEQS["chr2"] + SEQS["tiny"]
    share = {r["base"]: r["n"] for r in sequence.base_composition(text.read_fasta(spark, str(d / "s.fa"))).collect()}
    assert share["T"] == joined.count("T") + joined.count("U") and share["A"] == joined.count("A")

    run(spark, "accessibility", d / "scan_topA.tsv.gz", d / "native.tsv", d / "fixed.tsv", d / "acc", "--inner", 5, "--outer", 20)
    acc = spark.read.parquet(str(d / "acc"))
    assert 0 < acc.count() <= 120 and {"id", "s_l", "t_native"} <= set(acc.columns)
    r = acc.where(F.col("s_l").isNotNull()).first()
    assert r["id"] == f"{r['chrom']}_{r['pos1']}_{r['strand']}" and abs(r["s_l"] - r["t_native"] ** 2 - r["t_fixed"] ** 2) < 1e-9

    run(spark, "annotate", d / "acc", d / "exons", d / "r.bed", d / "tpm", d / "phast", d / "phylo", d / "ann", "--collapse", "max")
    ann = spark.read.parquet(str(d / "ann"))
    assert set(pipeline.FEATURES) <= set(ann.columns) and ann.count() == ann.select("id").distinct().count()
    for r in ann.collect():
        spots = [max(0, min(b, r["pos1"] + 50) - max(a, r["pos1"] - 50)) / 100 for c, a, b in (("1", 100, 180), ("1", 150, 400), ("2", 0, 90)) if c == r["chrom"]]
        assert abs(r["PhastCons100_percent"] - max(spots)) < 1e-12
        begin = (r["pos1"] - 50) // 20 * 20
        assert abs(r["score_phastcons100"] - (0.01 * ((begin * 7) % 200) + 0.1)) < 1e-12
        assert r["TSS_proximity"] == 0 if r["transcript_id"] is None else 0 < r["TSS_proximity"] <= 1
        assert r["TPM"] == (1.5 * int(r["transcript_id"][1:]) if r["transcript_id"] and int(r["transcript_id"][1:]) < 6 else 0)

    run(spark, "model", d / "ann", d / "fit")
    record = text.read_json(spark, str(d / "fit.model.json"))
    assert len(record["beta"]) == 10 and record["gaussian_params"]["mu0"] <= record["gaussian_params"]["mu1"] + 5
    rows = spark.read.parquet(str(d / "fit.model.parquet"))
    assert all(0 <= r["posterior_r"] <= 1 and 0 <= r["prior_p"] <= 1 for r in rows.collect())

    (d / "peaks.bed").write_text("".join(f"{r['chrom'] if r['chrom'].startswith('chr') else 'chr' + r['chrom']}\t{r['pos1'] - 2}\t{r['pos1'] + 2}\tp\t1.0\t{r['strand']}\tR\tm\tc\ts\n" for k, r in enumerate(ann.orderBy("id").collect()) if k % 2))
    run(spark, "evaluate", d / "fit.model.parquet", d / "peaks.bed", d / "pip", d / "eval", "--title", "R_M")
    head = next((d / "eval" / "metrics").glob("part-*")).read_text().splitlines()[0].split("\t")
    assert len(head) == 28 and head[0] == "file_title"
    assert next((d / "eval" / "coefficients").glob("part-*")).read_text().count("\n") == 11


def test_dense_tracks_by_command_line(spark, files):
    d = files
    track = lambda shift: {c: [(bigwig.BED_GRAPH, [(k, k + 1, math.sin(k + shift) + (k % 5)) for k in range(n)], None)] for c, n in (("chr1", 980), ("chr2", 500))}
    for name, shift in (("n", 0.0), ("f", 1.0), ("m", 2.0)):
        (d / f"{name}.bw").write_bytes(big_wig(track(shift)))
    run(spark, "scan", d / "s.fa", d / "m.txt", "--out", d / "dense", "--inner", 5, "--outer", 20, "--top", 40, "--bottom", 0, "--background", "1 1 1 1")
    run(spark, "accessibility", d / "dense_topA.tsv.gz", f"{d}/n.bw,{d}/m.bw", d / "f.bw", d / "dense", "--inner", 5, "--outer", 20)
    out = spark.read.parquet(str(d / "dense"))
    assert out.count() == 40
    for r in out.collect():
        n = {"chr1": 980, "chr2": 500}[r["chrom"]]

        def t(shift, r=r, n=n):
            v = lambda a, b: np.array([np.float32(math.sin(k + shift) + (k % 5)) for k in range(max(a, 0), min(b, n))], float)
            p = r["pos1"]
            inner, outer = v(p - 5, p + 5), np.r_[v(p - 20, p - 5), v(p + 5, p + 20)]
            below = inner.var() / len(inner) + outer.var() / len(outer)
            return (inner.mean() - outer.mean()) / below if len(inner) >= 8 and len(outer) >= 8 and below > 0 else 0.0

        assert abs(r["s_l"] - t(0.0 if r["strand"] == "+" else 2.0) ** 2 - t(1.0) ** 2) < 1e-6


def test_many_models_go_on_past_failures(spark, tmp_path):
    for k, name in enumerate(("M1", "M2")):
        spark.createDataFrame(modelled_sites(300, 40 + k)[0], SITE_SCHEMA).write.parquet(str(tmp_path / f"in/{name}.parquet"))
    spark.createDataFrame([("x", 1.0)], "id string, s_l double").write.parquet(str(tmp_path / "in/M3.parquet"))
    spark.createDataFrame(modelled_sites(10)[0], SITE_SCHEMA).withColumn("s_l", F.lit(None).cast("double")).write.parquet(str(tmp_path / "in/M4.parquet"))
    jobs = [(f"R_{m}", str(tmp_path / f"in/{m}.parquet")) for m in ("M1", "M2", "M3", "M4", "M5")]
    status = {r["title"]: r for r in batch.batch_fit(spark, jobs, str(tmp_path / "out")).collect()}
    assert {t: r["ok"] for t, r in status.items()} == {"R_M1": True, "R_M2": True, "R_M3": False, "R_M4": False, "R_M5": False}
    assert "missing columns" in status["R_M3"]["error"] and "no row" in status["R_M4"]["error"] and "PATH_NOT_FOUND" in status["R_M5"]["error"] and status["R_M1"]["n"] == 298
    peaks = "".join(f"c_1\t{1000 * k - 5}\t{1000 * k + 5}\tp\t1\t{s}\tR\tm\tc\ts\n" for k in range(1, 300, 2) for s in "+-")
    (tmp_path / "p.bed").write_text(peaks)
    spark.createDataFrame([("c_1", "+", 1, 2)], "chrom string, strand string, start long, end long").write.parquet(str(tmp_path / "pip"))
    done = batch.batch_evaluate(spark, [("R_M1", str(tmp_path / "p.bed")), ("R_M2", str(tmp_path / "none.bed")), ("R_M9", str(tmp_path / "p.bed"))], str(tmp_path / "pip"), str(tmp_path / "out"))
    rows = {r["title"]: r for r in done.collect()}
    assert {t: r["ok"] for t, r in rows.items()} == {"R_M1": True, "R_M2": False, "R_M9": False} and rows["R_M1"]["auc_em"] is not None and rows["R_M2"]["auc_em"] is None
    assert list((tmp_path / "out/logs/metadata/title=R_M1").glob("part-*"))


def test_models_are_evaluated_in_the_same_jobs(spark):
    """Three models at once give the rows that each gives alone, in as many jobs as one."""
    tables, fitted, peaks = [], {}, []
    for k, t in enumerate(("a", "b", "c")):
        rows, bound = modelled_sites(260 + 20 * k, 60 + k)
        modelled, fitted[t] = pipeline.model(spark.createDataFrame(rows, SITE_SCHEMA))
        all_sites = spark.createDataFrame(rows, SITE_SCHEMA).join(modelled.select("id", "prior_p", "posterior_r"), "id", "left")
        tables.append(spark.createDataFrame(all_sites.withColumn(pipeline.TITLE, F.lit(t)).collect(), all_sites.withColumn(pipeline.TITLE, F.lit(t)).schema))
        peaks.append(spark.createDataFrame([("c_1", "+-"[j % 2], 1000 * (j + 1), 1000 * (j + 1) + 5, t) for j in range(len(rows)) if bound[j] and (t != "c" or j < 0)] or [("none", "+", 0, 1, t)], f"chrom string, strand string, start long, end long, {pipeline.TITLE} string"))
    structured = spark.createDataFrame([("c_1", "+", 1, 2)], "chrom string, strand string, start long, end long")

    def measured(titles, group):
        spark.sparkContext.setJobGroup(group, group)
        pick = [k for k, t in enumerate("abc") if t in titles]
        join = lambda xs: functools.reduce(lambda x, y: x.unionByName(y), [xs[k] for k in pick])
        out = pipeline.evaluation_groups(join(tables), join(peaks), structured, {t: fitted[t] for t in titles}, limit=0.8)
        plain = {n: sorted(out[n].collect(), key=repr) for n in ("metrics", "coefficients", "coefficients_sl")}
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return plain, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    every, jobs = measured("abc", "every")
    for t in "ac":
        alone, n = measured(t, f"alone-{t}")
        assert jobs <= 1.25 * n + 40 or t == "c"
        for name, rows in alone.items():
            own = [r for r in every[name] if r[pipeline.TITLE] == t]
            assert len(own) == len(rows) > 0
            for r, q in zip(own, rows, strict=True):
                for x, y in zip(r, q, strict=True):
                    assert x == y or (isinstance(x, float) and (x != x and y != y or abs(x - y) < 1e-6 * (1 + abs(y)))), (name, r, q)
    (c,) = [r for r in every["metrics"] if r[pipeline.TITLE] == "c"]
    assert c["n_clip_bound_out_df"] == 0 and math.isnan(c["auc_lr"]) and c["auc_em"] is None


def test_separable_classes_end_converged(spark):
    rows = [("a", float(k), int(k > 20)) for k in range(40)] + [("b", float(k % 7), k % 2) for k in range(40)] + [("c", 1.0, 1)] + [("a", None, 1)]
    fits = baselines.fit_logistic_groups(spark.createDataFrame(rows, "g string, x double, y int"), ["g"], ["x"], "y", c=1e6)
    assert fits["a",].converged and fits["b",].converged and fits["c",].one_class and not fits["c",].converged
    single = baselines.fit_logistic(spark.createDataFrame([(x, y) for g, x, y in rows if g == "b"], "x double, y int"), ["x"], "y", c=1e6)
    assert abs(single.coefficients[0] - fits["b",].coefficients[0]) < 1e-9 and single.converged


def test_distribution_fits_read_rows_a_few_times(spark):
    """The fits of binned values are those of the rows, group by group, and the passes over the rows do not grow with the steps of a fit."""
    rng = np.random.default_rng(2)
    data = [("t", float(v)) for v in np.round(rng.standard_t(4, 1500) * 2 + 5, 1)] + [("g", float(v)) for v in np.round(rng.gamma(3, 2, 1200), 1)]
    df = spark.createDataFrame(data, "g string, v double").repartition(3)
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    found = baselines.qq_deviations_groups(df.mapInArrow(seen, df.schema), "v", ["g"])
    assert read.value <= 6 * len(data)  # facts, bins, and the numbering's count, sample and sort
    for g in "tg":
        alone = baselines.qq_deviations(df.where(F.col("g") == g), "v")
        assert all(abs(found[g,][k] - alone[k]) < 1e-6 for k in alone)
    nu, mu, sigma = baselines.fit_student(df.where("g = 't'"), "v", 200)
    v = np.array([x for g, x in data if g == "t"])
    w = (nu + 1) / (nu + ((v - mu) / sigma) ** 2)
    assert abs((w * v).sum() / w.sum() - mu) < 1e-6 and abs(math.sqrt((w * (v - mu) ** 2).mean()) - sigma) < 1e-6


def test_workflow_by_command_line(spark, files, tmp_path):
    d = files
    tables(spark, d)
    run(spark, "scan", d / "s.fa", d / "m.txt", "--out", tmp_path / "motifs/M1", "--inner", 5, "--outer", 20, "--top", 150, "--bottom", 0)
    run(spark, "scan", d / "s.fa", d / "m.txt", "--out", tmp_path / "motifs/M2", "--inner", 5, "--outer", 20, "--top", 2, "--bottom", 0)
    for m in ("M1", "M2"):  # the files of a motif's folder under one name
        (part,) = (tmp_path / f"motifs/{m}_topA.tsv.gz").glob("part-*.gz")
        (tmp_path / f"flat/{m}.tsv.gz").parent.mkdir(exist_ok=True)
        (tmp_path / f"flat/{m}.tsv.gz").write_bytes(part.read_bytes())
    (tmp_path / "names.tsv").write_text("Motif_ID\tRBP_Name\nM1\tR1\nM2\tR2\nM3\tR3\n")
    (tmp_path / "peaks").mkdir()
    for r in ("R1", "R2"):
        (tmp_path / f"peaks/{r}_HeLa.bed").write_text("".join(f"{c}\t{k}\t{k + 30}\tp\t1\t{s}\t{r}\tm\tc\ts\n" for c in ("chr1", "chr2") for s in "+-" for k in range(0, 900, 60)))
    argv = [tmp_path / "flat", tmp_path / "names.tsv", tmp_path / "peaks", tmp_path / "out", d / "pip", d / "native.tsv", d / "fixed.tsv", d / "exons", d / "r.bed", d / "tpm", d / "phast", d / "phylo"]
    run(spark, "workflow", *argv, "--inner", 5, "--outer", 20, "--variant", "kd", d / "fixed.tsv", d / "native.tsv")
    lines = next((tmp_path / "out/status").glob("part-*")).read_text().splitlines()
    status = {line.split("\t")[0]: line.split("\t")[1] for line in lines[1:]}
    assert status["R1_M1"] == status["R1_M1_kd"] == "true" and set(status) == {"R1_M1", "R2_M2", "R1_M1_kd", "R2_M2_kd"}
    table = {t: spark.read.parquet(str(tmp_path / f"out/annotated/title={t}")) for t in ("R1_M1", "R1_M1_kd")}
    # each as if the motif and the tracks were alone
    run(spark, "accessibility", tmp_path / "flat/M1.tsv.gz", d / "native.tsv", d / "fixed.tsv", tmp_path / "acc", "--inner", 5, "--outer", 20)
    run(spark, "annotate", tmp_path / "acc", d / "exons", d / "r.bed", d / "tpm", d / "phast", d / "phylo", tmp_path / "ann")
    plain = lambda df: sorted(repr(tuple(r)) for r in df.select(*sorted(c for c in df.columns)).collect())
    assert plain(table["R1_M1"]) == plain(spark.read.parquet(str(tmp_path / "ann")))
    swapped = table["R1_M1_kd"].withColumns({"t_native": F.col("t_fixed"), "t_fixed": F.col("t_native")}).drop("s_l")
    assert plain(swapped) == plain(table["R1_M1"].drop("s_l")) and table["R1_M1"].count() > 0
    when = {f: f.stat().st_mtime for f in (tmp_path / "out/annotated").glob("title=*/part-*")}
    run(spark, "workflow", *argv, "--inner", 5, "--outer", 20)
    assert {f: f.stat().st_mtime for f in (tmp_path / "out/annotated").glob("title=*/part-*")} == when
    # a motif file that cannot be read takes no other with it
    (tmp_path / "flat/M3.tsv.gz").write_bytes(b"\x1f\x8bbroken")
    (tmp_path / "flat/M4.tsv.gz").write_bytes((tmp_path / "flat/M1.tsv.gz").read_bytes())
    (tmp_path / "names.tsv").write_text("Motif_ID\tRBP_Name\nM1\tR1\nM2\tR2\nM3\tR1\nM4\tR1\n")
    run(spark, "workflow", *argv, "--inner", 5, "--outer", 20)
    lines = next((tmp_path / "out/status").glob("part-*")).read_text().splitlines()
    status = {line.split("\t")[0]: line.split("\t")[1] for line in lines[1:]}
    assert status["R1_M3"] == "false" and status["R1_M4"] == status["R1_M1"] == "true"


def test_running_signal_of_a_stream(spark, tmp_path):
    from sitelark.streaming.incremental import running_signal

    schema = "ts timestamp, chrom string, strand string, at long, val double, depth long"
    spark.sql("SELECT * FROM VALUES (timestamp'2024-01-01 00:01:00', 'c', '+', 10L, 1.0D, 2L), (timestamp'2024-01-01 00:02:00', 'c', '+', 990L, 3.0D, 1L), (timestamp'2024-01-01 00:02:00', 'c', '+', 1500L, 5.0D, 1L)").toDF("ts", "chrom", "strand", "at", "val", "depth").write.parquet(str(tmp_path / "in"))
    q = running_signal(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("sums").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r["bin"]: (r["n"], r["sum_v"], r["sum_v2"], r["sum_w"], r["sum_vw"]) for r in spark.table("sums").collect()}
    assert got == {0: (2, 4.0, 10.0, 3, 5.0), 1: (1, 5.0, 25.0, 1, 5.0)}
