import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sitelark.operators import sequence as q
from sitelark.sources import text

W = np.log(np.array([[0.7, 0.1, 0.1, 0.1], [0.1, 0.6, 0.2, 0.1]]))


def codes(s: str) -> np.ndarray:
    return q.CODES[np.frombuffer(s.encode(), np.uint8)]


def brute(s: str, w: np.ndarray, m: int, n_out: int):
    """All windows from their definition, one centre at a time."""
    n, size = len(s), len(w)
    score, ok = [], []
    for i in range(n - size + 1):
        c = ["ACGT".find("T" if b == "U" else b) for b in s[i : i + size]]
        ok.append(min(c) >= 0)
        score.append(float(np.float32(sum(w[k][x] for k, x in enumerate(c)))) if min(c) >= 0 else 0.0)
    rows = []
    for i in range(n):
        h = min(i, n - 1 - m)
        inner = [k for k in range(max(h - m, 0), h + m - size + 2)]
        end = max(i - m - size, 0)
        left = list(range(max(end - (n_out - m - size + 1) + 1, 0), end + 1))
        h = min(i, n - 1 - n_out)
        right = list(range(h + m + 1, h + n_out - size + 2))
        mean = lambda ks: (sum(score[k] for k in ks) / sum(ok[k] for k in ks)) if sum(ok[k] for k in ks) else None
        gc = lambda a, b: (sum(x in "CG" for x in s[max(a, 0) : max(b, 0)]), len(s[max(a, 0) : max(b, 0)]))
        gi, go = gc(i - m, i + m + 1), [x + y for x, y in zip(gc(i - n_out, i - m), gc(i + m + 1, i + n_out + 1), strict=True)]
        rows.append((i + 1, mean(inner), mean(left + right), 100 * gi[0] / gi[1], 100 * go[0] / go[1] if go[1] else None, sum(ok[k] for k in inner)))
    return rows


def test_kmers_with_other_letters_are_invalid():
    _, valid = q.kmer_scores(codes("ACNGT"), W)
    assert np.flatnonzero(valid).tolist() == [0, 3]
    assert q.kmer_scores(codes("AU"), W)[1].all()  # U counts as T


def test_windows_at_the_edges():
    n, w = 12, np.eye(4)[[0, 0]]
    score = np.arange(11)
    x = q.scan_tile(codes("GCGCATATATGC"), 0, 0, n, n, w, 1, 3)
    assert [round(v, 4) for v in x["gc_inner_pct"][[0, 4, 11]]] == [100.0, 33.3333, 100.0]
    assert x["kmer_count_inner"].tolist() == [1] + [2] * 11
    assert len(score) == 11


@settings(max_examples=60, deadline=None)
@given(st.text("ACGTUN", min_size=41, max_size=70))
def test_windows_equal_brute_force(s):
    x = q.scan_tile(codes(s), 0, 0, len(s), len(s), W, 5, 20)
    for k, (pos, inner, outer, gi, go, count) in enumerate(brute(s, W, 5, 20)):
        assert x["pos1"][k] == pos and x["kmer_count_inner"][k] == count
        for name, want in (("inner_mean", inner), ("outer_mean", outer), ("gc_inner_pct", gi), ("gc_outer_pct", go)):
            assert (want is None and np.isnan(x[name][k])) or abs(x[name][k] - want) < 1e-9


def test_tile_size_and_strand_symmetry(spark):
    rng = np.random.default_rng(1)
    seq = "".join(rng.choice(list("ACGTN"), 300))
    seqs = spark.createDataFrame([("c1", 0, seq), ("short", 1, "ACGT")], "chrom string, contig_order long, seq string")
    rows = lambda t: sorted(map(str, q.scan_windows(seqs, W, 5, 20, tile=t).collect()))
    assert rows(1 << 20) == rows(37) == rows(1)
    back = {"A": "T", "C": "G", "G": "C", "T": "A", "N": "N"}
    flipped = spark.createDataFrame([("c1", 0, "".join(back[b] for b in reversed(seq)))], "chrom string, contig_order long, seq string")
    a = {(r["strand"], r["pos1"]): round(r["inner_mean"], 9) for r in q.scan_windows(seqs, W, 5, 20).collect()}
    b = {("-" if r["strand"] == "+" else "+", len(seq) + 1 - r["pos1"]): round(r["inner_mean"], 9) for r in q.scan_windows(flipped, W, 5, 20).collect()}
    assert a == b


def test_matrix_background_and_fasta(spark, tmp_path):
    logp = text.parse_pwm("Pos a c g u\n1 0.25 0.25 0.25 0.25\n")
    assert np.allclose(logp, -1.386294, atol=1e-5) and np.allclose(q.log_ratios(logp, [1, 1, 1, 1]), 0)
    for bad in ("Pos A C G U T\n1 1 1 1 1 1", "Pos A C G\n1 1 1 1"):
        with pytest.raises(ValueError):
            text.parse_pwm(bad)
    for bad in ("1 2 3", "1 2 3 0", "1 2 3 inf"):
        with pytest.raises(ValueError):
            text.parse_background(bad)
    (tmp_path / "a.fa").write_text("; junk\n>c1 first one\nacgt\nNN\n>c2\nGGG\n")
    seqs = text.read_fasta(spark, str(tmp_path / "a.fa"))
    assert [(r["chrom"], r["seq"]) for r in seqs.orderBy("contig_order").collect()] == [("c1", "ACGTNN"), ("c2", "GGG")]
    text.check_unique_contigs(seqs)
    with pytest.raises(ValueError):
        text.check_unique_contigs(seqs.union(seqs))


def test_only_wanted_windows_and_bounded_groups(monkeypatch, spark):
    """Columns that are not wanted are not worked out, the others stay as they are, and a batch of short contigs is unpacked group by group."""
    from sitelark.operators import sequence as module

    rng = np.random.default_rng(12)
    codes, i, w = rng.integers(0, 4, 300).astype(np.uint8), np.arange(300), rng.normal(size=(3, 4))
    every = module.scan_centres(codes, i, 0, 300, w, 5, 20)
    for wanted in (["kmer_count_inner"], ["outer_mean"], ["gc_outer_pct", "inner_mean"]):
        some = module.scan_centres(codes, i, 0, 300, w, 5, 20, wanted)
        assert set(wanted) <= set(some) < set(every) and all(np.array_equal(some[c], every[c], equal_nan=True) for c in some)
    seqs = spark.createDataFrame([(str(k), k, "".join(rng.choice(list("ACGTN"), 50 + k))) for k in range(40)], "chrom string, contig_order long, seq string")
    scanned = lambda: {(r["contig_order"], r["pos1"], r["strand"]): np.array(r[4:], float) for r in module.scan_windows(seqs, w, 5, 20).collect()}
    whole = scanned()
    monkeypatch.setattr(module, "GROUP", 120)
    parts = scanned()
    assert set(parts) == set(whole) and all(np.allclose(parts[k], whole[k], rtol=1e-12, atol=1e-12, equal_nan=True) for k in whole)


def test_weighted_sums_of_a_scan_are_those_of_its_rows(spark):
    """Sums by tile: the same as from a row a centre, for contigs of one and of many tiles, without contig_order, with letters that are no base; a row a tile and strand leaves the scan."""
    rng = random.Random(12)
    seqs = spark.createDataFrame([(str(k), None if k == 3 else k, "".join(rng.choices("ACGTN", (9, 3, 3, 9, k % 3), k=n))) for k, n in enumerate((700, 41, 40, 90, 300, 50, 1))] + [("x", 9, "N" * 80)], "chrom string, contig_order long, seq string")
    mix = {"a": ("inner_mean", 10_000.0), "b": ("outer_mean", 10_000.0), "c": ("kmer_count_inner", 1.0), "d": ("gc_outer_pct", 1000.0)}
    tiles = q.scan_windows(seqs, W, 5, 20, tile=64, weighted=mix).collect()
    assert len(tiles) <= 2 * (11 + 1 + 2 + 5 + 1)
    got, want = {}, {}
    for r in tiles:
        for c in mix:
            got[r["contig_order"], r["strand"], c] = got.get((r["contig_order"], r["strand"], c), 0) + r[c]
    for r in q.scan_windows(seqs, W, 5, 20, tile=64).collect():
        for name, (c, scale) in mix.items():
            v = 0.0 if r[c] is None or r[c] != r[c] else r[c] * scale
            want[r["contig_order"], r["strand"], name] = want.get((r["contig_order"], r["strand"], name), 0) + r["pos1"] * int(np.trunc(v) + (np.sign(v) if abs(v - np.trunc(v)) >= 0.5 else 0))
    assert got == want


def test_weighted_sums_beyond_64_bits_are_exact():
    assert q._weighted(np.array([1 << 40, 2]), np.array([1 << 30, 3]), 1.0, np.array([0])) == [(1 << 70) + 6]
    assert q._weighted(np.array([1, 1, 2, 3]), np.array([0.25, -0.25, 0.05, np.nan]), 10.0, np.array([0, 2])) == [0, 2]
