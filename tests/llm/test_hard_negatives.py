import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitelark.llm.hard_negatives import hard_negatives, product

SCHEMA = "vec_id long, embedding array<float>, label int, score long, rid int, g string"


def brute(rows, positives=5, negatives=3, low=50, high=95):
    live = [(i, [math.floor(256 * float(np.float32(x))) for x in v], lab) for i, v, lab in rows if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (aid, av, al) in enumerate(live):
        if aid % 50:
            continue
        scored = [(-sum(x * y for x, y in zip(av, v)), i, lab) for b, (i, v, lab) in enumerate(live) if b != a]
        for p, pid, _ in sorted(x for x in scored if x[2] == al)[:positives]:
            hits = sorted((s, i) for s, i, lab in scored if lab != al and low * -p <= 100 * -s <= high * -p)[:negatives]
            out += [(aid, pid, rank, nid, -p, -s) for rank, (s, nid) in enumerate(hits, 1)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(i, v, lab, 1, 2, "x") for i, v, lab in rows], SCHEMA)


def mined(spark, rows, **how):
    out = hard_negatives(table(spark, rows), F.col("vec_id") % 50 == 0, **how)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, out.collect()))


def vectors(seed, n, size, labels=4):
    """Vectors around a few centres, so that windows hold rows."""
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(size)] for _ in range(3)]
    return [(i, [c + rng.gauss(0, 0.4) for c in rng.choice(centres)], rng.randrange(labels)) for i in range(n)]


@pytest.mark.parametrize(("chunk", "anchor_rows", "block_rows"), [(4, 2, 7), (3, 1, 1000), (64, 100, 5), (1, 3, 40)])
def test_equals_brute_force_for_any_blocks(spark, chunk, anchor_rows, block_rows):
    rows = vectors(1, 260, 10)
    want = brute(rows)
    assert len(want) > 20 and mined(spark, rows, chunk=chunk, anchor_rows=anchor_rows, block_rows=block_rows) == want


def test_production_blocks_on_a_hot_label(spark):
    rng = random.Random(5)
    rows = [(i, v, 1 if rng.random() < 0.6 else lab) for i, v, lab in vectors(2, 3000, 40, 12)]
    assert mined(spark, rows) == brute(rows)


def test_nulls_ties_repeats_and_odd_vectors(spark):
    rows = vectors(3, 120, 5, 2)
    rows += [(50, None, 1), (100, [1.0, None, 1.0, 1.0, 1.0], 1), (150, [float("nan")] * 5, 0), (200, [float("inf")] * 5, 0), (None, [1.0] * 5, 1), (250, [1.0] * 5, None)]
    rows += [(300, [], 1), (301, [], 0), (350, [1.0, 2.0], 0), (400, [0.0] * 5, 1), (450, [2.0] * 9, 1)]
    rows += [(500, [0.5] * 5, 0)] * 3 + [(k, [0.25, 0.25, 0.25, 0.5, 0.5], k % 2) for k in range(501, 560)]  # repeated rows, and ties
    assert mined(spark, rows, chunk=2, anchor_rows=3, block_rows=16) == brute(rows)


def test_fewer_rows_than_asked_for(spark):
    rows = [(0, [1.0, 1.0], 0), (1, [1.0, 0.5], 0), (2, [1.0, 0.25], 1), (3, [0.5, 0.25], 2)]
    assert mined(spark, rows) == brute(rows) and len(brute(rows)) == 2
    assert mined(spark, rows[:1]) == [] and mined(spark, []) == [] and mined(spark, rows[1:]) == []


def test_a_product_is_exact_in_either_form():
    rng = np.random.default_rng(0)
    for most in (300, 1 << 20, 1 << 29):
        a, b = rng.integers(-most, most, (7, 5)), rng.integers(-most, most, (9, 5))
        assert product(a, b).tolist() == [[sum(int(x) * int(y) for x, y in zip(r, s)) for s in b] for r in a]


def test_no_score_is_shuffled(spark, monkeypatch):
    """Tiles are added up and cut down to their best where they are made, so only one step takes blocks to what it returns."""
    from sitelark.llm import hard_negatives as module

    made, tiles = [], module._tiles

    def kept(*a):
        out = tiles(*a)
        made.append((out.columns, out.count()))
        return out

    monkeypatch.setattr(module, "_tiles", kept)
    rows = vectors(4, 400, 12)
    assert mined(spark, rows, chunk=5) == brute(rows)
    assert [columns for columns, _ in made] == [["arid", "vec_id", "score"], ["arid", "p", "vec_id", "score"]]
    assert made[0][1] <= 8 * 5  # each of the 8 anchors gives at most five rows of its one tile, not one a row of the table
