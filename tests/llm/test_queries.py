import hashlib
import zlib

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tiktoken.load import load_tiktoken_bpe

from sitelark.llm.queries import ORACLES, QUERIES

from . import edge
from ..duck import connect, duck_rows, spark_rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name, tmp_path):
    df = QUERIES[name](spark, SF)
    assert spark_rows(df) == duck_rows(connect(SF, str(tmp_path)), ORACLES[name], df.columns)


def test_all_ten_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert all(sum(q.startswith(f"op{n}_") for q in names) == 1 for n in range(1, 11)) and "pipeline" in names


def test_toxicity_holds_rows_out(spark):
    rows = QUERIES["op7_toxicity"](spark, SF).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.5) for r in rows)


def test_pipeline_stages(spark):
    import corpus_pipeline as c

    from sitelark.llm.toxicity import fit_toxicity

    from .test_operators import brute_components, brute_hits, brute_lines, naive_score

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    steps, now = [], docs
    for name, stage in c.STAGES:
        now = c.written(stage(spark, now, SF), f"test-{name}")
        steps.append(now)
    pick = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    first = pick(steps[0])
    model = fit_toxicity(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    scores = {i: naive_score(model, t) for i, t in pick(docs).items()}
    assert all(s.schema == docs.schema for s in steps[:-1]) and set(first) <= set(scores)
    assert all(p < 0.5 + 1e-5 if i in first else p > 0.5 - 1e-5 for i, p in scores.items())
    lines = pick(steps[1])
    assert lines == {i: v[0] for i, v in brute_lines(list(first.items())).items()}
    kept = pick(steps[2])
    assert set(kept) == {i for i, v in brute_components(list(lines.items()), 80).items() if v[2]}
    clean = pick(steps[3])
    assert set(clean) == {i for i, t in kept.items() if brute_hits(t, bench)[1] == 0}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(public_tokenizers.path(c.RANKS)), special_tokens={})
    done = {r["doc_id"]: (r["n_tokens"], r["ids"], r["decoded_sha256"]) for r in steps[4].collect()}
    ids = {i: library.encode_ordinary(t) for i, t in clean.items()}
    assert done == {i: (len(ids[i]), ids[i], hashlib.sha256(t.encode()).hexdigest()) for i, t in clean.items()}
    assert {r["doc_id"]: (r["n_tokens"], r["ids"], r["decoded_sha256"]) for r in c.run(spark, SF).collect()} == done


@pytest.mark.parametrize("rows", ["nulls", "none"])
def test_pipeline_of_odd_rows(spark, tmp_path, rows):
    """Nulls, empty texts, repeated ids, columns that clash with those of the operators, and empty tables."""
    import corpus_pipeline as c

    docs = edge.with_nulls(spark) if rows == "nulls" else edge.empty(spark)
    for name in ("score", "ids", "kept", "rest", "component_id", "spans", "n_chars"):
        if name not in docs.columns:
            docs = docs.withColumn(name, F.lit(7))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        table = spark.read.parquet(f"{SF}/{name}.parquet")
        (table if rows == "nulls" else table.limit(0)).write.parquet(f"{tmp_path}/{name}.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = now.schema
    for name, stage in c.STAGES[:-1]:
        before, now = now, c.written(stage(spark, now, str(tmp_path)), f"odd-{name}")
        assert now.schema == columns and now.count() <= before.count()
    out = c.STAGES[-1][1](spark, now, str(tmp_path)).collect()
    kept = now.collect()
    assert bool(kept) == (rows == "nulls")
    assert sorted(r["decoded_sha256"] for r in out) == sorted(hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in kept)
