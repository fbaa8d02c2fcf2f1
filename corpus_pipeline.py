"""The corpus pipeline: five stages over documents, each written as Parquet and reread as the next one's input.

toxicity -> line dedup -> near-duplicates -> benchmark decontamination -> byte-level BPE. All but the last return the columns of
documents; n_chars follows a changed text. Documents with a null doc_id pass the stages that drop whole documents by id.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelark.llm.bpe import encode_verified
from sitelark.llm.decontaminate import decontaminate
from sitelark.llm.line_dedup import line_dedup
from sitelark.llm.near_dedup import near_duplicates
from sitelark.llm.shared import written
from sitelark.llm.toxicity import fit_toxicity, score_toxicity

RANKS = "byte_bpe_multi_50k.tiktoken"


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go."""
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs, model, "toxicity_score").where("toxicity_score < 0.5").drop("toxicity_score")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines stay in the largest doc_id that holds them; a document keeps its row even if no line stays."""
    out = line_dedup(docs, carry=True)
    values = {c: F.col(f"rest.{c}") for c in docs.columns if c not in ("doc_id", "text")}
    values |= {"doc_id": F.col("doc_id"), "text": F.col("text")}
    if "n_chars" in values:
        values["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return out.select(*(values[c].alias(c) for c in docs.columns))


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five words, 0.8) the smallest doc_id stays."""
    gone = near_duplicates(docs.select("doc_id", "text"), percent=80, k=5).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    hits = decontaminate(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    gone = written(hits.where(F.size("spans") > 0).select("doc_id").distinct(), "contaminated")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the sha256 of the bytes that the ids decode to."""
    return encode_verified(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


STAGES = [("toxicity", toxicity), ("line_dedup", dedup_lines), ("near_dedup", dedup_near), ("decontaminate", decontaminated), ("byte_bpe", tokenized)]

#: The first stage is a trained model, which SQL cannot express; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
