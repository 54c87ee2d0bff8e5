"""A corpus pipeline: quality rules, line dedup, near-dedup, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept, which is written
as Parquet and read again in between. The first four return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillguard.llm import decontaminate, linededup, quality
from quillguard.llm.minhash import NearDup, near_duplicates
from quillguard.llm.packing import pack
from quillguard.llm.queries import TOKENIZER
from quillguard.llm.scratch import Scratch

#: Near-duplicate stages take shingles of five words.
NEAR = NearDup(shingle=5)


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars of the texts as they are now."""
    return docs.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; of the others, lines that many documents of their source share."""
    return _counted(quality.clean(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has go; a document that has nothing else goes with them."""
    return _counted(linededup.clean(docs)).where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of the smallest id stays."""
    kept = near_duplicates(docs, params=NEAR).where("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.join(kept.hint("merge"), docs.doc_id.eqNullSafe(kept.kept_id), "left_semi")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark contaminates go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents, their token ids and their places in sequences."""
    return pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: SQL can't express packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pipeline over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    s = Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = s.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
