"""A training corpus from raw documents: quality filter, near-dedup, substring dedup, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and
returns a DataFrame; ``run`` writes it as Parquet and reads it again as the next
stage's documents. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkstrata.llm import packing, quality_knn, simhash_cover, substring_dedup
from sparkstrata.llm.common import materialize, unpacked
from sparkstrata.llm.queries import vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier takes for good, judged on whole texts.

    A null text is empty and stays one; rows without doc_id are judged too; all
    are kept if no label can be learned from. Equal texts share a decision.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    scored = quality_knn.quality_scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), others)
    kept = scored.where("predicted = 1")
    return kept.select("doc_id", "text", *unpacked(kept, others)).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest doc_id; rows without doc_id stay, as do repeats of a kept doc_id."""
    return simhash_cover.keep_one(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that documents with a smaller doc_id have too."""
    return substring_dedup.remove_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces with their place in sequences; a null or empty text has its end token alone."""
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("repeats", repeats), ("pack", pack)]

#: The classifier and the tokenizer can't be written in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
