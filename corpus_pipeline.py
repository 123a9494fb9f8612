"""A training corpus from raw documents: the stages, in order, and run(), which applies them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm import mixing, near_copies, pieces, quality_model, quality_rules
from colloquy.llm._common import cut
from colloquy.llm.queries import vocabulary


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: documents that they reject go."""
    names = docs.columns
    judged = quality_rules.assess(docs)
    return judged.where(F.col(judged.columns[-1])).select(*[F.col(f"`{c}`") for c in names])


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents that it rejects go."""
    names = docs.columns
    judged = quality_model.classify(docs)
    return judged.where(F.col(judged.columns[-1])).select(*[F.col(f"`{c}`") for c in names])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup: one document of each group stays."""
    return near_copies.first_of_each(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing sources to target weights: each document as often as the mix takes it."""
    return mixing.apply(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece encoding; decoding the ids gives the text again."""
    return pieces.encode(docs, vocabulary("piece_bpe_32k.model"), [c for c in docs.columns if c != "text"])


STAGES = [("quality_rules", rules), ("quality_classifier", classifier), ("near_dedup", near_dedup), ("mixing", mixture), ("sentencepiece", encoding)]

#: The verdicts of learned and sketched stages can't be written in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
