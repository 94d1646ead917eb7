"""From raw documents to a training mix.

``STAGES`` are (name, function) pairs; a function takes (spark, docs, sf_dir), where ``docs`` is what the stage before
kept, and returns a DataFrame. Every stage but the last returns the columns of ``documents``; the last adds
``repeats``, how often the mix takes a document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scriptorium.llm import decontaminate, groupjoin, langid, mixing, pii
from scriptorium.llm.base import read, saved


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled part of them teaches; texts without one go."""
    return langid.keep_identified(docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near duplicates."""
    return groupjoin.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut; documents that are mostly benchmark text go."""
    return decontaminate.remove(docs, read(spark, sf_dir, "benchmark"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; every document stays."""
    return pii.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the mix takes, with ``repeats``."""
    return mixing.mix(docs)


STAGES = [
    ("language", identified),
    ("near_duplicates", distinct),
    ("decontamination", decontaminated),
    ("personal_data", redacted),
    ("mixing", mixed),
]

#: Learned models, hashes of the sampling order and cuts by words are beyond SQL; tests hold a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
