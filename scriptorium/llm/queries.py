"""Registered queries of the corpus operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from scriptorium.llm import (
    decontaminate,
    groupjoin,
    html,
    langid,
    middle,
    mixing,
    omh,
    pii,
    tokens,
    toxicity,
    urls,
    vectors,
    warc,
)
from scriptorium.llm.base import read


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.report(read(spark, sf_dir, "documents"))


def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return omh.report(read(spark, sf_dir, "documents"))


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(read(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.report(read(spark, sf_dir, "pages"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.report(read(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.report(read(spark, sf_dir, "pages"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.report(spark, read(spark, sf_dir, "pages"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groupjoin.report(read(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(read(spark, sf_dir, "documents"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return middle.report(read(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.report(read(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_counts,
        op2_order_minhash,
        op3_personal_data,
        op4_decontaminate,
        op5_html_text,
        op6_language,
        op7_url_filter,
        op8_warc,
        op9_jaccard_join,
        op10_mixing,
        op11_toxicity,
        op12_fill_in_middle,
        op13_vector_codes,
    )
} | {"pipeline": corpus_pipeline.run}
SQL: dict[str, str] = {
    "op4_decontaminate": decontaminate.SQL,
    "op8_warc": warc.SQL,
    "op9_jaccard_join": groupjoin.SQL,
    "op10_mixing": mixing.SQL,
    "op12_fill_in_middle": middle.SQL,
    "op13_vector_codes": vectors.SQL,
}
