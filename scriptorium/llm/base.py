"""What the corpus operators share: table reads, tables cut from their lineage, word rules."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.session import shared_dir

#: White space of the word rules: blank, tab to carriage return.
BLANKS = r"\x20\x09-\x0D"
WORD = rf"[^{BLANKS}]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def folder(spark: SparkSession, label: str) -> str:
    """A new folder that driver and executors share, below ``spark.checkpoint.dir``."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


#: Spark's own switch for dropping a query's shuffle files as soon as it has ended.
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def saved(frame: DataFrame, label: str) -> DataFrame:
    """``frame`` written to a shared folder and read again: later plans start here, also after lost executors.

    The shuffle files behind it have no further use and are dropped at once.
    """
    spark = frame.sparkSession
    path = folder(spark, label)
    before = spark.conf.get(_DROP_SHUFFLES, "false")
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        frame.write.parquet(path)
    finally:
        spark.conf.set(_DROP_SHUFFLES, before)
    return spark.read.schema(frame.schema).parquet(path)


#: Bounds of what a task hands to Python at once: by default it is 10,000 rows, however long their texts are, held on both
#: sides.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 * 1024**2}


@contextmanager
def small_batches(spark: SparkSession):
    """Small batches between Spark and Python in the jobs that run inside the block."""
    before = {name: spark.conf.get(name) for name in BATCHES}
    for name, value in BATCHES.items():
        spark.conf.set(name, str(value))
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def row_key() -> Column:
    """128 bits that stand for a row's ``doc_id`` and ``text``, as two longs; only copies of a row share them."""
    return F.struct(F.xxhash64("doc_id", "text").alias("a"), F.xxhash64(F.lit(1), "doc_id", "text").alias("b"))


def word_count(text: Column) -> Column:
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def once(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated one time per row, however often the body uses it."""
    return F.transform(F.array(value), body)[0]
