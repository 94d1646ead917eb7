"""The provided tables seen as a corpus: documents, tags and two snapshots, always in full."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions.text import ascii_key
from scriptorium.operators.tags import with_key
from scriptorium.plans.corpus import Corpus, read_corpus, write_assigned, write_corpus
from scriptorium.session import shared_dir
from scriptorium.sources.documents import documents_from_table, rows_from_table

EPOCH = 1_704_067_200
_BUILT: dict[tuple[str, str], tuple] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_ext() -> Column:
    return F.when(F.col("doc_id") % 2 == 0, "txt").otherwise("md")


def doc_path() -> Column:
    return F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), doc_ext())


def stamp(seconds: Column | int = 0) -> Column:
    return F.timestamp_seconds(F.lit(EPOCH) + seconds)


def corpus_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` as a file ``<source>/<doc_id>.<ext>``."""
    return documents_from_table(
        table(spark, sf_dir, "documents"), doc_path(), F.col("text"), stamp(F.col("doc_id")), stamp()
    )


def corpus_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same files, not yet read into documents."""
    rows = rows_from_table(table(spark, sf_dir, "documents"), doc_path(), F.col("text"), stamp(F.col("doc_id")))
    return rows.filter(F.col("body").isNotNull())


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    return docs.join(table(spark, sf_dir, "labels"), "doc_id", "left").withColumn("path", doc_path())


def tag_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Catalog: languages, label names and (never assigned) speaker roles. Assignments per document."""
    docs = table(spark, sf_dir, "documents")
    roles = table(spark, sf_dir, "conversations").select(F.initcap("role").alias("name"))
    labels = table(spark, sf_dir, "labels")
    named = labels.select(
        F.explode(
            F.array(
                F.when(F.col("quality") == 1, "Quality"), F.when(F.col("toxic") == 1, "Toxic")
            )
        ).alias("name")
    ).filter(F.col("name").isNotNull())
    names = docs.select(F.upper("lang").alias("name")).unionByName(roles).unionByName(named).distinct()
    tags = with_key(names).withColumn("created_at", stamp())
    rows = labelled(spark, sf_dir).select(
        "path",
        F.explode(
            F.array(
                ascii_key(F.col("lang")),
                F.when(F.col("quality") == 1, "quality"),
                F.when(F.col("toxic") == 1, "toxic"),
            )
        ).alias("name_key"),
    )
    return tags, rows.filter(F.col("name_key").isNotNull())


def indexed(spark: SparkSession, sf_dir: str) -> Corpus:
    """The corpus as an index on disk. Built on first use in a session, then only read."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _BUILT:
        root = f"{shared_dir(spark)}/index-{key[0]}-{len(_BUILT)}"
        shards, ranges = write_corpus(corpus_rows(spark, sf_dir), root)
        tags, assigned = tag_tables(spark, sf_dir)
        tags.write.mode("overwrite").parquet(f"{root}/tags")
        write_assigned(assigned, root, shards)
        _BUILT[key] = (root, shards, ranges)
    root, shards, ranges = _BUILT[key]
    return read_corpus(spark, root, spark.read.parquet(f"{root}/tags"), shards, ranges)


def stored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The earlier state: every document that is not labelled toxic."""
    toxic = labelled(spark, sf_dir).filter(F.col("toxic") == 1).select("path")
    return corpus_view(spark, sf_dir).join(toxic, "path", "left_anti")


def listed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The present state with bodies: low-quality documents are gone, Spanish ones have grown a line.

    :func:`snapshot` marks the documents of one source as unreadable, so that this outcome occurs too.
    """
    docs = table(spark, sf_dir, "documents").join(
        table(spark, sf_dir, "labels").filter(F.col("quality") == 0).select("doc_id"),
        "doc_id",
        "left_anti",
    )
    grown = F.when(F.col("lang") == "es", F.concat("text", F.lit("\n"), "lang")).otherwise(F.col("text"))
    return documents_from_table(docs, doc_path(), grown, stamp(F.col("doc_id")), stamp(F.lit(1)))


def snapshot(listed: DataFrame, size_factor: int = 1) -> DataFrame:
    return listed.select(
        "path",
        (F.col("size") * size_factor).alias("size"),
        "mtime",
        "ext",
        F.lit(None).cast("string").alias("warning"),
        (F.col("folder") != "src7").alias("readable"),
    )
