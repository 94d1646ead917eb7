"""Assemble document rows from any frame that carries a path and a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.decode import MAX_FILE_BYTES
from scriptorium.functions.headers import title_of, url_of
from scriptorium.functions.names import base_name, extension, folder_of, is_hidden, stem_of
from scriptorium.functions.text import FIELDS, token_count, unify_newlines

SPLIT_BYTES = 128 * 1024**2


def build_documents(rows: DataFrame, indexed_at: Column | None = None) -> DataFrame:
    """``path, size, mtime, ext, body`` in, full document rows out. One projection, no shuffle."""
    named = rows.select("*", stem_of(base_name(F.col("path")), F.col("ext")).alias("stem"))
    titled = named.select(
        "path",
        "size",
        "mtime",
        "ext",
        title_of(F.col("body"), F.col("ext"), F.col("stem")).alias("title"),
        folder_of(F.col("path")).alias("folder"),
        "stem",
        url_of(F.col("body"), F.col("ext")).alias("url"),
        "body",
        (F.current_timestamp() if indexed_at is None else indexed_at).alias("indexed_at"),
        *[c for c in ("digest",) if c in rows.columns],
    )
    length = sum((token_count(F.col(f)) for f in FIELDS[1:]), token_count(F.col(FIELDS[0])))
    return titled.withColumn("dl", length.cast("bigint"))


def spread(rows: DataFrame, key: Column) -> DataFrame:
    """Deal rows out to a task per core, and to more where their bytes ask for it.

    For plans that build documents without writing them: a table in one row group is read by one task.
    """
    spark = rows.sparkSession
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return rows.repartition(max(spark.sparkContext.defaultParallelism, size // SPLIT_BYTES), key)


def rows_from_table(table: DataFrame, path: Column, text: Column, mtime: Column) -> DataFrame:
    """Each table row as one file: ``path, size, mtime, ext, body, digest``. Paths that are not indexable are left out.

    Texts above the size guard have their size and no body.
    """
    size = F.octet_length(text).cast("bigint")
    small = F.coalesce(size <= MAX_FILE_BYTES, F.lit(True))
    rows = table.select(
        path.alias("path"),
        F.coalesce(size, F.lit(0).cast("bigint")).alias("size"),
        mtime.cast("timestamp").alias("mtime"),
        extension(base_name(path)).alias("ext"),
        F.when(small, unify_newlines(F.coalesce(text, F.lit("")))).alias("body"),
        F.md5(F.coalesce(text, F.lit("")).cast("binary")).alias("digest"),
    )
    return rows.filter(F.col("path").isNotNull() & F.col("ext").isNotNull() & ~is_hidden(F.col("path")))


# Fixed value: the message for rows of a table that name the same file.
REPEATED = "ValueError: repeated path"


def listing_of(rows: DataFrame) -> DataFrame:
    """The listing of :func:`rows_from_table`: one row per path. A path of several rows has a message."""
    one = rows.groupBy("path").agg(
        *[F.max(c).alias(c) for c in ("size", "mtime", "ext", "digest")], F.count("*").alias("_n")
    )
    return one.select(
        "path",
        "size",
        "mtime",
        "ext",
        F.lit(None).cast("string").alias("warning"),
        F.lit(True).alias("readable"),
        "digest",
        F.when(F.col("_n") > 1, REPEATED).alias("message"),
    )


def documents_from_table(
    table: DataFrame,
    path: Column,
    text: Column,
    mtime: Column,
    indexed_at: Column | None = None,
) -> DataFrame:
    """Document rows of a table whose rows are taken as files. An index reports texts above the size guard; here they
    are left out.

    Rows are dealt out once they have their path and size: a plan that needs no more of a document moves no text, and a
    join on the path that follows finds its rows in place.
    """
    rows = rows_from_table(table, path, text, mtime).filter(F.col("body").isNotNull()).drop("digest")
    return build_documents(spread(rows, F.col("path")), indexed_at)
