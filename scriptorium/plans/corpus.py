"""The tables a search reads, and how they are laid out on disk."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.operators.postings import (
    corpus_stats,
    path_shard,
    posting_blocks,
    postings,
    shard_column,
    term_counts,
    unpacked,
)
from scriptorium.plans import segments
from scriptorium.plans.ordered import Ranges, write_ordered
from scriptorium.sources.documents import build_documents

# One directory per this many bytes of text, and at least so many directories.
BYTES_PER_SHARD = 2 * 1024**3
MIN_SHARDS = 8
# Bounds of a task's share in a write, and shares per core. A task sorts its share, some ten times as large, in memory.
MIN_FILE, MAX_FILE = 1 * 1024**2, 64 * 1024**2
SHARES_PER_CORE = 2
# What a task reads while an index is written; tokenising makes several times as much of it.
MAX_READ = 32 * 1024**2


@dataclass(frozen=True)
class Corpus:
    documents: DataFrame
    postings: DataFrame
    stats: DataFrame
    tags: DataFrame
    document_tags: DataFrame
    terms: DataFrame
    shards: int | None = None
    #: Tag bitmaps over (segment, ord); without them tags are looked up by path.
    bits: DataFrame | None = None
    #: All document rows on disk, dead ones included, for hits that are known to be live.
    stored: DataFrame | None = None
    #: Where the ranges of the vocabulary begin, for each of its parts.
    term_ranges: dict[str, Ranges] | None = None
    #: The live rows ``path, ext, segment, ord`` of a subtree, read from its ranges alone.
    beneath: Callable[[str], DataFrame] | None = None


def empty_tags(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return (
        spark.createDataFrame([], "name string, name_key string, created_at timestamp"),
        spark.createDataFrame([], "path string, name_key string"),
    )


def in_memory(
    documents: DataFrame, tags: DataFrame | None = None, document_tags: DataFrame | None = None
) -> Corpus:
    """A corpus that is tokenised as part of each query, for tables that are searched once."""
    no_tags, no_assignments = empty_tags(documents.sparkSession)
    post = postings(documents)
    return Corpus(
        documents,
        post,
        corpus_stats(documents),
        no_tags if tags is None else tags,
        no_assignments if document_tags is None else document_tags,
        term_counts(post),
    )


def listed_bytes(listing: DataFrame) -> int:
    return listing.agg(F.sum("size").alias("b")).first()["b"] or 0


def shard_count(total: int) -> int:
    return max(MIN_SHARDS, -(-total // BYTES_PER_SHARD))


@contextmanager
def settings(spark: SparkSession, values: dict[str, object]):
    """Session settings that hold inside the block."""
    before = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, str(value))
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


@contextmanager
def file_size(spark: SparkSession, total: int):
    """Size that adaptive execution aims at for each written file: a few per core, within bounds."""
    share = total // (SHARES_PER_CORE * spark.sparkContext.defaultParallelism)
    sizes = {
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": max(MIN_FILE, min(MAX_FILE, share)),
        "spark.sql.files.maxPartitionBytes": MAX_READ,
    }
    with settings(spark, sizes):
        yield


def write_documents(documents: DataFrame, path: str, shards: int, segment: int = 1) -> None:
    """Partitioned by extension and by a hash of the path, sorted by path inside each file.

    Rows that are not built yet (path, size, mtime, ext, body) are built behind the shuffle, where they are spread. The
    rebalance lets adaptive execution split directories that are too large for one task. Rows without a place get
    their segment and a number in it.
    """
    shard = path_shard(F.col("path"), shards)
    placed = documents.withColumn("shard", shard).hint("rebalance", "ext", "shard")
    if "dl" not in placed.columns:
        placed = build_documents(placed).withColumn("shard", shard)
    placed = placed.sortWithinPartitions("ext", "shard", "path")
    if "ord" not in placed.columns:
        placed = placed.withColumns({"segment": F.lit(segment), "ord": F.monotonically_increasing_id()})
    placed.write.mode("overwrite").partitionBy("ext", "shard").parquet(path)


def write_postings(post: DataFrame, path: str, shards: int) -> None:
    """Partitioned by the first characters of the term, sorted by term: a term reads a few pages.

    A directory that many terms share, or one that a single very common term fills, is split by
    adaptive execution into as many sorted files as its size asks for. A task keeps a file open for each of its
    directories: sorted by the term first, rows compare by its first bytes. Blocks (see
    :func:`scriptorium.operators.postings.posting_blocks`) are unpacked behind the sort.
    """
    if "shard" not in post.columns:
        post = post.withColumn("shard", shard_column(F.col("term"), shards))
    placed = post.hint("rebalance", "shard")
    if "rows" in post.columns:
        placed = unpacked(placed.sortWithinPartitions("term", F.col("rows")[0]["path"]))
    else:
        placed = placed.sortWithinPartitions("term", "path", "field")
    with settings(post.sparkSession, {"spark.sql.maxConcurrentOutputFileWriters": shards}):
        placed.write.mode("overwrite").partitionBy("shard").parquet(path)


def write_terms(post: DataFrame, path: str) -> Ranges:
    """The vocabulary in term order, so that a word is looked up in one range."""
    return write_ordered(term_counts(post), "term", path)


def write_corpus(documents: DataFrame, root: str, shards: int | None = None) -> tuple[int, Ranges]:
    """Write documents, postings and statistics below ``root`` as one part; returns the shard count used and where the
    ranges of the vocabulary begin."""
    spark = documents.sparkSession
    total = listed_bytes(documents)
    count = shards or shard_count(total)
    places = {n: f"{root}/{n}/part=0" for n in ("documents", "postings", "stats", "terms")}
    with file_size(spark, total):
        write_documents(documents, places["documents"], count)
        stored = segments.read(spark, "documents", [places["documents"]])
        write_postings(posting_blocks(stored), places["postings"], count)
    corpus_stats(stored).coalesce(1).write.mode("overwrite").parquet(places["stats"])
    return count, write_terms(segments.read(spark, "postings", [places["postings"]]), places["terms"])


def write_assigned(assigned: DataFrame, root: str, shards: int) -> None:
    """Tag assignments of a corpus that :func:`write_corpus` has written, by path and as bitmaps."""
    spark = assigned.sparkSession
    segments.write_assignments(assigned.withColumn("seq", F.lit(1)), f"{root}/assigned/part=0", shards)
    stored = segments.read(spark, "documents", [f"{root}/documents/part=0"])
    places = assigned.join(stored.select("path", "segment", "ord"), "path")
    segments.write_bits(segments.bitmap_rows(places, 1), f"{root}/bits/part=0")


def read_corpus(spark: SparkSession, root: str, tags: DataFrame, shards: int, ranges: Ranges) -> Corpus:
    """What :func:`write_corpus` and :func:`write_assigned` have written."""

    def part(name: str) -> DataFrame:
        return segments.read(spark, name, [f"{root}/{name}/part=0"])

    return Corpus(
        part("documents"),
        part("postings"),
        part("stats"),
        tags,
        part("assigned"),
        part("terms"),
        shards,
        part("bits"),
        term_ranges={"0": ranges},
    )
