"""Immutable parts of an index, and the small tables that say which of their rows still count.

A change of the corpus writes one new part (documents and postings of the changed files), never touches an older one, and
appends to four logs:

* tombstones ``(path, before)``: rows of ``path`` that came in with a segment below ``before`` are dead;
* terms (in order, see :mod:`scriptorium.plans.ordered`, as are paths) and statistics with a sign: counts of the new rows, less those of the rows that died;
* assignments and their removals, each with the sequence number of the change;
* tag bitmaps: one 64-bit word per tag and 64 neighbouring documents, set or cleared by a change.

A row keeps its ``segment`` (number of the change it came in with) and ``ord`` (place in that segment) for life, also when
compaction moves it to another part. Bitmaps and tombstones therefore stay valid across compactions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions.bitmaps import NONE, bit_of, changed, constant, word_of
from scriptorium.functions.text import FIELDS
from scriptorium.operators.postings import path_shard, term_counts

COUNTS = ("n", "n_docs", *(f"n_{f}" for f in FIELDS))
#: Tables of an index and their columns; directories below ``part=`` are the partition columns.
SCHEMAS = {
    "documents": "path string, size bigint, mtime timestamp, title string, folder string, stem string, url string, "
    "body string, indexed_at timestamp, dl bigint, digest string, segment int, ord bigint, part string, ext string, shard int",
    "postings": "term string, path string, ext string, field string, dl bigint, lead boolean, positions array<int>, "
    "segment int, ord bigint, part string, shard int",
    "paths": "key string, path string, ext string, segment int, ord bigint, part string, range int",
    "tombstones": "path string, before int, part string",
    "terms": "term string, " + ", ".join(f"{c} bigint" for c in COUNTS) + ", part string, range int",
    "stats": "n_docs bigint, n_tokens bigint, part string",
    "assigned": "path string, name_key string, seq int, part string, shard int",
    "unassigned": "path string, name_key string, seq int, part string, shard int",
    "dropped": "name_key string, seq int, part string",
    "bits": "name_key string, segment int, word bigint, bits bigint, added boolean, seq int, part string",
}


def read(spark: SparkSession, name: str, paths: list[str]) -> DataFrame:
    """The named parts of a table as one frame."""
    if not paths:
        return spark.createDataFrame([], SCHEMAS[name])
    base = paths[0].rsplit("/part=", 1)[0]
    return spark.read.schema(SCHEMAS[name]).option("basePath", base).parquet(*paths)


def live(rows: DataFrame, tombstones: DataFrame | None) -> DataFrame:
    """Rows that no tombstone covers. The join is on the path alone, as is the grouping that a search does next."""
    if tombstones is None:
        return rows
    dead = tombstones.select(F.col("path").alias("_dead"), F.col("before").alias("_before"))
    covers = (F.col("path") == F.col("_dead")) & (F.col("segment") < F.col("_before"))
    return rows.join(dead, covers, "left_anti")


def path_keys(documents: DataFrame) -> DataFrame:
    """Documents by their path in lower case, for subtrees and for paths in another spelling."""
    return documents.select(F.lower("path").alias("key"), "path", "ext", "segment", "ord")


def signed_terms(added: DataFrame | None, removed: DataFrame | None) -> DataFrame:
    """Counts of added postings less those of removed ones; terms that keep their counts are left out."""
    signed = [
        term_counts(post).select("term", *[(F.col(c) * sign).alias(c) for c in COUNTS])
        for post, sign in ((added, 1), (removed, -1))
        if post is not None
    ]
    if len(signed) == 1:
        return signed[0]
    return summed_terms(signed[0].unionByName(signed[1]))


def summed_terms(terms: DataFrame) -> DataFrame:
    """One row per term of a log of signed counts; terms that are gone have none."""
    total = terms.groupBy("term").agg(*[F.sum(c).alias(c) for c in COUNTS])
    return total.filter(reduce(Column.__or__, [F.col(c) != 0 for c in COUNTS]))


def summed_stats(stats: DataFrame) -> DataFrame:
    return stats.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n_docs"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens"))


def live_assignments(assigned: DataFrame, unassigned: DataFrame | None, dropped: DataFrame | None) -> DataFrame:
    """Assignments without a later removal, of their own or of their tag. An assignment is logged only where there was none."""
    if unassigned is not None:
        gone = unassigned.select(F.col("path").alias("_p"), F.col("name_key").alias("_k"), F.col("seq").alias("_s"))
        later = (F.col("path") == F.col("_p")) & (F.col("name_key") == F.col("_k")) & (F.col("seq") < F.col("_s"))
        assigned = assigned.join(gone, later, "left_anti")
    return not_dropped(assigned, dropped)


def not_dropped(rows: DataFrame, dropped: DataFrame | None) -> DataFrame:
    """Rows of tags that were not deleted after them."""
    if dropped is None:
        return rows
    gone = dropped.select(F.col("name_key").alias("_k"), F.col("seq").alias("_s"))
    return rows.join(gone, (F.col("name_key") == F.col("_k")) & (F.col("seq") < F.col("_s")), "left_anti")


def bitmap_rows(places: DataFrame, seq: int, added: bool = True) -> DataFrame:
    """``name_key, segment, ord`` as words of bitmaps."""
    words = places.groupBy("name_key", "segment", word_of(F.col("ord")).alias("word")).agg(F.bit_or(bit_of(F.col("ord"))).alias("bits"))
    return words.select("name_key", "segment", "word", "bits", F.lit(added).alias("added"), F.lit(seq).alias("seq"))


def folded_bits(bits: DataFrame, seq: int) -> DataFrame:
    """A log of bitmap words brought down to one set word each; empty words go."""
    log = bits.groupBy("name_key", "segment", "word").agg(F.sort_array(F.collect_list(F.struct("seq", "added", "bits"))).alias("log"))
    word = F.aggregate("log", constant(NONE), changed)
    folded = log.select("name_key", "segment", "word", word.alias("bits"), F.lit(True).alias("added"), F.lit(seq).alias("seq"))
    return folded.filter(F.col("bits") != 0)


def write_assignments(rows: DataFrame, path: str, shards: int) -> None:
    """By path, as hits and single documents ask for them; searches by tag read the bitmaps."""
    placed = rows.select("path", "name_key", "seq", path_shard(F.col("path"), shards).alias("shard"))
    placed.hint("rebalance", "shard").sortWithinPartitions("shard", "path", "name_key").write.partitionBy("shard").parquet(path)


def write_bits(rows: DataFrame, path: str) -> None:
    """In order of the tag, so that a predicate reads the row groups of its tags. A common tag covers many files."""
    rows.repartitionByRange("name_key", "segment", "word").sortWithinPartitions("name_key", "segment", "word").write.parquet(path)
