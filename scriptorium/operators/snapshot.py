"""Compare a listing of files with the stored documents and carry the result over."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.decode import MAX_FILE_BYTES

# Fixed value: how many changes or errors are shown.
SHOWN = 20


def diff(snapshot: DataFrame, stored: DataFrame, full: bool = False) -> DataFrame:
    """``path, ext, status`` for every listed or stored path.

    ``unchanged`` (same size and time, or same size and digest where the listing has digests), ``upsert``, ``error``
    (too large, or listed with a message; a stored row stays), ``kept`` and ``never_indexed`` (listed but not readable),
    ``pruned`` (no longer listed). ``full`` ignores the fingerprints.
    """

    def column(frame: DataFrame, name: str) -> Column:
        return F.col(name) if name in frame.columns else F.lit(None).cast("string")

    new = snapshot.select(
        "path",
        "ext",
        "size",
        "mtime",
        "readable",
        column(snapshot, "digest").alias("digest"),
        column(snapshot, "message").alias("_message"),
        F.lit(True).alias("_listed"),
    )
    old = stored.select(
        "path",
        F.col("size").alias("_size"),
        F.col("mtime").alias("_mtime"),
        column(stored, "digest").alias("_digest"),
        F.lit(True).alias("_stored"),
    )
    both = new.join(old, "path", "full_outer")
    known = F.col("_stored").isNotNull()
    by_time = F.col("mtime") == F.col("_mtime")
    alike = F.when(F.col("digest").isNull(), by_time).otherwise(F.col("digest").eqNullSafe(F.col("_digest")))
    same = known & (F.col("size") == F.col("_size")) & alike
    status = F.when(F.col("_listed").isNull(), "pruned").when(
        ~F.col("readable"), F.when(known, "kept").otherwise("never_indexed")
    )
    if not full:
        status = status.when(same, "unchanged")
    failed = (F.col("size") > MAX_FILE_BYTES) | F.col("_message").isNotNull()
    status = status.when(failed, "error").otherwise("upsert")
    return both.select("path", "ext", status.alias("status"))


def with_status(changes: DataFrame, *status: str) -> DataFrame:
    return changes.filter(F.col("status").isin(*status)).select("path")


def with_failures(changes: DataFrame, failed: DataFrame) -> DataFrame:
    """Files that could not be read count as errors; their stored rows stay."""
    lost = failed.select("path", F.lit(True).alias("_failed"))
    status = F.when(F.col("_failed").isNotNull(), "error").otherwise(F.col("status"))
    return changes.join(lost, "path", "left").select("path", "ext", status.alias("status"))


def run_stats(changes: DataFrame) -> DataFrame:
    """All counters of a run in one pass."""

    def n(test: Column, name: str) -> Column:
        return F.count_if(test).alias(name)

    status = F.col("status")
    listed = status != "pruned"
    return changes.agg(
        n(listed, "walked"),
        n(listed & (F.col("ext") == "txt"), "txt"),
        n(listed & (F.col("ext") == "md"), "md"),
        n(status == "unchanged", "unchanged"),
        n(status == "upsert", "upserted"),
        n(status == "pruned", "pruned"),
        n(status.isin("kept", "never_indexed"), "unreadable"),
        n(status == "kept", "kept"),
        n(status == "never_indexed", "never_indexed"),
        n(status == "error", "errors"),
    )


def change_list(changes: DataFrame, shown: int = SHOWN) -> DataFrame:
    """The first changes a run would make: upserts, then prunes, each in path order."""
    kind = F.when(F.col("status") == "upsert", 0).otherwise(1)
    planned = changes.filter(F.col("status").isin("upsert", "pruned"))
    return planned.select("status", "path", kind.alias("_kind")).orderBy("_kind", "path").limit(shown).select(
        "status", "path"
    )


def upsert(stored: DataFrame, changed: DataFrame) -> DataFrame:
    """Replace or add whole rows by path."""
    kept = stored.join(changed.select("path"), "path", "left_anti").select(*stored.columns)
    return kept.unionByName(changed.select(*stored.columns))


def prune(stored: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Only documents that are still listed, readable or not."""
    return stored.join(snapshot.select("path"), "path", "left_semi").select(*stored.columns)


def carry_over(stored: DataFrame, changes: DataFrame, changed: DataFrame) -> DataFrame:
    """Upsert and prune in one anti-join."""
    gone = changes.filter(F.col("status").isin("upsert", "pruned")).select("path")
    kept = stored.join(gone, "path", "left_anti").select(*stored.columns)
    return kept.unionByName(changed.select(*stored.columns))


def check_root(last_root: str | None, root: str, full: bool) -> None:
    """A corpus that moved is an error unless everything is rebuilt."""
    if last_root and last_root != root and not full:
        raise ValueError(f"the index was built from {last_root}, not {root}; rebuild it in full")
