"""Mixing sources to target weights by capped water-filling, with seeded whole and fractional repetitions.

Every source asks for ``weight / sum(weights)`` of the total. A source's target stops at ``max_epochs`` times its
size; what it cannot take is shared again among the others by weight, until no target is above its cap. That
fixpoint is one water level ``v`` with ``target = min(cap, weight * v)``: with sources sorted by ``cap / weight``
those below the level are full, so the level follows from running sums over one row per source.

A target of ``e`` epochs takes every document ``floor(e)`` times and, once more, those documents whose seeded key is
at most the source's cutoff. The cutoff is the key at which the running size of the source's documents in key order
comes nearest to the words still missing, so the error is at most half a document. Keys fall into 4,096 bins; only
the bin that holds the cutoff is put in order, so no task sees a source as a whole.

Defined cases: null text has size 0; a null source is a source of its own; sources of size 0 get target 0; rows with
equal ids share a key and are taken alike; a null id has the key of the empty string; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm.base import saved, word_count

MAX_EPOCHS = 3
SEED = "mix-1"


def key(doc_id: Column, seed: str = SEED) -> Column:
    """Position of a document in its source's seeded order."""
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def cyclic_weights(sources: DataFrame) -> DataFrame:
    """(source, source_size) with weights 1, 2, 3, 1, … by code point of the source, null last."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    return sources.withColumn("weight", ((F.row_number().over(order) - 1) % 3 + 1).cast("long"))


def fill(sources: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, weight) plus ``target``. One row per source, so its windows need no partition."""
    everything = Window.partitionBy()
    rising = Window.orderBy("ratio", F.col("source").asc_nulls_first())
    up_to_here = rising.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    from_here = rising.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    cap = F.col("source_size") * max_epochs
    leveled = (
        sources.withColumn("cap", cap)
        .withColumn("ratio", F.col("cap").cast("double") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("full", F.sum("cap").over(up_to_here) - F.col("cap"))
        .withColumn("open", F.sum("weight").over(from_here))
        .withColumn("level", (F.col("total") - F.col("full")).cast("double") / F.col("open"))
    )
    # the first source that the level does not fill gives the level: levels fall as sources fill up
    first = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "full", "level"))).over(everything)
    target = F.least(F.col("cap").cast("double"), F.col("weight") * first["level"])
    return leveled.select("source", "source_size", "weight", target.alias("target"))


def sized(docs: DataFrame, seed: str = SEED) -> DataFrame:
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), key(F.col("doc_id"), seed).alias("key"))


def plan(sizes: DataFrame, weights=cyclic_weights, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per source: ``source_size, target, whole, cutoff``. ``sizes`` has doc_id, source, size, key.

    ``weights`` turns (source, source_size) into (source, source_size, weight).
    """
    bins = saved(
        sizes.groupBy("source", F.substring("key", 1, 3).alias("bin")).agg(F.sum("size").alias("bin_size")), "mix-bins"
    )
    targets = fill(weights(bins.groupBy("source").agg(F.sum("bin_size").alias("source_size"))), max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    targets = saved(
        targets.withColumn("whole", whole.cast("long")).withColumn(
            "missing", F.col("target") - F.col("whole") * F.col("source_size")
        ),
        "mix-targets",
    )
    before = F.sum("bin_size").over(Window.partitionBy("source").orderBy("bin")) - F.col("bin_size")
    edge = (
        bins.withColumn("before", before)
        .join(targets.select(F.col("source").alias("s"), "missing"), F.col("source").eqNullSafe(F.col("s")))
        .drop("s")
        .filter("before < missing and missing <= before + bin_size")
        .select(F.col("source").alias("s"), F.col("bin").alias("b"), (F.col("missing") - F.col("before")).alias("left"))
    )
    inside = sizes.join(
        edge, F.col("source").eqNullSafe(F.col("s")) & (F.substring("key", 1, 3) == F.col("b"))
    ).groupBy("s", "b", "left", "key").agg(F.sum("size").alias("size"))
    so_far = F.sum("size").over(Window.partitionBy("s").orderBy("key")) - F.col("size")
    cut = (
        inside.withColumn("so_far", so_far)
        .groupBy("s", "b")
        # nothing of the bin is taken when even its first key would overshoot by more than it helps
        .agg(F.max(F.when(F.col("so_far") + F.col("size") / 2 <= F.col("left"), F.col("key"))).alias("last"))
        .select("s", F.coalesce("last", "b").alias("cutoff"))
    )
    return saved(
        targets.join(cut, F.col("source").eqNullSafe(F.col("s")), "left").select(
            "source", "source_size", "weight", "target", "whole", "cutoff"
        ),
        "mix-plan",
    )


def repeats(whole: Column, cutoff: Column, doc_key: Column) -> Column:
    return (whole + F.when(cutoff.isNotNull() & (doc_key <= cutoff), 1).otherwise(0)).cast("long")


def mix(docs: DataFrame, weights=cyclic_weights, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """Documents of the mix with all their columns and ``repeats``, how often each is taken (1 or more)."""
    planned = plan(saved(sized(docs, seed), "mix-sizes"), weights, max_epochs).select(
        F.col("source").alias("_mix_source"), F.col("whole").alias("_mix_whole"), F.col("cutoff").alias("_mix_cutoff")
    )
    taken = repeats(F.col("_mix_whole"), F.col("_mix_cutoff"), key(F.col("doc_id"), seed))
    return (
        docs.drop("repeats")
        .join(planned, F.col("source").eqNullSafe(F.col("_mix_source")))
        .withColumn("repeats", taken)
        .drop("_mix_source", "_mix_whole", "_mix_cutoff")
        .filter("repeats > 0")
    )


def report(docs: DataFrame, weights=cyclic_weights, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """Every document with its size, its source's size and target, and the words the mix takes from it."""
    sizes = saved(sized(docs, seed), "mix-sizes")
    planned = plan(sizes, weights, max_epochs).withColumnRenamed("source", "s")
    return sizes.join(planned, F.col("source").eqNullSafe(F.col("s"))).select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("size") * repeats(F.col("whole"), F.col("cutoff"), F.col("key"))).alias("taken"),
    )


SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix-1:' || coalesce(doc_id::VARCHAR, '')) AS k
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, source_size * 3 AS cap FROM s),
l AS (SELECT *, cap::DOUBLE / weight AS ratio,
             (sum(source_size) OVER () - (sum(cap) OVER (ORDER BY cap::DOUBLE / weight, source NULLS FIRST
                ROWS UNBOUNDED PRECEDING) - cap))::DOUBLE
             / (sum(weight) OVER (ORDER BY cap::DOUBLE / weight, source NULLS FIRST
                ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
      FROM w),
v AS (SELECT level FROM l WHERE level <= ratio ORDER BY ratio, source NULLS FIRST LIMIT 1),
t AS (SELECT l.source, source_size, least(cap::DOUBLE, weight * v.level) AS target FROM l, v),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
k AS (SELECT source, k, sum(size) AS size FROM d GROUP BY source, k),
c AS (SELECT k.source, max(k.k) FILTER (so_far + size / 2.0 <= target - whole * source_size) AS cutoff
      FROM (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY k) - size AS so_far FROM k) k
      JOIN e ON k.source IS NOT DISTINCT FROM e.source GROUP BY k.source)
SELECT d.doc_id, d.size, e.source_size, e.target,
       (d.size * (e.whole + CASE WHEN e.target > e.whole * e.source_size AND d.k <= c.cutoff THEN 1 ELSE 0 END))::BIGINT
         AS taken
FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source JOIN c ON d.source IS NOT DISTINCT FROM c.source
"""
