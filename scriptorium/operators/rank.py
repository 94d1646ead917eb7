"""Top-k selection and the columns added to the few rows that survive it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.operators.filters import check_limit


def top_k(scored: DataFrame, limit: int) -> DataFrame:
    """The best rows by score, then path, numbered from 1.

    Each task keeps its own best ``limit`` rows; at most ``limit`` (bounded) rows meet in the numbering.
    """
    best = scored.orderBy("score", "path").limit(check_limit(limit))
    return best.withColumn("rank", F.row_number().over(Window.orderBy("score", "path")))


def top_k_per_query(scored: DataFrame, limit: int) -> DataFrame:
    """The same per ``query_id``; each task drops all but its best ``limit`` rows before the shuffle."""
    order = Window.partitionBy("query_id").orderBy("score", "path")
    ranked = scored.withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= check_limit(limit))


def absolute_path(path: Column, root: str | None) -> Column:
    if root is None:
        return F.lit(None).cast("string")
    return F.concat_ws("/", F.lit(root.rstrip("/")), path)


def snippet_or_title(snippet: Column, title: Column) -> Column:
    """A blank snippet of a keyword hit falls back to the title."""
    return F.when(F.length(F.regexp_replace(snippet, r"(?U)[\s\x1c-\x1f]+", "")) == 0, title).otherwise(
        snippet
    )
