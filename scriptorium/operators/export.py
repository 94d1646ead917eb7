"""Result envelope as one JSON document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The columns of a hit in order, and the envelope's keys (``fts5`` holds a query's text form).
HIT_COLUMNS = ("rank", "score", "path", "abs_path", "title", "ext", "url", "snippet", "tags")


def to_envelope(hits: DataFrame, query: str, text: str, limit: int) -> DataFrame:
    """One row, one ``json`` column. The number of hits is bounded by the search limit."""
    shown = hits.select(
        *[F.round("score", 3).alias("score") if c == "score" else F.col(c) for c in HIT_COLUMNS]
    )
    listed = F.sort_array(F.collect_list(F.struct(*HIT_COLUMNS)))
    envelope = F.struct(
        F.lit(query).alias("query"), F.lit(text).alias("fts5"), F.lit(limit).alias("limit"), "hits"
    )
    return shown.agg(listed.alias("hits")).select(
        F.to_json(envelope, {"ignoreNullFields": "false"}).alias("json")
    )
