"""Tag catalog and assignments. Every change returns the new table and one outcome row per input."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.text import ascii_key
from scriptorium.operators.filters import in_subtree

# The longest tag name and the characters allowed in one.
NAME_RULE = r"^(?!-)[\p{L}\p{N}_-]{1,64}$"


@dataclass(frozen=True)
class Change:
    table: DataFrame
    outcome: DataFrame


def is_valid_name(name: Column) -> Column:
    return F.coalesce(name.rlike(NAME_RULE), F.lit(False))


def invalid_names(names: DataFrame) -> DataFrame:
    return names.filter(~is_valid_name(F.col("name"))).select("name")


def check_names(names: DataFrame) -> None:
    bad = [r["name"] for r in invalid_names(names).limit(5).collect()]
    if bad:
        raise ValueError(f"invalid tag name: {', '.join(map(repr, bad))}")


def with_key(names: DataFrame) -> DataFrame:
    return names.withColumn("name_key", ascii_key(F.col("name")))


def lookup(names: DataFrame, tags: DataFrame) -> DataFrame:
    """``name`` in, ``name, name_key, stored`` out; ``stored`` is the catalog spelling or NULL."""
    catalog = tags.select("name_key", F.col("name").alias("stored"))
    return with_key(names.select("name")).join(catalog, "name_key", "left")


def create_tags(tags: DataFrame, names: DataFrame, now: Column | None = None) -> Change:
    """``created`` or ``exists`` per name. Spellings that differ in case only are one tag.

    Names already in the catalog keep their spelling. Among new names with the same key the first in
    ``seq`` order (input order, or the smallest spelling without one) is created.
    """
    order = F.col("seq") if "seq" in names.columns else F.col("name")
    keyed = with_key(names.withColumn("_o", order)).join(
        tags.select("name_key", F.col("name").alias("_have")), "name_key", "left"
    )
    fresh = (
        keyed.filter(F.col("_have").isNull())
        .groupBy("name_key")
        .agg(F.min_by("name", F.struct("_o", "name")).alias("_new"), F.min("_o").alias("_first"))
    )
    outcome = keyed.join(fresh, "name_key", "left").select(
        F.coalesce("_have", "_new").alias("name"),
        F.when(
            F.col("_have").isNull() & (F.col("name") == F.col("_new")) & (F.col("_o") == F.col("_first")),
            "created",
        )
        .otherwise("exists")
        .alias("outcome"),
    )
    stamp = F.current_timestamp() if now is None else now
    added = fresh.select(F.col("_new").alias("name"), "name_key", stamp.alias("created_at"))
    return Change(tags.unionByName(added.select(*tags.columns)), outcome)


def delete_tags(tags: DataFrame, document_tags: DataFrame, names: DataFrame) -> tuple[Change, DataFrame]:
    """``deleted`` or ``missing`` per name, and the assignments left after the cascade.

    Of names with the same key the first in ``seq`` order deletes (input order, or the smallest spelling without
    one); the others find nothing left.
    """
    order = F.col("seq") if "seq" in names.columns else F.col("name")
    keyed = with_key(names.withColumn("_o", order))
    first = keyed.groupBy("name_key").agg(F.min(F.struct("_o", "name")).alias("_first"))
    found = keyed.join(first, "name_key").join(
        tags.select("name_key", F.col("name").alias("stored")), "name_key", "left"
    )
    acts = F.col("stored").isNotNull() & (F.struct("_o", "name") == F.col("_first"))
    outcome = found.select(
        F.when(acts, F.col("stored")).otherwise(F.col("name")).alias("name"),
        F.when(acts, "deleted").otherwise("missing").alias("outcome"),
    )
    gone = first.select("name_key")
    return (
        Change(tags.join(gone, "name_key", "left_anti").select(*tags.columns), outcome),
        document_tags.join(gone, "name_key", "left_anti").select(*document_tags.columns),
    )


def list_tags(tags: DataFrame, document_tags: DataFrame) -> DataFrame:
    """Assignments per tag, zero included. Counted before the join, so a hot tag costs one row."""
    counted = document_tags.groupBy("name_key").agg(F.count("*").alias("n"))
    return (
        tags.join(counted, "name_key", "left")
        .select("name", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), "name_key")
        .orderBy("name_key")
        .select("name", "n")
    )


def tags_of(assignments: DataFrame, tags: DataFrame, keys: list[str]) -> DataFrame:
    """Ordered tag names as an array per ``keys`` (the path, or all columns of a hit)."""
    named = assignments.join(tags.select("name_key", "name"), "name_key")
    return named.groupBy(*keys).agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("name_key", "name"))), lambda t: t["name"]
        ).alias("tags")
    )


def show_tags(tags: DataFrame, document_tags: DataFrame, path: str) -> DataFrame:
    return (
        document_tags.filter(F.col("path") == path)
        .join(tags, "name_key")
        .orderBy("name_key")
        .select("path", "name")
    )


def resolve_paths(
    wanted: DataFrame, documents: DataFrame, root: str | None = None, few: bool = False
) -> DataFrame:
    """``given`` in, ``given, path, how`` out; ``path`` is NULL when nothing fits.

    Tried in order: the exact path, the path without regard to ASCII case, the absolute path under root.
    Where several stored paths differ in case only, the smallest is taken. ``few`` says that ``wanted``
    came from a list on the driver, so the documents are filtered in place instead of shuffled.
    """
    given = F.regexp_replace("given", r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
    asked = wanted.select("given").distinct().withColumn("_raw", given)
    if root is not None:
        base = root.rstrip("/") + "/"
        below = F.when(
            F.startswith("_raw", F.lit(base)),
            F.substring("_raw", F.lit(len(base) + 1), F.length("_raw")),
        )
    else:
        below = F.lit(None).cast("string")
    asked = asked.withColumn("_key", ascii_key(F.col("_raw"))).withColumn("_rel", below)
    # Whatever fits does so up to ASCII case; one pass over the documents keeps those paths only.
    keys = asked.select("_key").unionByName(asked.select(ascii_key(F.col("_rel")).alias("_key")))
    keys = keys.filter(F.col("_key").isNotNull()).distinct()
    near = documents.select("path", ascii_key(F.col("path")).alias("_key")).join(
        F.broadcast(keys) if few else keys, "_key", "left_semi"
    )
    exact = near.select(F.col("path").alias("_exact"))
    folded = near.groupBy("_key").agg(F.min("path").alias("_folded"))
    absolute = near.select(F.col("path").alias("_absolute"))
    joined = (
        asked.join(exact, asked["_raw"] == exact["_exact"], "left")
        .join(folded, "_key", "left")
        .join(absolute, F.col("_rel") == absolute["_absolute"], "left")
    )
    return joined.select(
        "given",
        F.coalesce("_exact", "_folded", "_absolute").alias("path"),
        F.when(F.col("_exact").isNotNull(), "exact")
        .when(F.col("_folded").isNotNull(), "case")
        .when(F.col("_absolute").isNotNull(), "absolute")
        .alias("how"),
    )


def select_paths(
    documents: DataFrame,
    paths: DataFrame | None = None,
    under: str | None = None,
    root: str | None = None,
    few: bool = False,
) -> DataFrame:
    """Distinct stored paths named one by one and/or by subtree. Unknown paths are an error."""
    chosen = None
    if under is not None:
        chosen = documents.filter(in_subtree(F.col("path"), under)).select("path")
    if paths is not None:
        resolved = resolve_paths(paths, documents, root, few)
        lost = [r["given"] for r in resolved.filter(F.col("path").isNull()).limit(5).collect()]
        if lost:
            raise ValueError(f"not in index: {', '.join(lost)}")
        named = resolved.select("path")
        chosen = named if chosen is None else chosen.unionByName(named)
    if chosen is None or chosen.isEmpty():
        raise ValueError("no documents to tag; pass paths or a subtree")
    return chosen.dropDuplicates(["path"])


def apply_tag(document_tags: DataFrame, name_key: str, paths: DataFrame) -> Change:
    """``tagged`` or ``already`` per path."""
    had = document_tags.filter(F.col("name_key") == name_key).select("path", F.lit(True).alias("_had"))
    seen = paths.join(had, "path", "left")
    outcome = seen.select(
        "path", F.when(F.col("_had").isNull(), "tagged").otherwise("already").alias("outcome")
    )
    added = seen.filter(F.col("_had").isNull()).select("path", F.lit(name_key).alias("name_key"))
    return Change(document_tags.unionByName(added), outcome)


def remove_tag(document_tags: DataFrame, name_key: str, paths: DataFrame) -> Change:
    """``untagged`` or ``absent`` per path; the catalog entry stays."""
    had = document_tags.filter(F.col("name_key") == name_key).select("path", F.lit(True).alias("_had"))
    outcome = paths.join(had, "path", "left").select(
        "path", F.when(F.col("_had").isNull(), "absent").otherwise("untagged").alias("outcome")
    )
    gone = paths.select("path", F.lit(name_key).alias("name_key"))
    return Change(document_tags.join(gone, ["path", "name_key"], "left_anti"), outcome)


def drop_orphans(document_tags: DataFrame, documents: DataFrame) -> DataFrame:
    """Assignments whose document is still stored; the catalog is not touched."""
    return document_tags.join(documents.select("path"), "path", "left_semi")
