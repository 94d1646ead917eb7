"""Row filters beside the text match: extension, subtree and tags."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.bitmaps import EVERY, NONE, changed, constant, has_bit, word_of
from scriptorium.functions.text import ascii_key
from scriptorium.operators.query import Everything, Node, Tagged, leaves_of, truth

# Bounds of the result limit.
MIN_LIMIT, MAX_LIMIT, DEFAULT_LIMIT = 1, 10_000, 20

_ASCII_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def check_limit(limit: int) -> int:
    if not MIN_LIMIT <= limit <= MAX_LIMIT:
        raise ValueError(f"limit must be between {MIN_LIMIT} and {MAX_LIMIT}")
    return limit


def subtree_prefix(under: str) -> str:
    """Validate a subtree argument and bring it to the form paths are compared in."""
    cleaned = (under or "").strip().replace("\\", "/")
    if cleaned.startswith("/"):
        raise ValueError("a subtree is relative to the corpus root, not absolute")
    cleaned = cleaned.rstrip("/")
    segments = cleaned.split("/")
    if "\0" in cleaned or any(s in ("", ".", "..") for s in segments):
        raise ValueError(f"invalid subtree {under!r}")
    return cleaned.lower()


def in_subtree(path: Column, under: str) -> Column:
    wanted = subtree_prefix(under)
    low = F.lower(path)
    return (low == wanted) | F.startswith(low, F.lit(wanted + "/"))


def has_extension(ext: Column, wanted: str) -> Column:
    return ext == wanted.lower()


def tag_key(name: str) -> str:
    """Tags compare without regard to the case of ASCII letters."""
    return name.translate(_ASCII_FOLD)


def require_known(tags: DataFrame, names: list[str]) -> None:
    """Every required tag must be in the catalog; the lookup reads the named keys only."""
    keys = {tag_key(n): n for n in names}
    found = {r["name_key"] for r in tags.filter(F.col("name_key").isin(sorted(keys))).collect()}
    missing = [n for k, n in keys.items() if k not in found]
    if missing:
        raise ValueError(f"tag not found: {', '.join(missing)}")


def _tag_words(bits: DataFrame, tree: Node) -> DataFrame:
    """``segment, _word, _match``: the tree evaluated bit by bit on the words of its tags' bitmaps, which alone are read.

    A bitmap word holds 64 neighbouring documents. A tag's words are a log: changes are applied in their order.
    """
    named = sorted({tag_key(n.name) for n in leaves_of(tree) if isinstance(n, Tagged)})
    log = F.sort_array(F.collect_list(F.struct("seq", "name_key", "added", "bits")))
    words = bits.filter(F.col("name_key").isin(named)).groupBy("segment", F.col("word").alias("_word")).agg(log.alias("_log"))

    def word(node: Node) -> Column:
        if isinstance(node, Everything):
            return constant(EVERY)
        key = tag_key(node.name)
        return F.aggregate(F.filter("_log", lambda c: c["name_key"] == key), constant(NONE), changed)

    match = truth(tree, word, lambda cs: reduce(Column.bitwiseAND, cs), lambda cs: reduce(Column.bitwiseOR, cs), F.bitwise_not)
    return words.select("segment", "_word", match.alias("_match"))


def _untagged_ok(tree: Node) -> bool:
    """Whether a document without any of the named tags satisfies the tree."""
    return truth(tree, lambda n: isinstance(n, Everything), all, any, lambda b: not b)


def with_mark(rows: DataFrame, bits: DataFrame, tree: Node, name: str) -> DataFrame:
    """``rows`` (with ``segment, ord``) plus whether their tags satisfy the tree."""
    placed = rows.withColumn("_word", word_of(F.col("ord"))).join(_tag_words(bits, tree), ["segment", "_word"], "left")
    empty = constant(EVERY if _untagged_ok(tree) else NONE)
    return placed.select(*rows.columns, has_bit(F.coalesce("_match", empty), F.col("ord")).alias(name))


def keep_marked(rows: DataFrame, bits: DataFrame, tree: Node) -> DataFrame:
    """Rows (with ``segment, ord``) whose tags satisfy the tree, by bitmaps."""
    if not any(isinstance(leaf, Tagged) for leaf in leaves_of(tree)):
        return rows
    if _untagged_ok(tree):
        return with_mark(rows, bits, tree, "_kept").filter("_kept").select(*rows.columns)
    placed = rows.withColumn("_word", word_of(F.col("ord"))).join(_tag_words(bits, tree), ["segment", "_word"])
    return placed.filter(has_bit(F.col("_match"), F.col("ord"))).select(*rows.columns)


def keep_tagged(rows: DataFrame, document_tags: DataFrame, tree: Node) -> DataFrame:
    """Rows whose tags satisfy the tree.

    Assignments of the named tags are reduced to one row of flags per path before the join, whatever
    the number of documents a tag has. A lone tag is a semi-join.
    """
    if isinstance(tree, Tagged):
        named = document_tags.filter(F.col("name_key") == tag_key(tree.name))
        return rows.join(named.select("path"), "path", "left_semi")
    if not any(isinstance(leaf, Tagged) for leaf in leaves_of(tree)):
        return rows
    keys = sorted({tag_key(n.name) for n in leaves_of(tree) if isinstance(n, Tagged)})
    column_of = {k: f"_t{i}" for i, k in enumerate(keys)}
    flags = (
        document_tags.filter(F.col("name_key").isin(keys))
        .groupBy("path")
        .agg(*[F.max(F.col("name_key") == k).alias(c) for k, c in column_of.items()])
    )
    untagged_ok = _untagged_ok(tree)

    def flag(node: Node) -> Column:
        if isinstance(node, Everything):
            return F.lit(True)
        return F.coalesce(F.col(column_of[tag_key(node.name)]), F.lit(False))

    test = truth(
        tree,
        flag,
        lambda cs: reduce(Column.__and__, cs),
        lambda cs: reduce(Column.__or__, cs),
        Column.__invert__,
    )
    joined = rows.join(flags, "path", "left" if untagged_ok else "inner")
    return joined.filter(test).select(*rows.columns)
