"""Columns derived from file names and relative paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptorium.functions.text import rstrip

# Warnings attached to accepted but unusual names.
TRAILING_SPACE = "trailing whitespace in filename"
MISSING_DOT = "missing-dot extension"


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def folder_of(path: Column) -> Column:
    return F.regexp_extract(path, "^(?s)(.*)/[^/]*$", 1)


def extension(name: Column) -> Column:
    """``txt``, ``md`` or NULL when the name is not indexable."""
    tail = F.lower(rstrip(name))
    bare = ~F.contains(name, F.lit("."))
    return (
        F.when(F.startswith(name, F.lit(".")), None)
        .when(tail.endswith(".txt") | (bare & tail.endswith("txt")), "txt")
        .when(tail.endswith(".md") | (bare & tail.endswith("md")), "md")
    )


def name_warning(name: Column) -> Column:
    """NULL for a plain name; only meaningful where :func:`extension` is not NULL."""
    return F.when(rstrip(name) != name, TRAILING_SPACE).when(
        ~F.contains(name, F.lit(".")), MISSING_DOT
    )


def stem_of(name: Column, ext: Column) -> Column:
    """The name without trailing whitespace and without its (dotted or bare) extension."""
    full = rstrip(name)
    low = F.lower(full)
    dotted = F.concat(F.lit("."), ext)
    drop = F.when(F.endswith(low, dotted), F.length(dotted)).when(
        F.endswith(low, ext), F.length(ext)
    )
    return F.when(drop.isNull(), full).otherwise(F.substring(full, F.lit(1), F.length(full) - drop))


def is_hidden(path: Column) -> Column:
    """Dot-files, anything below a dot-directory, and compiled-module caches."""
    return path.rlike(r"(^|/)\.|(^|/)__pycache__/")
