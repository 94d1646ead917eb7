"""One search from a query to finished hit rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from scriptorium.functions.snippet import add_snippet
from scriptorium.operators.filters import (
    DEFAULT_LIMIT,
    check_limit,
    has_extension,
    in_subtree,
    keep_marked,
    keep_tagged,
    require_known,
)
from scriptorium.operators.match import (
    candidates,
    choose_guard,
    distinct_leaves,
    exact_tokens,
    known_frequency,
    place_of,
    score,
    word_counts,
)
from scriptorium.operators.postings import path_shard_of
from scriptorium.operators.query import Node, Tagged, all_of, separate, word
from scriptorium.operators.rank import absolute_path, snippet_or_title, top_k
from scriptorium.operators.tags import tags_of
from scriptorium.plans.corpus import Corpus
from scriptorium.plans.ordered import within


def split_query(
    corpus: Corpus, query: Node | str | None, require_tags: tuple[str, ...] | list[str] = ()
) -> tuple[Node | None, Node | None]:
    """Keyword and tag halves, with the required tags joined to the latter."""
    if isinstance(query, str):
        query = word(query)
    text, tags = separate(query) if query is not None else (None, None)
    if require_tags:
        require_known(corpus.tags, list(require_tags))
        named = [Tagged(n) for n in require_tags]
        tags = all_of(*([tags] if tags is not None else []), *named)
    if text is None and tags is None:
        raise ValueError("a search needs a keyword query or a tag")
    return text, tags


def filtered(
    rows: DataFrame,
    corpus: Corpus,
    tags: Node | None,
    ext: str | None = None,
    under: str | None = None,
) -> DataFrame:
    if ext is not None:
        rows = rows.filter(has_extension(F.col("ext"), ext))
    if under is not None:
        rows = rows.filter(in_subtree(F.col("path"), under))
    if tags is None:
        return rows
    if corpus.bits is not None:
        return keep_marked(rows, corpus.bits, tags)
    return keep_tagged(rows, corpus.document_tags, tags)


def score_matches(
    corpus: Corpus,
    query: Node | str | None,
    *,
    require_tags: tuple[str, ...] | list[str] = (),
    ext: str | None = None,
    under: str | None = None,
    with_active: bool = False,
) -> DataFrame:
    """Every match with its score: ``path, ext, score``, and its place in the index. No document body is read."""
    text, tags = split_query(corpus, query, require_tags)
    if text is None:
        below = under is not None and corpus.beneath is not None
        rows = corpus.beneath(under) if below else corpus.documents
        rows = rows.select("path", "ext", *place_of(rows), F.lit(0.0).alias("score"))
        if with_active:
            rows = rows.withColumn("active", F.array().cast("array<boolean>"))
    else:
        known, guard = {}, None
        if corpus.shards:
            leaves = distinct_leaves(text)
            terms = corpus.terms
            if corpus.term_ranges is not None:
                words = sorted({t for leaf in leaves for t in exact_tokens(leaf)})
                terms = within(terms, corpus.term_ranges, [(w, w) for w in words])
            counts = word_counts(terms, leaves)
            guard = choose_guard(text, counts)
            known = {leaf: known_frequency(leaf, counts) for leaf in leaves}
            known = {leaf: n for leaf, n in known.items() if n is not None}
        cand = candidates(corpus.postings, text, corpus.shards, guard)
        rows = score(cand, text, corpus.stats, with_active, known)
    return filtered(rows, corpus, tags, ext, under)


def placed_rows(table: DataFrame, hits: list[Row], shards: int | None) -> DataFrame:
    """Rows of ``table`` with the paths of ``hits``, found by the table's own layout."""
    paths = sorted({h["path"] for h in hits})
    rows = table.filter(F.col("path").isin(paths))
    if "ext" in table.columns:
        rows = rows.filter(F.col("ext").isin(sorted({h["ext"] for h in hits})))
    if shards and "shard" in table.columns:
        rows = rows.filter(F.col("shard").isin(sorted({path_shard_of(p, shards) for p in paths})))
    return rows


def search(
    corpus: Corpus,
    query: Node | str | None = None,
    *,
    require_tags: tuple[str, ...] | list[str] = (),
    ext: str | None = None,
    under: str | None = None,
    limit: int = DEFAULT_LIMIT,
    root: str | None = None,
    snippets: bool = True,
) -> DataFrame:
    """Ranked hits: ``rank, score, path, abs_path, title, ext, url, snippet, tags``.

    The top-k is found on paths and scores alone, and its rows (never more than ``limit``) come to the driver. Bodies
    and tags are then asked for by these paths as constants: they prune directories, and in files sorted by path the
    row groups and pages, so that what is read depends on the number of hits.
    """
    check_limit(limit)
    text, _ = split_query(corpus, query) if query is not None else (None, None)
    marked = snippets and text is not None
    scored = score_matches(
        corpus, query, require_tags=require_tags, ext=ext, under=under, with_active=marked
    )
    best = top_k(scored, limit)
    spark = best.sparkSession
    hits = best.collect()
    best = spark.createDataFrame(hits, best.schema)
    wanted = ["title", "url", "body"] if marked else ["title", "url"]
    keys = ["path", *(["segment"] if "segment" in best.columns else [])]
    rows = placed_rows(corpus.documents if corpus.stored is None else corpus.stored, hits, corpus.shards).select(*keys, *wanted)
    rows = rows.join(F.broadcast(best), keys)
    if marked:
        rows = add_snippet(rows, distinct_leaves(text))
        rows = rows.withColumn("snippet", snippet_or_title(F.col("snippet"), F.col("title")))
    else:
        rows = rows.withColumn("snippet", F.lit(""))
    tagged = tags_of(placed_rows(corpus.document_tags, hits, corpus.shards), corpus.tags, ["path"])
    out = rows.join(tagged, "path", "left")
    return out.orderBy("rank").select(
        "rank",
        "score",
        "path",
        absolute_path(F.col("path"), root).alias("abs_path"),
        "title",
        "ext",
        "url",
        "snippet",
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
    )
