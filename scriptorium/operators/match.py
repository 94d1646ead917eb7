"""Boolean evaluation and scoring of one query over postings, with a single shuffle on the path."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.bm25 import term_score
from scriptorium.functions.text import WEIGHTS
from scriptorium.operators.postings import PLACE, shard_of
from scriptorium.operators.query import AllOf, ButNot, Leaf, Node, leaves_of, truth


def place_of(rows: DataFrame) -> list[str]:
    return [c for c in PLACE if c in rows.columns]


def weight_column(field: Column) -> Column:
    out = F.lit(0.0)
    for name, weight in WEIGHTS.items():
        out = F.when(field == name, F.lit(weight)).otherwise(out)
    return out


def _term_test(term: Column, token: str, is_prefix: bool) -> Column:
    return F.startswith(term, F.lit(token)) if is_prefix else term == token


def distinct_leaves(tree: Node) -> list[Leaf]:
    return list(dict.fromkeys(leaf for leaf in leaves_of(tree) if leaf.tokens))


@dataclass(frozen=True)
class Guard:
    """A word every match must contain, and the leaves whose rows matter only beside it."""

    word: str
    free: tuple[Leaf, ...]


def word_counts(terms: DataFrame, leaves: list[Leaf]) -> dict[str, dict]:
    """Vocabulary rows of the exact words in a query; as many rows as the query has words."""
    words = sorted({t for leaf in leaves for t in exact_tokens(leaf)})
    if not words:
        return {}
    # the vocabulary is a log of signed counts
    counts = [F.sum(c).alias(c) for c in terms.columns if c == "n" or c.startswith("n_")]
    rows = terms.filter(F.col("term").isin(words)).groupBy("term").agg(*counts).collect()
    return {r["term"]: r.asDict() for r in rows}


def exact_tokens(leaf: Leaf) -> tuple[str, ...]:
    return leaf.tokens[:-1] if leaf.is_prefix else leaf.tokens


def known_frequency(leaf: Leaf, counts: dict[str, dict]) -> int | None:
    """Documents with the leaf, where the vocabulary tells: for single words."""
    if len(leaf.tokens) != 1 or leaf.is_prefix:
        return None
    column = "n_docs" if leaf.column is None else f"n_{leaf.column}"
    return counts.get(leaf.tokens[0], {}).get(column, 0)


def _required(node: Node) -> list[Leaf]:
    if isinstance(node, Leaf):
        return [node]
    if isinstance(node, ButNot):
        return _required(node.keep)
    return [leaf for p in node.parts for leaf in _required(p)] if isinstance(node, AllOf) else []


def choose_guard(tree: Node, counts: dict[str, dict]) -> Guard | None:
    """The rarest required word, if rows of commoner ones can be left out by it.

    Frequencies stay exact: words have theirs from the vocabulary, a phrase that contains the guard only
    occurs beside it, and all other leaves keep every row.
    """
    words = {t for leaf in _required(tree) for t in exact_tokens(leaf)}
    if not words:
        return None

    def rows(t: str) -> int:
        return counts.get(t, {}).get("n", 0)

    guard = min(sorted(words), key=rows)
    bound = [
        leaf
        for leaf in distinct_leaves(tree)
        if known_frequency(leaf, counts) is not None or guard in exact_tokens(leaf)
    ]
    free = tuple(leaf for leaf in distinct_leaves(tree) if leaf not in bound)
    kept = {t for leaf in free for t in exact_tokens(leaf)} | {guard}
    left_out = {t for leaf in bound for t in exact_tokens(leaf)} - kept
    return Guard(guard, free) if left_out else None


def _beside(rows: DataFrame, post: DataFrame, guard: Guard, shards: int | None) -> DataFrame:
    """Drop rows of bound leaves in documents without the guard. How the join runs is left to adaptive execution."""
    word = post.filter((F.col("term") == guard.word) & F.col("lead"))
    if shards:
        word = word.filter(F.col("shard") == shard_of(guard.word, shards))
    word = word.select("path", F.lit(True).alias("_beside"))
    keep = F.col("_beside").isNotNull()
    for leaf in guard.free:
        for k, token in enumerate(leaf.tokens):
            last = k == len(leaf.tokens) - 1
            keep = keep | _term_test(F.col("term"), token, leaf.is_prefix and last)
    return rows.join(word, "path", "left").filter(keep).drop("_beside")


def leaf_rows(post: DataFrame, leaves: list[Leaf], shards: int | None = None) -> DataFrame:
    """Only the posting rows some leaf can use. Both conditions reach the Parquet scan."""
    exact, starts = set(), set()
    for leaf in leaves:
        exact.update(leaf.tokens[:-1])
        (starts if leaf.is_prefix else exact).add(leaf.tokens[-1])
    term = F.col("term")
    short = sorted(p for p in starts if len(p) == 1) if shards else []
    pruned = exact | starts.difference(short)
    tests = [term.isin(sorted(exact))] if exact else []
    tests += [F.startswith(term, F.lit(p)) for p in sorted(starts.difference(short))]
    rows = post.filter(reduce(Column.__or__, tests, F.lit(False)))
    if shards:
        # a directory holds the terms with the same first two characters
        rows = rows.filter(F.col("shard").isin(sorted({shard_of(t, shards) for t in pruned})))
    if not short:
        return rows
    # a prefix of one character is in any directory; the rest keeps its own, pruned scan
    rest = post.filter(reduce(Column.__or__, [F.startswith(term, F.lit(p)) for p in short]))
    return rows.unionByName(rest.filter(~reduce(Column.__or__, tests))) if tests else rest


def _weighted_count(leaf: Leaf) -> Column:
    hit = _term_test(F.col("term"), leaf.tokens[0], leaf.is_prefix)
    if leaf.column is not None:
        hit = hit & (F.col("field") == leaf.column)
    weighted = weight_column(F.col("field")) * F.size("positions")
    return F.sum(F.when(hit, weighted).otherwise(F.lit(0.0)))


def _phrase_count(leaf: Leaf) -> Column:
    """Weighted number of places where the tokens stand side by side, from the collected rows."""

    def starts(field: str, offset: int) -> Column:
        last = offset == len(leaf.tokens) - 1
        rows = F.filter(
            F.col("occ"),
            lambda o: (o["field"] == field)
            & _term_test(o["term"], leaf.tokens[offset], leaf.is_prefix and last),
        )
        return F.transform(F.flatten(F.transform(rows, lambda o: o["positions"])), lambda p: p - offset)

    def in_field(field: str) -> Column:
        common = reduce(F.array_intersect, [starts(field, i) for i in range(len(leaf.tokens))])
        return F.lit(WEIGHTS[field]) * F.size(common)

    return reduce(Column.__add__, [in_field(f) for f in leaf.columns])


def candidates(
    post: DataFrame, tree: Node, shards: int | None = None, guard: Guard | None = None
) -> DataFrame:
    """``path, ext, dl``, the document's place where it has one, and one weighted frequency ``f<i>`` per distinct leaf.

    Documents without any leaf are absent: a legal query needs a positive leaf.
    """
    leaves = distinct_leaves(tree)
    keys = ["path", "ext", "dl", *place_of(post)]
    if not leaves:
        return post.filter(F.lit(False)).select(*keys).distinct()
    aggregates, phrase_tests = [], []
    for i, leaf in enumerate(leaves):
        if len(leaf.tokens) == 1:
            aggregates.append(_weighted_count(leaf).alias(f"f{i}"))
            continue
        for k, token in enumerate(leaf.tokens):
            last = k == len(leaf.tokens) - 1
            phrase_tests.append(_term_test(F.col("term"), token, leaf.is_prefix and last))
    if phrase_tests:
        row = F.when(
            reduce(Column.__or__, phrase_tests), F.struct("term", "field", "positions")
        )
        aggregates.append(F.collect_list(row).alias("occ"))
    rows = leaf_rows(post, leaves, shards)
    if guard is not None:
        rows = _beside(rows, post, guard, shards)
    grouped = rows.groupBy(*keys).agg(*aggregates)
    return grouped.select(
        *keys,
        *[
            F.col(f"f{i}") if len(leaf.tokens) == 1 else _phrase_count(leaf).alias(f"f{i}")
            for i, leaf in enumerate(leaves)
        ],
    )


def document_frequencies(cand: DataFrame) -> DataFrame:
    """One row: documents with at least one instance, per leaf column."""
    names = [c for c in cand.columns if c.startswith("f")]
    return cand.agg(*[F.count_if(F.col(c) > 0).alias(c) for c in names])


def _all(tests: list[Column]) -> Column:
    return reduce(Column.__and__, tests)


def _any(tests: list[Column]) -> Column:
    return reduce(Column.__or__, tests)


def matches(tree: Node, leaves: list[Leaf]) -> Column:
    def hit(leaf: Leaf) -> Column:
        return F.col(f"f{leaves.index(leaf)}") > 0 if leaf.tokens else F.lit(False)

    return truth(tree, hit, _all, _any, Column.__invert__)


def _counted(node: Node, gates: list[Node]) -> list[tuple[Leaf, list[Node]]]:
    """Leaf occurrences that can add to the score, each with the nodes that must match for it."""
    if isinstance(node, Leaf):
        return [(node, gates)] if node.tokens else []
    inside = [*gates, node]
    if isinstance(node, ButNot):
        return _counted(node.keep, inside)
    return [found for part in node.parts for found in _counted(part, inside)]


def score(
    cand: DataFrame,
    tree: Node,
    stats: DataFrame,
    with_active: bool = False,
    known: dict[Leaf, int] | None = None,
) -> DataFrame:
    """Matching documents with their score (lower is better).

    Corpus statistics, and frequencies that are not ``known`` already, are scalar subqueries over all
    candidates, so later filters never change them. ``with_active`` adds which distinct leaves counted,
    for snippets.
    """
    leaves = distinct_leaves(tree)
    if not leaves:
        none = cand.select("path", "ext", *place_of(cand), F.lit(0.0).alias("score"))
        return none.withColumn("active", F.array().cast("array<boolean>")) if with_active else none
    known = known or {}
    totals = stats.agg(
        F.struct(F.sum("n_docs").alias("docs"), F.sum("n_tokens").alias("tokens")).alias("c")
    ).scalar()
    hits = cand.filter(matches(tree, leaves)).withColumn("_total", totals)
    if any(leaf not in known for leaf in leaves):
        # All leaf columns are counted, which keeps the shuffle below identical to the one of the hits.
        freq = document_frequencies(cand)
        freq = freq.select(F.struct(*freq.columns).alias("n")).scalar()
        hits = hits.withColumn("_with", freq)
    active: list[Column] = [F.lit(False)] * len(leaves)
    total = F.lit(0.0)
    for leaf, gates in _counted(tree, []):
        i = leaves.index(leaf)
        gate = _all([matches(g, leaves) for g in gates] + [F.col(f"f{i}") > 0])
        part = term_score(
            F.col(f"f{i}"),
            F.col("dl"),
            F.lit(known[leaf]) if leaf in known else F.col(f"_with.f{i}"),
            F.col("_total.docs"),
            F.col("_total.tokens"),
        )
        total = total + F.when(gate, part).otherwise(F.lit(0.0))
        active[i] = active[i] | gate
    columns = ["path", "ext", *place_of(cand), (F.lit(0.0) - total).alias("score")]
    if with_active:
        columns.append(F.array(*active).alias("active"))
    return hits.select(*columns)
