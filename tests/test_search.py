from __future__ import annotations

import json
import random
import time

import pytest
from conftest import paths, write_tree
from pyspark.sql import Window
from pyspark.sql import functions as F

import brute
from scriptorium.functions.snippet import add_snippet
from scriptorium.operators import leaves as packing
from scriptorium.operators import match
from scriptorium.operators.export import to_envelope
from scriptorium.operators.query import all_of, any_of, but_not, phrase, prefix, tag, word
from scriptorium.operators.rank import top_k_per_query
from scriptorium.plans import batch
from scriptorium.plans.batch import score_many, search_many
from scriptorium.plans.corpus import in_memory, write_postings, write_terms
from scriptorium.plans.index import Index
from scriptorium.plans.search import score_matches, search


SLUGS = {"garden/beds/2022/beans.txt", "garden/pests.md"}


def test_words_phrases_prefixes(fixed):
    assert set(paths(fixed.search("SLUGS"))) == SLUGS
    assert paths(fixed.search("fraiche")) == ["garden/beds/2021/asparagus.md"]
    assert paths(fixed.search(phrase("copper tape"))) == ["garden/beds/2022/beans.txt"]
    assert paths(fixed.search(prefix("patien"))) == ["garden/_drafts/pond.txt"]
    assert paths(fixed.search("half-done")) == ["notes/a b (c) & d.md"]
    assert paths(fixed.search("flour-water")) == ["kitchen/bread.TXT"]


def test_boolean(fixed):
    assert paths(fixed.search(all_of("slugs", "saffron"))) == []
    assert set(paths(fixed.search(any_of("aphids", "pond")))) == {"garden/pests.md", "garden/_drafts/pond.txt"}
    assert set(paths(fixed.search(but_not("copper", "slugs")))) == {"_inbox.txt"}
    # a word whose only token is missing: AND gives nothing, OR ignores it
    assert paths(fixed.search(all_of("copper", phrase("...")))) == []
    assert len(paths(fixed.search(any_of("copper", "-")))) == 3


def test_filters(fixed):
    assert paths(fixed.search("slugs", ext="MD")) == ["garden/pests.md"]
    for under in ("garden/beds", "GARDEN/Beds/", "garden\\beds"):
        assert paths(fixed.search("copper", under=under)) == ["garden/beds/2022/beans.txt"]
    assert paths(fixed.search(word("pests", "path"))) == ["garden/pests.md"] and not paths(fixed.search(word("md")))
    assert set(paths(fixed.search(word("soups", "folder")))) == {"kitchen/Soups/leek.txt", "kitchen/Soups/saffron.md"}


def test_title_outranks_body(fixed):
    assert paths(fixed.search("saffron")) == ["kitchen/Soups/saffron.md", "kitchen/Soups/leek.txt"]


def test_tags(fixed):
    rows = fixed.search(tag("OutDoors")).collect()
    assert [r["path"] for r in rows] == sorted(r["path"] for r in rows) and len(rows) == 4
    assert all(r["score"] == 0.0 and r["snippet"] == "" and r["tags"] == ["outdoors"] for r in rows)
    assert set(paths(fixed.search(all_of(tag("outdoors"), "copper")))) == SLUGS
    assert len(paths(fixed.search(any_of(tag("outdoors"), tag("cooking"))))) == 6
    assert paths(fixed.search(but_not("copper", tag("outdoors")))) == ["_inbox.txt"]
    assert paths(fixed.search(tag("unheard"))) == []
    assert len(paths(fixed.search(require_tags=["COOKING"]))) == 2
    with pytest.raises(ValueError, match="not found"):
        fixed.search("copper", require_tags=["unheard"])
    with pytest.raises(ValueError):
        fixed.search()


def test_filters_leave_scores_alone(fixed):
    whole = {r["path"]: r["score"] for r in fixed.search("copper").collect()}
    for options in ({"ext": "md"}, {"under": "garden"}, {"require_tags": ["outdoors"]}):
        found = fixed.search("copper", **options).collect()
        assert found and all(r["score"] == whole[r["path"]] for r in found)


def test_hit_columns(fixed):
    row = fixed.search("june", root="/data/").first()
    assert (row["rank"], row["title"], row["url"]) == (1, "Runner beans", "https://example.org/beans")
    assert row["abs_path"] == "/data/garden/beds/2022/beans.txt" and ">>June<<" in row["snippet"]
    assert fixed.search("june", snippets=False).first()["snippet"] == ""


def test_title_only_hit_shows_title_when_body_is_blank(spark, tmp_path):
    root = write_tree(tmp_path / "c", {"Blank.txt": " \n", "x.txt": "other"})
    index = Index(spark, str(tmp_path / "i"))
    index.update(str(root))
    assert index.search("blank").first()["snippet"] == "Blank"


def test_envelope(fixed):
    hits = fixed.search(any_of("fraiche", "pond"))
    data = json.loads(to_envelope(hits, "typed", "shown", 20).first()["json"])
    assert (data["query"], data["fts5"], data["limit"], len(data)) == ("typed", "shown", 20, 4)
    assert [h["rank"] for h in data["hits"]] == [1, 2]
    assert any("fraîche" in h["snippet"] for h in data["hits"])
    assert all(h["score"] == round(h["score"], 3) for h in data["hits"])
    assert json.loads(to_envelope(fixed.search("zzz"), "zzz", "zzz", 20).first()["json"])["hits"] == []


# -- random corpora against the plain restatement ---------------------------------------------------

ALPHABET = "a b c d ab abc".split()


def random_docs(rng: random.Random, n: int) -> list[dict]:
    docs = []
    for i in range(n):
        words = rng.choices(ALPHABET, k=rng.choice([0, 3, 12, 40]))
        body = "".join(w + rng.choice([" ", " ", " ", ". ", ": ", ", ", ".\n", "-"]) for w in words)
        docs.append(
            {
                "path": f"{rng.choice('xyz')}/{i}.txt",
                "title": " ".join(rng.choices(ALPHABET, k=2)),
                "stem": str(i),
                "folder": rng.choice("xyz"),
                "body": rng.choice(["", " (", "a "]) + body,
            }
        )
    return docs


def random_leaf(rng: random.Random):
    make = rng.choice([word, word, phrase, prefix])
    count = 1 if make is word else rng.choice([1, 2, 3])
    return make(" ".join(rng.choices(ALPHABET, k=count)), rng.choice([None, None, None, "title", "body"]))


def random_tree(rng: random.Random, depth: int):
    if depth == 0 or rng.random() < 0.2:
        return random_leaf(rng)
    kind = rng.choice([all_of, any_of, but_not])
    parts = [random_tree(rng, depth - 1) for _ in range(2 if kind is but_not else rng.choice([2, 3]))]
    return kind(*parts)


def corpus_of(spark, docs):
    from pyspark.sql import functions as F

    from scriptorium.functions.text import FIELDS, token_count

    frame = spark.createDataFrame(
        [(d["path"], d["title"], d["stem"], d["folder"], d["body"]) for d in docs],
        "path string, title string, stem string, folder string, body string",
    )
    dl = sum((token_count(F.col(f)) for f in FIELDS[1:]), token_count(F.col(FIELDS[0])))
    return in_memory(
        frame.select(
            "*", F.lit("txt").alias("ext"), F.lit(None).cast("string").alias("url"), F.lit(1).alias("size"),
            dl.cast("bigint").alias("dl"),
        )
    )


def stored(spark, corpus, folder):
    """The same corpus read back from disk, with sharded postings and a vocabulary."""
    from dataclasses import replace

    write_postings(corpus.postings, f"{folder}/postings", 4)
    post = spark.read.parquet(f"{folder}/postings")
    write_terms(post, f"{folder}/terms")
    return replace(corpus, postings=post, terms=spark.read.parquet(f"{folder}/terms"), shards=4)


@pytest.mark.parametrize("seed", range(6))
def test_random_trees_and_snippets(spark, seed):
    rng = random.Random(seed)
    docs = random_docs(rng, 25)
    by_path = {d["path"]: d for d in docs}
    corpus = corpus_of(spark, docs)
    tree = random_tree(rng, 2)
    expected = brute.scores(docs, tree)
    got = {r["path"]: r["score"] for r in score_matches(corpus, tree).collect()}
    assert got.keys() == expected.keys(), str(tree)
    for p, s in expected.items():
        assert got[p] == pytest.approx(s, abs=1e-12), (str(tree), p)
    for r in search(corpus, tree, limit=100).collect():
        want = brute.snippet(by_path[r["path"]], tree)
        assert r["snippet"] == (want if want.strip() else r["title"]), (str(tree), by_path[r["path"]])


@pytest.mark.parametrize("seed", range(10, 14))
def test_guarded_evaluation_is_exact(spark, tmp_path, seed):
    """Every conjunction is evaluated beside its rarest word."""
    rng = random.Random(seed)
    docs = random_docs(rng, 25)
    corpus = stored(spark, corpus_of(spark, docs), tmp_path)
    guarded = 0
    for _ in range(2):
        tree = all_of("d", random_leaf(rng), random_tree(rng, 1))
        leaves = match.distinct_leaves(tree)
        guarded += match.choose_guard(tree, match.word_counts(corpus.terms, leaves)) is not None
        expected = brute.scores(docs, tree)
        got = {r["path"]: r["score"] for r in score_matches(corpus, tree).collect()}
        assert got.keys() == expected.keys(), str(tree)
        for p, s in expected.items():
            assert got[p] == pytest.approx(s, abs=1e-12), (str(tree), p)
    print("guarded", guarded)


def test_guard_choice():
    counts = {t: {"n": n, "n_docs": n} for t, n in (("the", 10**9), ("of", 10**8), ("rare", 5))}
    # The phrase without the guard needs all rows of "the", so nothing would be left out.
    assert match.choose_guard(all_of("the", "rare", phrase("the of")), counts) is None
    chosen = match.choose_guard(all_of("the", "rare", any_of("of", prefix("x"))), counts)
    assert chosen.word == "rare" and chosen.free == (prefix("x"),)
    assert match.choose_guard(phrase("the rare"), counts).word == "rare"
    assert match.choose_guard(any_of("the", "rare"), counts) is None
    assert match.choose_guard(but_not("rare", "the"), counts).free == ()
    # however frequent the rarest word is
    assert match.choose_guard(all_of("the", "of"), counts).word == "of"


def test_batch_equals_single_searches(spark):
    rng = random.Random(3)
    docs = random_docs(rng, 40)
    corpus = corpus_of(spark, docs)
    rows, trees = [], {}
    for q in range(12):
        slots = []
        for slot in range(rng.choice([1, 2])):
            leaves = [random_leaf(rng) for _ in range(rng.choice([1, 2]))]
            slots.append(any_of(*leaves))
            for alt, leaf in enumerate(leaves):
                field = {"stem": "path"}.get(leaf.column, leaf.column)
                rows.append((q, slot, alt, leaf.kind, leaf.value, field, False))
        tree = all_of(*slots)
        if rng.random() < 0.5:
            leaf = random_leaf(rng)
            rows.append((q, 9, 0, leaf.kind, leaf.value, leaf.column, True))
            tree = but_not(tree, leaf)
        trees[q] = tree
    # Clause values that have no tokens: never match, and exclude nothing.
    rows += [(50, 0, 0, "word", "a", None, False), (50, 1, 0, "word", "-", None, True)]
    rows += [(51, 0, 0, "word", "a", None, False), (51, 1, 0, "phrase", "...", None, False)]
    trees[50], trees[51] = word("a"), all_of("a", phrase("..."))
    clauses = spark.createDataFrame(
        rows, "query_id bigint, slot int, alt int, kind string, value string, field string, negated boolean"
    )
    got = {(r["query_id"], r["path"]): r["score"] for r in score_many(corpus, clauses).collect()}
    expected = {(q, p): s for q, tree in trees.items() for p, s in brute.scores(docs, tree).items()}
    assert got.keys() == expected.keys()
    for key, s in expected.items():
        assert got[key] == pytest.approx(s, abs=1e-12)
    for r in search_many(corpus, clauses, 3).collect():
        ordered = sorted((round(s, 12), p) for (q, p), s in expected.items() if q == r["query_id"])
        assert ordered[r["rank"] - 1][0] == pytest.approx(r["score"], abs=1e-9)


def test_a_long_body_full_of_hits(spark):
    """The time a snippet takes grows with the body, not with its square."""
    took = {}
    for n in (20_000, 160_000):
        body = "other. " * 5 + "hit it. hit " * n + "it hit"
        rows = spark.createDataFrame([(body, [True, True])], "body string, active array<boolean>")
        start = time.perf_counter()
        out = add_snippet(rows, [word("hit"), phrase("it hit")]).first()["snippet"]
        took[n] = time.perf_counter() - start
        assert out.startswith("…") and out.count(">>") >= 1 and out.endswith("…")
    assert took[160_000] < 30 * max(took[20_000], 0.5)


@pytest.mark.parametrize("limit", [1, 4])
def test_best_by_bounds_equal_the_best_of_all(spark, monkeypatch, limit):
    """Small blocks and few first candidates, so that bounds decide; equal documents tie."""
    monkeypatch.setattr(batch, "BLOCK_LOG2", 2)
    monkeypatch.setattr(batch, "FIRST", 1)
    rng = random.Random(9)
    numbered = F.row_number().over(Window.orderBy("path")).cast("bigint")
    documents = corpus_of(spark, random_docs(rng, 60)).documents.withColumns({"segment": F.lit(1), "ord": numbered})
    corpus = in_memory(documents)
    rows = []
    for q in range(8):
        for slot in range(1 + q % 3):
            for alt in range(3):
                leaf = random_leaf(rng)
                rows.append((q, slot, alt, leaf.kind, leaf.value, {"stem": "path"}.get(leaf.column, leaf.column), False))
        if q % 2:
            leaf = random_leaf(rng)
            rows.append((q, 9, 0, leaf.kind, leaf.value, None, True))
    clauses = spark.createDataFrame(
        rows, "query_id bigint, slot int, alt int, kind string, value string, field string, negated boolean"
    )
    columns = ("query_id", "rank", "path", "score")
    whole = top_k_per_query(score_many(corpus, clauses), limit).select(*columns)
    assert sorted(map(tuple, search_many(corpus, clauses, limit).select(*columns).collect())) == sorted(map(tuple, whole.collect()))
    plan = batch._planned(corpus, clauses, None, None)
    upper = {(r["query_id"], r["path"]): r["upper"] for r in batch._bounded(plan).collect()}
    for r in score_many(corpus, clauses).collect():
        assert upper[r["query_id"], r["path"]] >= -r["score"] - 1e-9


CLAUSES = "query_id bigint, slot int, alt int, kind string, value string, field string, negated boolean"


def _plan_of(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def test_a_batch_moves_postings_once_and_judges_in_place(spark):
    """Hits of common words, phrases and prefixes meet by document in one shuffle; candidates are judged without any."""
    corpus = corpus_of(spark, random_docs(random.Random(5), 20))
    rows = [(1, 0, 0, "phrase", "a b", None, False), (1, 1, 0, "prefix", "a", None, False), (1, 2, 0, "word", "d", None, True)]
    clauses = spark.createDataFrame(rows, CLAUSES)
    leaves = [("a b|", ["a", "b"], False, None), ("a*|", ["a"], True, None), ("d|", ["d"], False, None)]
    leaves = [(n, *leaf[1:]) for n, leaf in enumerate(leaves)]
    leaves = spark.createDataFrame(leaves, "leaf int, toks array<string>, is_prefix boolean, column string")
    assert _plan_of(batch.leaf_hits(corpus, leaves)).count("Exchange hashpartitioning") == 1
    assert "Exchange" not in _plan_of(score_many(corpus, clauses))


def test_a_batch_in_small_buckets_and_runs(spark, monkeypatch):
    """Long lists of positions go in runs, and the documents are dealt over many buckets."""
    monkeypatch.setattr(packing, "RUN", 2)
    monkeypatch.setattr(packing, "BUCKET_TOKENS", 30)
    docs = random_docs(random.Random(12), 30)
    trees = [all_of(phrase("a b"), prefix("a")), any_of(phrase("a a"), phrase("b a b"), prefix("a a")), but_not("a", phrase("c d"))]
    rows = []
    for q, leaves in enumerate([[["a b"], ["a*"]], [["a a", "b a b", "a a*"]], [["a"], ["-c d"]]]):
        for slot, alts in enumerate(leaves):
            for alt, value in enumerate(alts):
                kind = "prefix" if value.endswith("*") else "phrase"
                rows.append((q, slot, alt, kind, value.strip("-*"), None, value.startswith("-")))
    got = {(r["query_id"], r["path"]): r["score"] for r in score_many(corpus_of(spark, docs), spark.createDataFrame(rows, CLAUSES)).collect()}
    expected = {(q, p): s for q, tree in enumerate(trees) for p, s in brute.scores(docs, tree).items()}
    assert got.keys() == expected.keys() and len(got) > 20
    for key, s in expected.items():
        assert got[key] == pytest.approx(s, abs=1e-12)


def test_a_batch_over_copies_of_a_path(spark):
    """The rows that joins on the path gave: copies add up; a place is a phrase's if, in all copies, as many of its other
    tokens stand beside the rarest one as it has."""
    columns = "path string, ext string, dl long, title string, folder string, stem string, body string, segment int, ord bigint"
    bodies = [("p.md", "x y z"), ("p.md", "x q"), ("p.md", "y y"), ("q.md", "x y y"), ("q.md", "x y y"), ("r.md", "x y z")]
    bodies += [("s.md", "w"), ("t.md", "x y z"), ("t.md", "u y y"), *[(f"{n}.md", "v") for n in range(9)]]
    rows = [(path, "md", len(body.split()), "", "", "", body, 1, n) for n, (path, body) in enumerate(bodies)]
    documents = spark.createDataFrame(rows, columns)
    asked = [(1, 0, 0, "word", "x"), (2, 0, 0, "phrase", "x y"), (3, 0, 0, "phrase", "x y z"), (4, 0, 0, "prefix", "x")]
    asked += [(5, 0, 0, "word", "x"), (5, 1, 0, "word", "y"), (6, 0, 0, "phrase", "y y"), (7, 0, 0, "prefix", "x y")]
    clauses = spark.createDataFrame([(*row, None, False) for row in asked], CLAUSES)
    got = {(r["query_id"], r["path"]): r["score"] for r in score_many(in_memory(documents), clauses).collect()}
    every = ["p.md", "q.md", "r.md", "t.md"]
    found = {q: sorted(p for k, p in got if k == q) for q in range(1, 8)}
    assert found == {1: every, 2: ["r.md"], 3: ["r.md"], 4: every, 5: every, 6: ["t.md"], 7: ["r.md"]}
    assert got[5, "p.md"] == pytest.approx(-2.033884993783, abs=1e-9)
    best = {(r["query_id"], r["path"]): r["score"] for r in search_many(in_memory(documents), clauses, 1).collect()}
    assert best == {key: s for key, s in got.items() if (s, key[1]) == min((t, p) for (q, p), t in got.items() if q == key[0])}


def test_batch_rejects(spark, fixed):
    schema = "query_id bigint, slot int, alt int, kind string, value string, field string, negated boolean"
    for row in [(1, 0, 0, "word", "a", None, True), (1, 0, 0, "near", "a", None, False), (1, 0, 0, "word", "a", "tag", False)]:
        with pytest.raises(ValueError):
            fixed.search_many(spark.createDataFrame([row], schema), 5)
