"""Parts, logs and bitmaps of an index: what a change writes, what it means, and what upkeep leaves."""

from __future__ import annotations

import random
from pathlib import Path

import pytest
from conftest import paths, write_tree
from pyspark.sql import functions as F

from scriptorium.operators.filters import keep_tagged
from scriptorium.operators.query import ButNot, Everything, all_of, any_of, but_not, phrase, prefix, tag
from scriptorium.plans import segments
from scriptorium.plans.index import Index
from scriptorium.plans.search import filtered

WORDS = "copper kettle garden slug tape leek soup pond moss fern root seed".split()


def text_of(rng: random.Random) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(rng.randint(3, 12)))


def size_of(place: str) -> int:
    return sum(f.stat().st_size for f in Path(place).rglob("*.parquet"))


def counted(index: Index) -> dict:
    """What searches rely on: the vocabulary and the statistics."""
    corpus = index.corpus()
    terms = segments.summed_terms(corpus.terms)
    return {r["term"]: r.asDict() for r in terms.collect()} | {"": tuple(corpus.stats.first())}


def found(index: Index) -> list:
    queries = [but_not(any_of(phrase("copper kettle"), prefix("s"), "leek"), "fern"), all_of("moss", tag("wet"))]
    columns = ("path", "ext", "title", "snippet", "tags")
    return [
        [(*[r[c] for c in columns], round(r["score"], 9)) for r in index.search(q, limit=50, root=None).collect()] for q in queries
    ]


@pytest.fixture
def many(spark, tmp_path):
    rng = random.Random(4)
    files = {f"d{i % 7}/f{i}.{'txt' if i % 3 else 'md'}": text_of(rng) for i in range(60)}
    root = write_tree(tmp_path / "files", files)
    index = Index(spark, str(tmp_path / "index"))
    index.update(str(root))
    index.create_tags(["wet", "hot"])
    index.apply_tag("wet", under="d1")
    return index, root, rng


def test_changes_append_and_equal_a_rebuild(spark, many, tmp_path):
    index, root, rng = many
    before = index._state()["tables"]
    whole = size_of(before["documents"][0]) + size_of(before["postings"][0])
    seen = []
    for step in range(2):
        write_tree(root, {f"d{step}/f{step}.txt": text_of(rng) + " again", f"new{step}.md": text_of(rng)})
        for gone in rng.sample(sorted(p for p in root.rglob("*") if p.is_file()), 2):
            gone.unlink()
        index.update(str(root))
        if step == 1:
            index.apply_tag("hot", under="d2")
            index.remove_tag("wet", under="d1")
            index.apply_tag("wet", under="d3")
        seen.append(index._state()["tables"])
    after = seen[-1]
    # the first part is as it was, each change has one of its own
    assert after["documents"][0] == before["documents"][0] and len(after["documents"]) == 3
    assert len(after["tombstones"]) == 2 and all(size_of(p) < whole for p in after["postings"][1:])
    other = Index(spark, str(tmp_path / "other"))
    other.update(str(root))
    other.create_tags(["wet", "hot"])
    for name in ("wet", "hot"):
        named = index._assignments(index._state()).filter(F.col("name_key") == name)
        other.apply_tag(name, [r["path"] for r in named.collect()])
    assert found(index) == found(other) and counted(index) == counted(other)
    index.update(str(root), full=True)
    assert found(index) == found(other) and counted(index) == counted(other)


def test_what_a_change_writes_is_of_its_order(spark, tmp_path):
    rng = random.Random(1)
    body = " ".join(f"w{rng.randint(0, 5000)}" for _ in range(4000))
    rows = [(f"d/f{i}.txt", body + f" x{i}") for i in range(300)]
    index = Index(spark, str(tmp_path / "index"))
    table = spark.createDataFrame(rows, "path string, text string")
    index.update(table)
    first = index._state()["tables"]
    whole = sum(size_of(p) for t in ("documents", "postings", "terms") for p in first[t])
    rows[7] = (rows[7][0], "short now")
    index.update(spark.createDataFrame(rows, "path string, text string"))
    second = index._state()["tables"]
    fresh = [p for t in segments.SCHEMAS for p in second[t] if p not in first[t]]
    assert sum(size_of(p) for p in fresh) < whole / 20
    assert paths(index.search("short")) == ["d/f7.txt"] and paths(index.search("x7")) == []


def test_compaction_changes_no_result(many):
    index, root, rng = many
    for step in range(2):
        write_tree(root, {f"d1/f{step}.txt": text_of(rng), f"more{step}.txt": text_of(rng)})
        index.update(str(root))
    index.apply_tag("hot", under="d1")
    index.remove_tag("hot", under="d1")
    index.apply_tag("hot", ["more1.txt"])
    wanted, counts = found(index), counted(index)
    index.compact(below=10)
    state = index._state()
    assert len(state["tables"]["documents"]) == len(state["sizes"]) == 2 and found(index) == wanted
    index.compact()
    tables = index._state()["tables"]
    assert all(len(tables[n]) == 1 for n in ("documents", "postings", "terms", "stats", "assigned", "bits"))
    assert not (tables["tombstones"] or tables["unassigned"] or tables["dropped"])
    assert found(index) == wanted and counted(index) == counts
    assert segments.read(index.spark, "documents", tables["documents"]).count() == 63
    # places are kept, so a document changed after compaction still hides its old row
    write_tree(root, {"more1.txt": "nothing of it"})
    index.update(str(root))
    assert paths(index.search(all_of("nothing", tag("hot")))) == ["more1.txt"]
    index.compact()
    index.compact()
    assert paths(index.search(tag("hot"))) == ["more1.txt"]


def test_vacuum_keeps_what_versions_name(many):
    index, root, _ = many
    write_tree(root, {"d1/f1.txt": "moss moss"})
    index.update(str(root))
    index.compact()
    wanted = found(index)
    assert index.vacuum(keep=2) > 0 and found(index) == wanted
    old = [p for p in Path(index.location).glob("documents/*")]
    assert len(old) == 3 and index.vacuum() >= 4
    assert len(list(Path(index.location).glob("documents/*"))) == 1 and not list(Path(index.location).glob("changes/*"))
    assert found(index) == wanted and index.runs().count() == 2 and index.errors().count() == 0
    assert index.vacuum() == 0


def test_bitmaps_equal_assignments(many):
    """Trees over tags that were applied, removed, deleted and made again, on documents that changed meanwhile."""
    index, root, rng = many
    index.apply_tag("hot", under="d2")
    index.create_tags(["odd"])
    index.apply_tag("odd", [f"d{i % 7}/f{i}.{'txt' if i % 3 else 'md'}" for i in range(1, 60, 2)])
    write_tree(root, {"d2/f2.txt": text_of(rng), "d1/f1.txt": text_of(rng), "fresh.md": text_of(rng)})
    (root / "d2/f9.md").unlink()
    index.update(str(root))
    index.remove_tag("odd", under="d2")
    index.delete_tags(["hot"])
    index.create_tags(["HOT"])
    index.apply_tag("hot", ["fresh.md", "d1/f1.txt"])
    index.apply_tag("odd", ["d2/f2.txt"])
    trees = [
        tag("wet"),
        tag("HOT"),
        all_of(tag("odd"), tag("wet")),
        any_of(tag("hot"), tag("odd"), tag("never")),
        but_not(tag("odd"), any_of(tag("wet"), tag("hot"))),
        ButNot(Everything(), tag("odd")),
        any_of(ButNot(Everything(), any_of(tag("wet"), tag("odd"))), tag("hot")),
        ButNot(Everything(), tag("never")),
    ]
    for step in ("log", "compacted"):
        corpus = index.corpus()
        for tree in trees:
            by_bits = filtered(corpus.documents, corpus, tree).select("path")
            by_path = keep_tagged(corpus.documents.select("path"), corpus.document_tags, tree)
            assert sorted(paths(by_bits)) == sorted(paths(by_path)), (step, tree)
        index.compact()
    assert paths(index.search(tag("hot"))) == ["d1/f1.txt", "fresh.md"]


def test_an_index_over_a_table(spark, tmp_path):
    index = Index(spark, str(tmp_path / "index"))
    big = "y" * (8 * 1024**2 + 1)
    rows = [("a/one.txt", "alpha beta"), ("a/two.md", "# Two\n\ngamma"), ("b/none.txt", None), ("b/big.txt", big), ("twice.txt", "x"), ("twice.txt", "y")]
    rows += [("photo.jpg", "alpha"), (".hidden/x.txt", "alpha"), (None, "alpha")]
    schema = "path string, text string, title string, size int"
    stats = index.update(spark.createDataFrame([(*r, "t", 1) for r in rows], schema)).first()
    assert (stats["walked"], stats["upserted"], stats["errors"]) == (5, 3, 2)
    wanted = [("b/big.txt", "ValueError: too large"), ("twice.txt", "ValueError: repeated path")]
    assert sorted(map(tuple, index.errors().collect())) == wanted
    assert paths(index.search("gamma")) == ["a/two.md"] and index.search("gamma").first()["title"] == "Two"
    # equal sizes with another text are a change, another time alone is none
    rows[0] = ("a/one.txt", "alpha zeta")
    rows[4:6] = [("twice.txt", "once")]
    timed = spark.createDataFrame(rows, "path string, text string").withColumn("mtime", F.current_timestamp())
    stats = index.update(timed).first()
    assert (stats["unchanged"], stats["upserted"], stats["errors"]) == (2, 2, 1)
    assert paths(index.search("zeta")) == ["a/one.txt"] and paths(index.search("beta")) == [] and paths(index.search("once")) == ["twice.txt"]
    # a document that became too large keeps its old row
    rows[0] = ("a/one.txt", big)
    stats = index.update(spark.createDataFrame(rows, "path string, text string")).first()
    assert (stats["upserted"], stats["errors"]) == (0, 2) and paths(index.search("zeta")) == ["a/one.txt"]
    stats, listed = index.plan(spark.createDataFrame(rows[1:2], "path string, text string"))
    assert stats.first()["pruned"] == 3 and listed.count() == 3
    with pytest.raises(ValueError, match="rebuild"):
        index.update(str(tmp_path))
    empty = index.update(spark.createDataFrame([], "path string, text string")).first()
    assert empty["pruned"] == 4 and index.corpus().documents.isEmpty() and paths(index.search("zeta")) == []
