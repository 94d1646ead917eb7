from __future__ import annotations

import os

import pytest
from conftest import paths, write_tree
from pyspark.sql import functions as F

from scriptorium.functions.text import FIELDS, query_tokens, separated
from scriptorium.operators import postings as module
from scriptorium.operators.filters import tag_key
from scriptorium.operators.postings import postings
from scriptorium.operators.query import phrase
from scriptorium.plans.corpus import file_size
from scriptorium.plans.index import Index
from scriptorium.sources.files import oversized, scan_files


def counters(frame) -> dict:
    return frame.first().asDict()


@pytest.fixture
def index(spark, corpus, tmp_path) -> Index:
    made = Index(spark, str(tmp_path / "index"))
    made.update(str(corpus))
    return made


def test_life_of_an_index(spark, corpus, index):
    """First run, no-op, one change, one removal, rebuild: counters, searches and tags."""
    root = str(corpus)
    first = counters(index.runs())
    assert (first["walked"], first["upserted"], first["errors"], first["txt"], first["md"]) == (10, 10, 0, 5, 5)
    assert index.corpus().documents.count() == 10

    index.create_tags(["wet", "hot"])
    index.apply_tag("wet", ["garden/_drafts/pond.txt", "kitchen/Soups/leek.txt"])
    index.apply_tag("hot", ["kitchen/Soups/leek.txt"])
    tables = index._state()["tables"]
    again = counters(index.update(root))
    assert (again["unchanged"], again["upserted"], again["pruned"]) == (10, 0, 0)
    assert index._state()["tables"]["documents"] == tables["documents"]

    target = corpus / "garden/_drafts/pond.txt"
    target.write_text(target.read_text(encoding="utf-8") + "\nwaterlilies too\n", encoding="utf-8")
    changed = counters(index.update(root))
    assert (changed["unchanged"], changed["upserted"]) == (9, 1)
    assert paths(index.search("waterlilies")) == paths(index.search("liner")) == ["garden/_drafts/pond.txt"]

    (corpus / "kitchen/Soups/leek.txt").unlink()
    stats, listed = index.plan(root)
    assert counters(stats)["pruned"] == 1
    assert [tuple(r) for r in listed.collect()] == [("pruned", "kitchen/Soups/leek.txt")]
    assert index.corpus().documents.count() == 10
    assert counters(index.update(root))["pruned"] == 1
    assert paths(index.search("potatoes")) == []
    assert {r["name"]: r["n"] for r in index.list_tags().collect()} == {"wet": 1, "hot": 0}

    rebuilt = counters(index.update(root, full=True))
    assert (rebuilt["upserted"], rebuilt["unchanged"]) == (9, 0)
    assert [r["name"] for r in index.show_tags("garden/_drafts/pond.txt").collect()] == ["wet"]
    stats = index.corpus().stats.first()
    lengths = index.corpus().documents.agg(F.count("*"), F.sum("dl")).first()
    assert tuple(stats) == tuple(lengths)
    direct = index.corpus().postings.agg(F.sum(F.size("positions"))).first()[0]
    assert direct == lengths[1]
    assert [r["upserted"] for r in index.runs().collect()] == [10, 0, 1, 0, 9]


def test_incremental_equals_rebuild(spark, corpus, index, tmp_path):
    write_tree(corpus, {"garden/new.md": "# New\n\ncopper tape", "_inbox.txt": "changed altogether now"})
    (corpus / "notes/a b (c) & d.md").unlink()
    index.update(str(corpus))
    other = Index(spark, str(tmp_path / "other"))
    other.update(str(corpus))
    for name in ("documents", "postings"):
        # where a row lies depends on the run it came in with
        place = ("indexed_at", "shard", "segment", "ord", "part")
        a = getattr(index.corpus(), name).drop(*place)
        b = getattr(other.corpus(), name).drop(*place).select(*a.columns)
        assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    assert paths(index.search(phrase("copper tape"))) == paths(other.search(phrase("copper tape")))


def test_unreadable_files_keep_their_row(spark, corpus, index):
    write_tree(corpus, {"late.txt": "never read"})
    listing = scan_files(spark, str(corpus)).withColumn("readable", F.lit(False))
    stats = counters(index.update(str(corpus), snapshot=listing))
    assert (stats["unreadable"], stats["kept"], stats["never_indexed"], stats["upserted"]) == (11, 10, 1, 0)
    assert paths(index.search("fraiche")) == ["garden/beds/2021/asparagus.md"]


def test_a_full_run_reads_the_given_listing_only(spark, corpus, index):
    listing = scan_files(spark, str(corpus)).filter(F.col("path").startswith("kitchen/"))
    assert counters(index.update(str(corpus), full=True, snapshot=listing))["upserted"] == 3
    assert index.corpus().documents.count() == 3 and paths(index.search("copper")) == []


def test_files_that_vanish_or_cannot_be_read_are_reported(spark, corpus, index):
    write_tree(corpus, {"garden/pests.md": "changed, then gone", "gone.txt": "new, then gone", "big.txt": b"x" * (8 * 1024**2 + 1)})
    listing = scan_files(spark, str(corpus)).cache()
    assert listing.count() == 12
    (corpus / "garden/pests.md").unlink()
    (corpus / "gone.txt").unlink()
    (corpus / "gone.txt").mkdir()
    write_tree(corpus, {"_inbox.txt": "rewritten"})
    stats = counters(index.update(str(corpus), snapshot=listing.withColumn("size", F.col("size") + (F.col("path") == "_inbox.txt").cast("int"))))
    assert (stats["errors"], stats["upserted"], stats["unchanged"]) == (3, 1, 8)
    failed = {r["path"]: r["message"] for r in index.errors().collect()}
    assert set(failed) == {"garden/pests.md", "gone.txt", "big.txt"} and failed["big.txt"] == "ValueError: too large"
    assert failed["garden/pests.md"].startswith("FileNotFoundError")
    # the old row stays, and the next run tries again
    assert paths(index.search("aphids")) == ["garden/pests.md"] and paths(index.search("rewritten")) == ["_inbox.txt"]
    assert counters(index.update(str(corpus)))["pruned"] == 1
    with pytest.raises(FileNotFoundError):
        scan_files(spark, str(corpus / "nowhere"))


def test_two_writers_do_not_lose_an_update(spark, corpus, index):
    other = Index(spark, index.location)
    stale = other._state()
    index.create_tags(["first"])
    with pytest.raises(RuntimeError, match="another writer"):
        other._commit(stale)
    assert [r["name"] for r in index.list_tags().collect()] == ["first"]


def test_moved_root_needs_a_rebuild(index, corpus, tmp_path):
    assert counters(index.update(f"file://{corpus}/"))["unchanged"] == 10
    moved = tmp_path / "moved"
    os.rename(corpus, moved)
    with pytest.raises(ValueError, match="rebuild"):
        index.update(str(moved))
    assert counters(index.update(str(moved), full=True))["upserted"] == 10


def test_plan_without_index_writes_nothing(spark, corpus, tmp_path):
    place = tmp_path / "none"
    stats, listed = Index(spark, str(place)).plan(str(corpus))
    assert counters(stats)["upserted"] == 10 and listed.count() == 10
    assert not place.exists()
    with pytest.raises(ValueError, match="empty"):
        Index(spark, str(place)).search("x")


def test_odd_files(spark, tmp_path):
    root = write_tree(
        tmp_path / "c",
        {
            "trailing.txt ": "alpha",
            "20250906txt": "beta",
            "100%/[x] {y}*.md": "gamma",
            "foo_bar/note.txt": "Title: n\n\ndelta",
            "fooxbar/note.txt": "delta",
            "legacy.txt": b"Title: caf\xe9 \x93q\x94\r\rsecond",
            "bom.txt": b"\xef\xbb\xbfTitle: marked\n",
            "empty.md": "",
            "big.txt": b"x" * (8 * 1024 * 1024 + 1),
            "limit.txt": b"word " * (8 * 1024 * 1024 // 5),
        },
    )
    rows = {r["path"]: r for r in scan_files(spark, str(root)).collect()}
    assert len(rows) == 10
    assert rows["trailing.txt "]["warning"] == "trailing whitespace in filename"
    assert rows["20250906txt"]["warning"] == "missing-dot extension"
    failed = oversized(scan_files(spark, str(root))).collect()
    assert [tuple(r) for r in failed] == [("big.txt", "ValueError: too large")]
    index = Index(spark, str(tmp_path / "i"))
    stats = counters(index.update("file:" + str(root)))
    assert (stats["upserted"], stats["errors"]) == (9, 1)
    docs = {r["path"]: r for r in index.corpus().documents.drop("body").collect()}
    assert docs["legacy.txt"]["title"] == "café “q”" and docs["bom.txt"]["title"] == "marked"
    assert docs["trailing.txt "]["stem"] == "trailing" and docs["20250906txt"]["stem"] == "20250906"
    assert docs["empty.md"]["title"] == "empty"
    assert paths(index.search("delta", under="foo_bar")) == ["foo_bar/note.txt"]
    assert paths(index.search("gamma", under="100%")) == ["100%/[x] {y}*.md"]
    # A changed file whose name holds wildcard characters is read by name.
    write_tree(root, {"100%/[x] {y}*.md": "epsilon now"})
    assert counters(index.update("file:" + str(root)))["upserted"] == 1
    assert paths(index.search("epsilon")) == ["100%/[x] {y}*.md"] and paths(index.search("gamma")) == []


def test_tag_life(index):
    made = index.create_tags(["Wet", "süß"]).collect()
    assert sorted(tuple(r) for r in made) == [("Wet", "created"), ("süß", "created")]
    again = index.create_tags(["WET", "new", "NEW", "SÜß"]).collect()
    assert sorted(tuple(r) for r in again) == [("SÜß", "created"), ("Wet", "exists"), ("new", "created"), ("new", "exists")]
    for bad in ("", "x ", "-x", "a/b", "y" * 65, "a,b"):
        with pytest.raises(ValueError):
            index.create_tags([bad])
    out = index.apply_tag("wet", ["_inbox.txt"], under="GARDEN/beds").collect()
    assert {r["outcome"] for r in out} == {"tagged"} and len(out) == 3
    out = {r["path"]: r["outcome"] for r in index.apply_tag("WET", ["_INBOX.txt", "empty.md"]).collect()}
    assert out == {"_inbox.txt": "already", "empty.md": "tagged"}
    out = {r["path"]: r["outcome"] for r in index.remove_tag("wet", ["_inbox.txt", "garden/pests.md"]).collect()}
    assert out == {"_inbox.txt": "untagged", "garden/pests.md": "absent"}
    absolute = index._state()["root"] + "/empty.md"
    assert [r["name"] for r in index.show_tags(absolute).collect()] == ["Wet"]
    assert {r["name"]: r["n"] for r in index.list_tags().collect()} == {"new": 0, "Wet": 3, "süß": 0, "SÜß": 0}
    for call in (
        lambda: index.apply_tag("unheard", ["_inbox.txt"]),
        lambda: index.apply_tag("wet", ["missing.txt"]),
        lambda: index.apply_tag("wet", []),
        lambda: index.apply_tag("wet", under="nowhere"),
    ):
        with pytest.raises(ValueError):
            call()
    gone = sorted(tuple(r) for r in index.delete_tags(["WET", "never", "wet"]).collect())
    assert gone == [("Wet", "deleted"), ("never", "missing"), ("wet", "missing")]
    assert index.corpus().document_tags.isEmpty()
    assert tag_key("ÉA") == "Éa"


def test_a_writing_task_has_a_small_share_however_large_the_index(spark):
    """A task sorts its share of the postings in memory."""
    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(name, None)
    shares = []
    for total in (2 * 1024**3, 200 * 1024**3):
        with file_size(spark, total):
            shares.append(int(spark.conf.get(name)))
    assert max(shares) <= 64 * 1024**2
    assert spark.conf.get(name, None) == before


def test_postings_of_long_and_short_documents_in_slices(spark, monkeypatch):
    rows = [("a.md", "md", 1, "t", "", "a", "b a B c-a"), ("b.md", "md", 2, "", "x", "b", ""), ("c.md", "md", 3, "a a", "c", "c", "c " * 5000)]
    rows += [("d.md", "md", 4, None, "", "d", "a"), ("e.md", "md", 5, "É", "e/é", "e", "e\u0301 e")]
    docs = spark.createDataFrame(rows, "path string, ext string, dl long, title string, folder string, stem string, body string")
    # rows as small as a slice can be
    batches = [r for r in docs.dropna().select("path", "ext", "dl", *[separated(F.col(f)).alias(f"_{f}") for f in FIELDS]).toArrow().to_batches()]
    monkeypatch.setattr(module, "SLICE_BYTES", 3)
    small = sorted((tuple(r.values()) for b in module._grouped(iter(batches)) for r in b.to_pylist()), key=str)
    whole = sorted((tuple(r) for r in postings(docs).collect()), key=str)
    assert small == whole
    expected = []
    for path, ext, dl, *texts in rows:
        if None in texts:
            continue
        seen = set()
        for field, value in sorted(zip(("title", "folder", "stem", "body"), texts)):
            places = {}
            for n, token in enumerate(query_tokens(value)):
                places.setdefault(token, []).append(n)
            for token, found in places.items():
                expected.append((token, path, ext, field, dl, token not in seen, found))
            seen |= set(places)
    assert whole == sorted(expected, key=str)
