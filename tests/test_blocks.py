"""Posting blocks hold the rows of postings, and an upkeep of postings moves texts and tokens once."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from scriptorium.catalog.inputs import snapshot
from scriptorium.operators import snapshot as snap
from scriptorium.operators.postings import posting_blocks, postings, unpacked, update_postings
from scriptorium.plans.corpus import settings, write_postings
from scriptorium.sources.documents import documents_from_table

TEXTS = {
    "src1/1.txt": "Title: of the sea\n\nthe sea the sea été",
    "src1/2.md": "# The sea\n\nthe the the",
    "src2/3.txt": "",
    "src2/4.md": "... --- ...",
    "src2/5.txt": "éte ÉTÉ naïve Straße 5",
    "src2/6.md": None,
}


@pytest.fixture
def documents(spark, tmp_path):
    rows = [*TEXTS.items(), ("src1/1.txt", "the path again"), (None, "no path")]
    spark.createDataFrame(rows, "path string, text string").write.parquet(str(tmp_path / "table"))
    table = spark.read.parquet(str(tmp_path / "table"))
    return documents_from_table(table, F.col("path"), F.col("text"), F.lit("2024-01-01").cast("timestamp"))


def listed(frame) -> list:
    columns = ("term", "path", "ext", "field", "dl", "lead", "positions")
    return sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=repr)


def test_blocks_unpack_to_the_rows_of_postings(documents):
    rows = listed(postings(documents))
    assert rows and listed(unpacked(posting_blocks(documents))) == rows
    assert posting_blocks(documents.coalesce(1).sortWithinPartitions("ext")).count() < len(rows)


def test_written_blocks_are_in_order_of_the_term(spark, documents, tmp_path):
    places = documents.withColumns({"segment": F.lit(3), "ord": F.monotonically_increasing_id()})
    write_postings(posting_blocks(places), str(tmp_path / "post"), 8)
    written = spark.read.parquet(str(tmp_path / "post"))
    assert listed(written) == listed(postings(documents))
    assert {r["segment"] for r in written.collect()} == {3}
    for file in (tmp_path / "post").rglob("*.parquet"):
        terms = [r["term"] for r in spark.read.parquet(str(file)).coalesce(1).collect()]
        assert terms == sorted(terms, key=lambda t: t.encode())


def dealt(plan) -> list[set[str]]:
    """Columns of each explicit repartition in an optimised plan."""
    found, children = [], plan.children()
    if plan.nodeName() == "RepartitionByExpression":
        output = plan.output()
        found.append({output.apply(i).name() for i in range(output.size())})
    return found + [x for i in range(children.size()) for x in dealt(children.apply(i))]


def test_a_diff_moves_no_text(documents):
    changes = snap.diff(snapshot(documents), documents)
    moved = dealt(changes._jdf.queryExecution().optimizedPlan())
    assert len(moved) == 2 and not any({"text", "body"} & columns for columns in moved)


def test_counts_after_an_upkeep_find_postings_in_place(spark, documents):
    touched = spark.createDataFrame([("src1/1.txt",), ("src2/3.txt",)], "path string")
    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": -1}):
        rows = update_postings(postings(documents), touched, documents.filter("path = 'src1/1.txt'"))
        counts = rows.groupBy("term", "path").agg(F.count("*").alias("n"))
        assert "hashpartitioning(term" not in counts._jdf.queryExecution().executedPlan().toString()
        found = {(r["term"], r["path"]): r["n"] for r in counts.collect()}
    expected: dict = {}
    for term, path, *_ in listed(postings(documents)):
        expected[term, path] = expected.get((term, path), 0) + 1
    assert found == {k: n for k, n in expected.items() if k[1] != "src2/3.txt"}
