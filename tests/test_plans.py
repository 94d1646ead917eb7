"""The plans must keep the shape they were written for."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import match
from scriptorium.operators.query import all_of, any_of, phrase, prefix, tag
from scriptorium.plans import ordered
from scriptorium.plans.search import score_matches, search


def planned(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def executed(frame) -> str:
    frame.collect()
    return planned(frame)


@pytest.fixture(scope="module")
def corpus(fixed):
    return fixed.corpus()


def test_terms_reach_the_scan_and_prune_directories(corpus):
    plan = planned(score_matches(corpus, all_of("copper", prefix("sla"))))
    scans = [line for line in plan.splitlines() if "FileScan parquet [term" in line]
    assert scans
    for line in scans:
        assert re.search(r"PartitionFilters: \[shard#\d+ IN|PartitionFilters: \[\(shard#\d+ = ", line), line
        assert "PushedFilters: [Or(" in line and "StringStartsWith(term,sla)" in line


def test_one_shuffle_on_the_path_shared_with_the_statistics(corpus):
    plan = executed(score_matches(corpus, any_of(phrase("copper tape"), "slugs")))
    assert "ReusedExchange" in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "body#" not in plan


def test_only_rows_of_hits_are_read_for_bodies(corpus):
    plan = executed(search(corpus, any_of("copper", "saffron")))
    bodies = [x for x in plan.splitlines() if "FileScan parquet" in x and "body#" in x]
    assert bodies and all(re.search(r"PartitionFilters: \[.*ext#.*shard#", x) for x in bodies)
    assert all(re.search(r"PushedFilters: \[.*In\(path, \[", x) for x in bodies)
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_tags_of_hits_are_read_by_their_paths(corpus):
    plan = executed(search(corpus, any_of("copper", "saffron"), snippets=False))
    tags = [x for x in plan.splitlines() if "FileScan parquet" in x and "name_key#" in x and "path#" in x]
    assert tags and all(re.search(r"PartitionFilters: \[.*shard#", x) and "In(path, [" in x for x in tags)


def test_a_tag_predicate_reads_the_bitmaps_of_its_tags(corpus):
    plan = planned(score_matches(corpus, all_of("copper", tag("outdoors"), tag("Cooking"))))
    scans = [x for x in plan.splitlines() if "FileScan parquet" in x and "name_key#" in x]
    assert scans and all("bits#" in x and "path#" not in x for x in scans)
    assert all("In(name_key, [cooking,outdoors])" in x for x in scans)


def test_tag_only_search_reads_no_bodies(corpus):
    plan = executed(search(corpus, tag("outdoors")))
    assert not re.search(r"FileScan parquet \[[^\]]*body#", plan)


def test_common_rows_are_dropped_before_the_shuffle(corpus):
    guard = match.Guard("june", ())
    plan = planned(match.candidates(corpus.postings, all_of("copper", "june"), corpus.shards, guard))
    assert plan.index("Exchange hashpartitioning(path") < plan.index("BroadcastHashJoin")


def test_a_short_prefix_leaves_words_pruned(corpus):
    plan = planned(score_matches(corpus, all_of("copper", prefix("t"))))
    scans = [line for line in plan.splitlines() if "FileScan parquet [term" in line]
    words = [line for line in scans if "StartsWith(term" not in line.split("DataFilters")[1].split("Format")[0]]
    assert words and all(re.search(r"PartitionFilters: \[.*shard#\d+ (IN|=)", line) for line in words)


def test_words_and_subtrees_are_found_in_ranges(spark, corpus, tmp_path):
    """A vocabulary and paths in several ranges: a look-up reads the directories that can hold it."""
    words = spark.range(1000).selectExpr("lpad(cast(id as string), 4, '0') as term", "id as n").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranges = ordered.write_ordered(words, "term", str(tmp_path / "part=a"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(ranges) > 2 and [f for _, f in ranges] == sorted(f for _, f in ranges)
    table = spark.read.schema("term string, n bigint, part string, range int").option("basePath", str(tmp_path)).parquet(
        str(tmp_path / "part=a")
    )
    for low, high in (("0000", "0000"), ("0500", "0500"), ("0998", "2"), ("00", "01"), ("/", "/"), ("0250", "0750")):
        found = ordered.within(table, {"a": ranges}, [(low, high)])
        wanted = [r["n"] for r in words.filter(F.col("term").between(low, high)).collect()]
        assert sorted(r["n"] for r in found.filter(F.col("term").between(low, high)).collect()) == sorted(wanted)
    assert len(ordered.met(ranges, [("0500", "0500")])) <= 2 < len(ranges)
    scan = planned(ordered.within(table, {"a": ranges}, [("0500", "0500")]))
    assert re.search(r"PartitionFilters: \[.*range#\d+", scan)
    assert "range#" in planned(corpus.beneath("garden/beds")) and "body#" not in planned(corpus.beneath("garden"))
    assert sorted(r["path"] for r in corpus.beneath("GARDEN/beds").collect() if r["path"].startswith("garden/beds/"))[0].endswith("asparagus.md")
