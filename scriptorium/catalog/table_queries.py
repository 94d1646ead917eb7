"""Registered queries: snapshot maintenance, tags, joins, set operations."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.catalog import sql
from scriptorium.catalog.inputs import (
    doc_path,
    corpus_view,
    indexed,
    labelled,
    listed_documents,
    snapshot,
    stamp,
    stored_documents,
    table,
    tag_tables,
)
from scriptorium.operators import snapshot as snap
from scriptorium.operators import tags as tag_ops
from scriptorium.operators.filters import in_subtree
from scriptorium.operators.postings import postings, update_postings
from scriptorium.operators.query import tag
from scriptorium.plans.index import Index, read_runs, run_row
from scriptorium.plans.search import score_matches
from scriptorium.plans.segments import summed_terms
from scriptorium.session import shared_dir
from scriptorium.sources.documents import listing_of, rows_from_table

QUERIES: dict = {}
SQL: dict[str, str] = {}

# Sizes are scaled so that the longest documents pass the size guard and are reported.
FACTOR = 512


def query(name: str, oracle: str | None = None):
    def register(function):
        QUERIES[name] = function
        if oracle is not None:
            SQL[name] = oracle
        return function

    return register


def _states(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stored documents, present documents with bodies, and the listing of the latter."""
    stored = stored_documents(spark, sf_dir)
    listed = listed_documents(spark, sf_dir)
    return stored, listed, snapshot(listed)


def _diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statuses with all sizes scaled on both sides."""
    stored, listed, _ = _states(spark, sf_dir)
    scaled = stored.withColumn("size", F.col("size") * FACTOR)
    return snap.diff(snapshot(listed, FACTOR), scaled)


GROWN = "(SELECT doc_id, lang, source, CASE WHEN lang = 'es' THEN text || chr(10) || lang ELSE text END AS text " \
    "FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0))"
STORED = "(SELECT * FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1))"
STATES = ", ".join([sql.documents_cte("old", STORED), sql.documents_cte("new", GROWN)])


def _changes(factor: int, limit: str = "8 * 1024 * 1024") -> str:
    return f"""changes AS (
  SELECT coalesce(new.path, old.path) AS path, new.ext AS ext, CASE
    WHEN new.path IS NULL THEN 'pruned'
    WHEN new.folder = 'src7' AND old.path IS NULL THEN 'never_indexed' WHEN new.folder = 'src7' THEN 'kept'
    WHEN old.size = new.size THEN 'unchanged' WHEN new.size * {factor} > {limit} THEN 'error'
    ELSE 'upsert' END AS status FROM new FULL JOIN old ON old.path = new.path)"""


SCALED = f"WITH {STATES}, {_changes(FACTOR)}"
PLAIN = f"WITH {STATES}, {_changes(1)}"
CARRIED = """carried AS (
  SELECT * FROM old WHERE path NOT IN (SELECT path FROM changes WHERE status IN ('upsert', 'pruned'))
  UNION ALL SELECT * FROM new WHERE path IN (SELECT path FROM changes WHERE status = 'upsert'))"""


@query("mnt1_snapshot_diff", f"{SCALED} SELECT path, ext, status FROM changes")
def mnt1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _diff(spark, sf_dir)


@query(
    "mnt1_same_size_other_time",
    f"SELECT {sql.PATH} AS path, CASE WHEN lang = 'de' THEN 'upsert' ELSE 'unchanged' END AS status FROM documents",
)
def mnt1_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """German documents keep their size and get another time."""
    docs = table(spark, sf_dir, "documents").select(doc_path().alias("path"), "lang")
    stored = corpus_view(spark, sf_dir)
    later = F.col("mtime") + F.expr("make_dt_interval(0, 0, 0, CASE WHEN lang = 'de' THEN 1 ELSE 0 END)")
    files = snapshot(stored).withColumn("readable", F.lit(True)).join(docs, "path").withColumn("mtime", later)
    return snap.diff(files.drop("lang"), stored).select("path", "status")


@query(
    "mnt2_upsert",
    f"{PLAIN} SELECT path, size, title, md5(body) AS digest FROM old WHERE path NOT IN "
    "(SELECT path FROM changes WHERE status = 'upsert') UNION ALL "
    "SELECT path, size, title, md5(body) FROM new WHERE path IN (SELECT path FROM changes WHERE status = 'upsert')",
)
def mnt2(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, listed, files = _states(spark, sf_dir)
    changed = listed.join(snap.with_status(snap.diff(files, stored), "upsert"), "path", "left_semi")
    return snap.upsert(stored, changed).select("path", "size", "title", F.md5("body").alias("digest"))


@query("mnt3_prune", f"{PLAIN} SELECT path, size FROM old WHERE path IN (SELECT path FROM new)")
def mnt3(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, _, files = _states(spark, sf_dir)
    return snap.prune(stored, files).select("path", "size")


@query(
    "mnt4_retention",
    f"{SCALED} SELECT path, status, md5(body) AS digest FROM old JOIN changes USING (path) WHERE status IN ('kept', 'error')",
)
def mnt4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed but unreadable (or too large) files keep the stored body."""
    kept = _diff(spark, sf_dir).filter(F.col("status").isin("kept", "error")).select("path", "status")
    stored = stored_documents(spark, sf_dir)
    return stored.join(kept, "path").select("path", "status", F.md5("body").alias("digest"))


@query(
    "mnt5_full_rebuild",
    f"WITH {STATES} SELECT path, size, md5(body) AS digest FROM new WHERE folder <> 'src7'",
)
def mnt5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything is read again; bodies of unreadable files are lost."""
    stored, listed, files = _states(spark, sf_dir)
    changes = snap.diff(files, stored.filter(F.lit(False)), full=True)
    fresh = listed.join(snap.with_status(changes, "upsert"), "path", "left_semi")
    return fresh.select("path", "size", F.md5("body").alias("digest"))


@query(
    "mnt2_index_update",
    "SELECT '_source=' || source AS folder, CAST(sum(length(text) + 1) AS BIGINT) AS chars FROM documents GROUP BY source",
)
def mnt2_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index over files: a first run without the Spanish documents, then an update that finds theirs."""
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("_source"), "text", "lang")
    root = f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
    spanish = F.coalesce(F.col("lang") == "es", F.lit(False))
    index = Index(spark, f"{root}-index")
    for part in (docs.filter(~spanish), docs.filter(spanish)):
        part.drop("lang").write.mode("append").option("maxRecordsPerFile", 500).partitionBy("_source").text(root)
        index.update(root)
    return index.corpus().documents.groupBy("folder").agg(F.sum(F.length("body")).cast("bigint").alias("chars"))


@query(
    "mnt6_dry_run",
    f"{SCALED} SELECT status, path FROM changes WHERE status IN ('upsert', 'pruned') "
    "ORDER BY status = 'pruned', path LIMIT 20",
)
def mnt6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snap.change_list(_diff(spark, sf_dir))


@query(
    "mnt7_run_stats",
    f"{SCALED} SELECT count(*) FILTER (status <> 'pruned') AS walked, count(*) FILTER (ext = 'txt') AS txt, "
    "count(*) FILTER (ext = 'md') AS md, count(*) FILTER (status = 'unchanged') AS unchanged, "
    "count(*) FILTER (status = 'upsert') AS upserted, count(*) FILTER (status = 'pruned') AS pruned, "
    "count(*) FILTER (status IN ('kept', 'never_indexed')) AS unreadable, count(*) FILTER (status = 'kept') AS kept, "
    "count(*) FILTER (status = 'never_indexed') AS never_indexed, count(*) FILTER (status = 'error') AS errors FROM changes",
)
def mnt7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snap.run_stats(_diff(spark, sf_dir))


@query(
    "mnt8_error_quarantine",
    f"{SCALED} SELECT path, 'ValueError: too large' AS message FROM changes WHERE status = 'error' ORDER BY path LIMIT 20",
)
def mnt8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first failures of a run; the run itself goes on."""
    failed = snap.with_status(_diff(spark, sf_dir), "error")
    return failed.orderBy("path").limit(snap.SHOWN).select(
        "path", F.lit("ValueError: too large").alias("message")
    )


@query(
    "mnt9_run_log",
    f"{SCALED} SELECT '/corpus' AS corpus_root, CAST(to_json({{"
    "'walked': count(*) FILTER (status <> 'pruned'), 'upserted': count(*) FILTER (status = 'upsert'), "
    "'unchanged': count(*) FILTER (status = 'unchanged'), 'pruned': count(*) FILTER (status = 'pruned'), "
    "'dataless': count(*) FILTER (status IN ('kept', 'never_indexed')), 'errors': count(*) FILTER (status = 'error')"
    "}) AS VARCHAR) AS last_run_stats FROM changes",
)
def mnt9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append two runs to a log and read the latest back."""
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}-runs/" + sf_dir.strip("/").replace("/", "-")
    first = run_row(snap.run_stats(_diff(spark, sf_dir)), "/elsewhere", stamp())
    second = run_row(snap.run_stats(_diff(spark, sf_dir)), "/corpus", stamp(F.lit(60)))
    first.write.mode("overwrite").parquet(path)
    second.write.mode("append").parquet(path)
    return read_runs(spark, path).select("corpus_root", "last_run_stats")


def _as_table(docs: DataFrame) -> DataFrame:
    return docs.select("path", F.col("body").alias("text"))


def _indexed_twice(spark: SparkSession, sf_dir: str, tagged: str | None = None) -> Index:
    """An index over the stored documents, some of them tagged, brought in line with the present listing."""
    stored, listed, _ = _states(spark, sf_dir)
    index = Index(spark, f"{shared_dir(spark)}/upkeep-{uuid.uuid4().hex}")
    index.update(_as_table(stored))
    if tagged:
        index.create_tags(["marked"])
        index.apply_tag("marked", under=tagged)
    rows = rows_from_table(_as_table(listed), F.col("path"), F.col("text"), F.lit(None))
    listing = listing_of(rows).withColumn("readable", ~F.startswith("path", F.lit("src7/")))
    index.update(_as_table(listed), snapshot=listing)
    return index


UPKEEP = (
    f"{PLAIN}, {CARRIED}, {sql.fields_cte('carried')}, {sql.TOK} "
    "SELECT term, count(DISTINCT path) AS n_docs, count(*) AS n_hits, CAST(sum(pos) AS BIGINT) AS pos_sum FROM tok GROUP BY term"
)


@query("mnt11_index_upkeep", UPKEEP)
def mnt11_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings and vocabulary of an index after an update: parts, tombstones and signed counts."""
    corpus = _indexed_twice(spark, sf_dir).corpus()
    sums = corpus.postings.groupBy("term").agg(
        F.sum(F.size("positions")).alias("n_hits"),
        F.sum(F.aggregate("positions", F.lit(0).cast("bigint"), lambda a, p: a + p)).alias("pos_sum"),
    )
    return summed_terms(corpus.terms).select("term", "n_docs").join(sums, "term", "full")


@query("jn6_index_orphans", f"WITH {STATES} SELECT path FROM old WHERE folder = 'src1' AND path IN (SELECT path FROM new)")
def orphans_of_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tag over a subtree, after its documents changed or went: found by its bitmap."""
    index = _indexed_twice(spark, sf_dir, "src1")
    return score_matches(index.corpus(), tag("marked")).select("path")


@query("mnt11_postings_upkeep", UPKEEP)
def mnt11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only touched documents are tokenised again; the rest of the postings is carried over."""
    stored, listed, files = _states(spark, sf_dir)
    changes = snap.diff(files, stored)
    changed = listed.join(snap.with_status(changes, "upsert"), "path", "left_semi")
    rows = update_postings(postings(stored), snap.with_status(changes, "upsert", "pruned"), changed)
    # Several fields of a document may hold a term: count the document once.
    per_doc = rows.groupBy("term", "path").agg(
        F.sum(F.size("positions")).alias("n"),
        F.sum(F.aggregate("positions", F.lit(0).cast("bigint"), lambda a, p: a + p)).alias("s"),
    )
    return per_doc.groupBy("term").agg(
        F.count("*").alias("n_docs"), F.sum("n").alias("n_hits"), F.sum("s").alias("pos_sum")
    )


@query(
    "jn1_hits_with_documents",
    f"WITH {sql.BASE} SELECT docs.path, title, sum(w)::DOUBLE AS f FROM tok JOIN docs USING (path) "
    "WHERE term = 'que' GROUP BY docs.path, title",
)
def jn1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scriptorium.operators.match import candidates
    from scriptorium.operators.query import word

    corpus = indexed(spark, sf_dir)
    hits = candidates(corpus.postings, word("que"), corpus.shards).select("path", F.col("f0").alias("f"))
    return hits.join(corpus.documents.select("path", "title"), "path")


@query(
    "jn6_tag9_orphans",
    f"WITH {STATES}, {sql.TAGS} SELECT path, name_key FROM document_tags WHERE path IN (SELECT path FROM new)",
)
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tag_ops.drop_orphans(tag_tables(spark, sf_dir)[1], listed_documents(spark, sf_dir))


@query("set2_stored_minus_seen", f"WITH {STATES} SELECT path FROM old EXCEPT SELECT path FROM new")
def stored_minus_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, _, files = _states(spark, sf_dir)
    return stored.select("path").join(files.select("path"), "path", "left_anti")


@query(
    "set1_union_of_paths",
    f"WITH {sql.DOCS} SELECT path FROM docs WHERE starts_with(path, 'src1/') "
    "UNION SELECT path FROM docs JOIN labels USING (doc_id) WHERE quality = 0",
)
def union_of_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = labelled(spark, sf_dir).filter(F.col("quality") == 0).select(F.col("path").alias("given"))
    return tag_ops.select_paths(corpus_view(spark, sf_dir), named, "src1")


WORDS = "words AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS name FROM benchmark)"


@query(
    "tag1_check_names",
    f"WITH {WORDS} SELECT name, NOT starts_with(name, '-') AND length(name) <= 64 AND "
    "regexp_matches(name, '^[\\p{L}\\p{N}_-]+$') AS valid FROM words",
)
def tag1(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", " ")).alias("name"))
    return words.distinct().select("name", tag_ops.is_valid_name(F.col("name")).alias("valid"))


def _new_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sources in capitals and all languages: the former are new tags, the latter exist."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.upper("source").alias("name")).unionByName(docs.select(F.col("lang").alias("name"))).distinct()


NEW_NAMES = "names AS (SELECT upper(source) AS name FROM documents UNION SELECT lang FROM documents)"


@query(
    "tag2_create",
    f"WITH {sql.TAGS}, {NEW_NAMES} SELECT coalesce(t.name, n.name) AS name, "
    "CASE WHEN t.name IS NULL THEN 'created' ELSE 'exists' END AS outcome FROM names n LEFT JOIN tags t ON t.name_key = lower(n.name)",
)
def tag2(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _new_names(spark, sf_dir)
    return tag_ops.create_tags(tag_tables(spark, sf_dir)[0], names, stamp()).outcome


@query(
    "tag2_catalog_after_create",
    f"WITH {sql.TAGS}, {NEW_NAMES} SELECT name, name_key FROM tags UNION ALL "
    "SELECT name, lower(name) FROM names WHERE lower(name) NOT IN (SELECT name_key FROM tags)",
)
def tag2_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _new_names(spark, sf_dir)
    return tag_ops.create_tags(tag_tables(spark, sf_dir)[0], names, stamp()).table.select("name", "name_key")


@query(
    "tag3_delete",
    f"WITH {sql.TAGS}, {NEW_NAMES} SELECT coalesce(t.name, n.name) AS name, "
    "CASE WHEN t.name IS NULL THEN 'missing' ELSE 'deleted' END AS outcome FROM names n LEFT JOIN tags t ON t.name_key = lower(n.name)",
)
def tag3(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags, assigned = tag_tables(spark, sf_dir)
    return tag_ops.delete_tags(tags, assigned, _new_names(spark, sf_dir))[0].outcome


@query(
    "tag3_delete_repeated",
    "WITH langs AS (SELECT DISTINCT lang FROM documents) SELECT upper(lang) AS name, 'deleted' AS outcome FROM langs "
    "UNION ALL SELECT lang, 'missing' FROM langs",
)
def tag3_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every language tag deleted twice, in two spellings: the second finds nothing left."""
    tags, assigned = tag_tables(spark, sf_dir)
    langs = table(spark, sf_dir, "documents").select("lang").distinct()
    twice = langs.select(F.upper("lang").alias("name"), F.lit(1).alias("seq")).unionByName(
        langs.select(F.col("lang").alias("name"), F.lit(2).alias("seq"))
    )
    return tag_ops.delete_tags(tags, assigned, twice)[0].outcome


@query(
    "tag3_cascade",
    f"WITH {sql.TAGS}, {NEW_NAMES} SELECT path, name_key FROM document_tags WHERE name_key NOT IN (SELECT lower(name) FROM names)",
)
def tag3_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags, assigned = tag_tables(spark, sf_dir)
    return tag_ops.delete_tags(tags, assigned, _new_names(spark, sf_dir))[1]


@query(
    "tag4_agg1_list",
    f"WITH {sql.TAGS} SELECT t.name, count(dt.path) AS n FROM tags t LEFT JOIN document_tags dt USING (name_key) GROUP BY t.name",
)
def tag4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tag_ops.list_tags(*tag_tables(spark, sf_dir))


@query(
    "tag5_apply",
    f"WITH {sql.DOCS}, {sql.TAGS} SELECT path, CASE WHEN path IN (SELECT path FROM document_tags WHERE name_key = 'toxic') "
    "THEN 'already' ELSE 'tagged' END AS outcome FROM docs WHERE starts_with(path, 'src2/') "
    "OR doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)",
)
def tag5(spark: SparkSession, sf_dir: str) -> DataFrame:
    poor = labelled(spark, sf_dir).filter(F.col("quality") == 0).select(F.col("path").alias("given"))
    paths = tag_ops.select_paths(corpus_view(spark, sf_dir), poor, "SRC2/")
    return tag_ops.apply_tag(tag_tables(spark, sf_dir)[1], "toxic", paths).outcome


@query(
    "tag6_remove",
    f"WITH {sql.DOCS}, {sql.TAGS} SELECT path, CASE WHEN path IN (SELECT path FROM document_tags WHERE name_key = 'quality') "
    "THEN 'untagged' ELSE 'absent' END AS outcome FROM docs WHERE starts_with(path, 'src2/')",
)
def tag6(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = tag_ops.select_paths(corpus_view(spark, sf_dir), under="src2")
    return tag_ops.remove_tag(tag_tables(spark, sf_dir)[1], "quality", paths).outcome


@query(
    "tag6_table_after_remove",
    f"WITH {sql.TAGS} SELECT path, name_key FROM document_tags WHERE NOT (name_key = 'quality' AND starts_with(path, 'src2/'))",
)
def tag6_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = tag_ops.select_paths(corpus_view(spark, sf_dir), under="src2")
    return tag_ops.remove_tag(tag_tables(spark, sf_dir)[1], "quality", paths).table


@query(
    "tag7_show",
    f"WITH {sql.TAGS} SELECT path, name FROM document_tags JOIN tags USING (name_key) "
    "WHERE path = (SELECT min(path) FROM document_tags WHERE name_key = 'toxic')",
)
def tag7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of one document: the first of those tagged toxic."""
    tags, assigned = tag_tables(spark, sf_dir)
    path = assigned.filter(F.col("name_key") == "toxic").agg(F.min("path").alias("p")).first()["p"]
    return tag_ops.show_tags(tags, assigned, path or "")


@query(
    "tag8_resolve",
    f"WITH {sql.DOCS}, given AS (SELECT path, CASE lang WHEN 'en' THEN path WHEN 'de' THEN ' ' || upper(path) "
    "WHEN 'fr' THEN '/data/' || path ELSE path || '.bak' END AS given, lang FROM docs) "
    "SELECT given, CASE WHEN lang <> 'es' THEN path END AS path, "
    "CASE lang WHEN 'en' THEN 'exact' WHEN 'de' THEN 'case' WHEN 'fr' THEN 'absolute' END AS how FROM given",
)
def tag8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document asked for exactly, in capitals, by absolute path, or by a name nobody has."""
    path = F.col("path")
    given = (
        F.when(F.col("lang") == "en", path)
        .when(F.col("lang") == "de", F.concat(F.lit(" "), F.upper(path)))
        .when(F.col("lang") == "fr", F.concat(F.lit("/data/"), path))
        .otherwise(F.concat(path, F.lit(".bak")))
    )
    wanted = labelled(spark, sf_dir).select(given.alias("given"))
    return tag_ops.resolve_paths(wanted, corpus_view(spark, sf_dir), "/data")


@query(
    "tag10_lookup",
    f"WITH {sql.TAGS}, {NEW_NAMES} SELECT n.name, lower(n.name) AS name_key, t.name AS stored FROM names n "
    "LEFT JOIN tags t ON t.name_key = lower(n.name)",
)
def tag10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tag_ops.lookup(_new_names(spark, sf_dir), tag_tables(spark, sf_dir)[0])


@query(
    "prd16_subtree_paths",
    f"WITH {sql.DOCS} SELECT path FROM docs WHERE starts_with(path, 'src1/') OR path = 'src1'",
)
def subtree_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_view(spark, sf_dir).filter(in_subtree(F.col("path"), "Src1")).select("path")
