"""Registered queries: sources, tokens and document rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.catalog import sql
from scriptorium.catalog.inputs import corpus_view, doc_path, indexed, table
from scriptorium.functions.decode import decode_text
from scriptorium.functions.headers import md_title, title_of, txt_title, txt_url
from scriptorium.functions.names import base_name, extension, folder_of, is_hidden, name_warning, stem_of
from scriptorium.functions.text import tokens
from scriptorium.operators.postings import corpus_stats, document_lengths, postings, token_rows
from scriptorium.plans.corpus import shard_count, listed_bytes, write_documents
from scriptorium.session import shared_dir
from scriptorium.sources.files import oversized, read_files, scan_files

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(function):
        QUERIES[name] = function
        if oracle is not None:
            SQL[name] = oracle
        return function

    return register


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}-{name}"


def _written(spark: SparkSession, sf_dir: str) -> str:
    """Every text, in files of at most 500 documents below a folder for each source."""
    root = f"{_scratch(spark, 'files')}-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("_source"), "text")
    docs.write.option("maxRecordsPerFile", 500).partitionBy("_source").text(root)
    return root


@query(
    "src6_read_files",
    "SELECT '_source=' || source AS folder, CAST(sum(length(text) + 1) AS BIGINT) AS chars, "
    "CAST(0 AS BIGINT) AS failed FROM documents GROUP BY source",
)
def src6_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts read back from files."""
    root = _written(spark, sf_dir)
    read = read_files(spark, root, scan_files(spark, root))
    return read.groupBy(folder_of(F.col("path")).alias("folder")).agg(
        F.sum(F.length("body")).cast("bigint").alias("chars"), F.count_if(F.col("message").isNotNull()).alias("failed")
    )


@query(
    "src1_scan_files",
    "SELECT '_source=' || source AS folder, 'txt' AS ext, CAST(sum(strlen(text) + 1) AS BIGINT) AS bytes "
    "FROM documents GROUP BY source",
)
def src1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every text below one folder per source, then list the folder tree."""
    files = scan_files(spark, _written(spark, sf_dir))
    return files.groupBy(folder_of(F.col("path")).alias("folder"), "ext").agg(
        F.sum("size").alias("bytes")
    )


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names of all shapes: one per document by language, and the last part of every page link."""
    docs = table(spark, sf_dir, "documents")
    number = F.col("doc_id").cast("string")
    made = (
        F.when(F.col("lang") == "en", F.concat(number, F.lit(".TXT")))
        .when(F.col("lang") == "fr", F.concat(number, F.lit(".notes.md \t")))
        .when(F.col("lang") == "de", F.concat(number, F.lit("Md")))
        .otherwise(F.concat(F.lit("."), number, F.lit(".txt")))
    )
    tails = table(spark, sf_dir, "pages").select(base_name(F.col("url")).alias("name"))
    dated = table(spark, sf_dir, "labels").select(
        F.concat(F.col("doc_id").cast("string"), F.lit("-0906txt ")).alias("name")
    )
    return docs.select(made.alias("name")).unionByName(tails).unionByName(dated)


NAMES_SQL = r"""names AS (
  SELECT CASE lang WHEN 'en' THEN doc_id || '.TXT' WHEN 'fr' THEN doc_id || '.notes.md ' || chr(9)
    WHEN 'de' THEN doc_id || 'Md' ELSE '.' || doc_id || '.txt' END AS name FROM documents
  UNION ALL SELECT regexp_extract(url, '[^/]*$') FROM pages
  UNION ALL SELECT doc_id || '-0906txt ' FROM labels),
classed AS (
  SELECT name, regexp_replace(name, '\s+$', '') AS t,
    CASE WHEN name LIKE '.%' THEN NULL
      WHEN regexp_matches(name, '(?i)\.txt\s*$') THEN 'txt' WHEN regexp_matches(name, '(?i)\.md\s*$') THEN 'md'
      WHEN contains(name, '.') THEN NULL
      WHEN regexp_matches(name, '(?i)txt\s*$') THEN 'txt' WHEN regexp_matches(name, '(?i)md\s*$') THEN 'md'
    END AS ext FROM names)"""


@query(
    "src2_classify_names",
    f"WITH {NAMES_SQL} SELECT name, ext, CASE WHEN t <> name THEN 'trailing whitespace in filename' "
    "WHEN NOT contains(name, '.') THEN 'missing-dot extension' END AS warning FROM classed WHERE ext IS NOT NULL",
)
def src2(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("name")
    classed = _names(spark, sf_dir).select(
        "name", extension(name).alias("ext"), name_warning(name).alias("warning")
    )
    return classed.filter(F.col("ext").isNotNull())


def _page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page links as paths; hosts of mobile and blog pages become folders a scan must skip."""
    host = F.regexp_extract("url", "^https?://([^/]*)", 1)
    rest = F.regexp_extract("url", "^https?://[^/]*(.*)$", 1)
    top = (
        F.when(F.startswith(host, F.lit("m.")), F.concat(F.lit("."), host))
        .when(F.startswith(host, F.lit("blog.")), F.lit("__pycache__"))
        .otherwise(host)
    )
    return table(spark, sf_dir, "pages").select("page_id", F.concat(top, rest).alias("path"))


PAGE_PATHS_SQL = r"""page_paths AS (
  SELECT page_id, CASE WHEN host LIKE 'm.%' THEN '.' || host WHEN host LIKE 'blog.%' THEN '__pycache__'
    ELSE host END || rest AS path
  FROM (SELECT page_id, split_part(split_part(url, '//', 2), '/', 1) AS host,
    substr(url, length(split_part(url, '//', 1)) + 3 + length(split_part(split_part(url, '//', 2), '/', 1))) AS rest
    FROM pages))"""


@query(
    "src3_hidden_paths",
    f"WITH {PAGE_PATHS_SQL} SELECT page_id, path FROM page_paths "
    "WHERE NOT list_bool_or(list_transform(string_split(path, '/'), lambda s: s LIKE '.%')) "
    "AND NOT list_contains(string_split(path, '/')[:-2], '__pycache__')",
)
def src3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page_paths(spark, sf_dir).filter(~is_hidden(F.col("path")))


@query(
    "src4_stems",
    f"WITH {NAMES_SQL} SELECT name, regexp_replace(t, '(?i)\\.?' || ext || '$', '') AS stem "
    "FROM classed WHERE ext IS NOT NULL",
)
def src4(spark: SparkSession, sf_dir: str) -> DataFrame:
    classed = _names(spark, sf_dir).withColumn("ext", extension(F.col("name")))
    return classed.filter(F.col("ext").isNotNull()).select(
        "name", stem_of(F.col("name"), F.col("ext")).alias("stem")
    )


@query(
    "src5_folders",
    f"WITH {PAGE_PATHS_SQL} SELECT page_id, array_to_string(string_split(path, '/')[:-2], '/') AS folder "
    "FROM page_paths",
)
def src5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page_paths(spark, sf_dir).select("page_id", folder_of(F.col("path")).alias("folder"))


@query(
    "src6_decode",
    "SELECT doc_id, md5(CASE WHEN lang = 'en' THEN text ELSE chr(8220) || "
    "regexp_replace(text, '[^\\x00-\\xff]', '?', 'g') || chr(8221) END) AS digest FROM documents",
)
def src6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English texts as UTF-8 with a mark and CR LF, the others as Windows-1252 between curly quotes."""
    utf8 = F.concat(
        F.unhex(F.lit("EFBBBF")), F.encode(F.regexp_replace("text", "\n", "\r\n"), "UTF-8")
    )
    # Characters outside the code page are written as '?'.
    narrow = F.encode(F.regexp_replace("text", "[^\u0000-ÿ]", "?"), "ISO-8859-1")
    legacy = F.concat(F.unhex(F.lit("93")), narrow, F.unhex(F.lit("94")))
    content = F.when(F.col("lang") == "en", utf8).otherwise(legacy)
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.md5(decode_text(content)).alias("digest")
    )


@query(
    "src7_size_guard",
    f"SELECT {sql.PATH} AS path, 'ValueError: too large' AS message FROM documents "
    "WHERE n_chars * n_chars > 8 * 1024 * 1024",
)
def src7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes are the square of the text length, so that long documents exceed the guard."""
    docs = table(spark, sf_dir, "documents")
    return oversized(
        docs.select(
            doc_path().alias("path"),
            (F.col("n_chars") * F.col("n_chars")).alias("size"),
            F.lit(True).alias("readable"),
        )
    )


def _page_text() -> F.Column:
    """A page as a text file with a header in one of the two accepted spellings."""
    title = F.regexp_extract("html", "<title>(.*?)</title>", 1)
    newer = F.startswith("url", F.lit("https"))
    return F.concat(
        F.when(newer, "Title: ").otherwise(" title : "),
        title,
        F.when(newer, "\nURL: ").otherwise("\ntitleUrl:"),
        "url",
        F.lit("\n\n"),
        "html",
    )


PAGE_TEXT_SQL = """page_text AS (
  SELECT page_id, CASE WHEN url LIKE 'https%' THEN 'Title: ' ELSE ' title : ' END
    || regexp_extract(html, '<title>(.*?)</title>', 1)
    || CASE WHEN url LIKE 'https%' THEN chr(10) || 'URL: ' ELSE chr(10) || 'titleUrl:' END
    || url || chr(10) || chr(10) || html AS text FROM pages)"""


@query(
    "src8_txt_headers",
    f"WITH {PAGE_TEXT_SQL} SELECT page_id, {sql.header('text', 'Title', 'title')} AS title, "
    f"{sql.header('text', 'URL', 'titleUrl')} AS url FROM page_text",
)
def src8(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", _page_text().alias("text"))
    return pages.select(
        "page_id", txt_title(F.col("text")).alias("title"), txt_url(F.col("text")).alias("url")
    )


TURN_SQL = """turns AS (
  SELECT conv_id, turn, CASE role WHEN 'user' THEN '*' || chr(10) || '## ' || text
    WHEN 'assistant' THEN chr(10) || '- ' || role || chr(10) || '#' || chr(10) || text
    ELSE chr(10) || text END AS text FROM conversations)"""


@query(
    "src9_md_titles",
    f"WITH {TURN_SQL} SELECT conv_id, turn, {sql.md_title('text')} AS title FROM turns",
)
def src9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as Markdown: with a heading, with a list before the text, or plain."""
    text = (
        F.when(F.col("role") == "user", F.concat(F.lit("*\n## "), "text"))
        .when(F.col("role") == "assistant", F.concat(F.lit("\n- "), "role", F.lit("\n#\n"), "text"))
        .otherwise(F.concat(F.lit("\n"), "text"))
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", text.alias("text"))
    return turns.select("conv_id", "turn", md_title(F.col("text")).alias("title"))


@query("src10_title_fallback", f"WITH {sql.DOCS} SELECT path, title FROM docs")
def src10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("path", doc_path())
    name = base_name(F.col("path"))
    ext = extension(name)
    return docs.select("path", title_of(F.col("text"), ext, stem_of(name, ext)).alias("title"))


@query(
    "src11_document_rows",
    f"WITH {sql.DOCS} SELECT path, size, ext, title, folder, stem, url, md5(body) AS body_digest, "
    "1704067200 + doc_id AS mtime FROM docs",
)
def src11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_view(spark, sf_dir).select(
        "path",
        "size",
        "ext",
        "title",
        "folder",
        "stem",
        "url",
        F.md5("body").alias("body_digest"),
        F.unix_seconds("mtime").alias("mtime"),
    )


@query(
    "src12_document_sink",
    f"WITH {sql.DOCS} SELECT path, size, title, md5(body) AS body_digest FROM docs WHERE ext = 'md'",
)
def src12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the document table and read one extension back; the filter prunes directories."""
    docs = corpus_view(spark, sf_dir)
    path = _scratch(spark, "sink") + "/" + sf_dir.strip("/").replace("/", "-")
    write_documents(docs, path, shard_count(listed_bytes(docs)))
    return (
        spark.read.parquet(path)
        .filter(F.col("ext") == "md")
        .select("path", "size", "title", F.md5("body").alias("body_digest"))
    )


@query(
    "tok1_tokenize",
    f"SELECT doc_id, len({sql.tokens('text')}) AS n, md5(array_to_string({sql.tokens('text')}, ' ')) AS digest "
    "FROM documents",
)
def tok1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", tokens(F.col("text")).alias("t"))
    return docs.select(
        "doc_id", F.size("t").cast("bigint").alias("n"), F.md5(F.array_join("t", " ")).alias("digest")
    )


@query(
    "tok2_postings",
    f"WITH {sql.BASE} SELECT term, field, count(DISTINCT path) AS n_docs, count(*) AS n_hits, "
    "CAST(sum(pos) AS BIGINT) AS pos_sum FROM tok GROUP BY term, field",
)
def tok2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The postings of the whole corpus, summed up per term and field."""
    rows = postings(corpus_view(spark, sf_dir))
    return rows.groupBy("term", "field").agg(
        F.count("*").alias("n_docs"),
        F.sum(F.size("positions")).alias("n_hits"),
        F.sum(F.aggregate("positions", F.lit(0).cast("bigint"), lambda a, p: a + p)).alias("pos_sum"),
    )


@query(
    "tok2_token_rows",
    f"WITH {sql.BASE} SELECT path, field, CAST(max(pos) AS INTEGER) AS last_pos, count(*) AS n, "
    "CAST(sum((pos + 1) * length(term)) AS BIGINT) AS mixed FROM tok GROUP BY path, field",
)
def tok2_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = token_rows(indexed(spark, sf_dir).postings)
    return rows.groupBy("path", "field").agg(
        F.max("pos").alias("last_pos"),
        F.count("*").alias("n"),
        F.sum((F.col("pos") + 1) * F.length("term")).cast("bigint").alias("mixed"),
    )


@query("tok3_doc_lengths", f"WITH {sql.BASE} SELECT path, dl FROM lens")
def tok3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_lengths(corpus_view(spark, sf_dir))


@query(
    "tok3_corpus_stats",
    f"WITH {sql.BASE} SELECT n_docs, CAST(n_tokens AS BIGINT) AS n_tokens, "
    "round(n_tokens / n_docs, 6) AS avgdl FROM stats",
)
def tok3_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = corpus_stats(corpus_view(spark, sf_dir))
    return stats.select(
        "n_docs", "n_tokens", F.round(F.col("n_tokens") / F.col("n_docs"), 6).alias("avgdl")
    )
