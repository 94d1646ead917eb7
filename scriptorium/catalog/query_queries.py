"""Registered queries: predicates, ranking, joins and aggregations of a search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.catalog import sql
from scriptorium.catalog.inputs import indexed, table
from scriptorium.catalog.sql import leaf, matches_sql
from scriptorium.plans.batch import score_many, search_many
from scriptorium.operators.export import to_envelope
from scriptorium.operators.filters import keep_tagged
from scriptorium.operators.match import candidates, document_frequencies
from scriptorium.operators.query import (
    Node,
    all_of,
    any_of,
    but_not,
    describe,
    phrase,
    prefix,
    tag,
    terms,
    word,
)
from scriptorium.operators.tags import tags_of
from scriptorium.plans.search import score_matches, search

QUERIES: dict = {}
SQL: dict[str, str] = {}


def rounded(score: Column | str = "score") -> Column:
    return (F.round(score, 6) + 0.0).alias("score")


def matching(
    name: str,
    tree: Node,
    leaves: list[str],
    match: str,
    gates: list[str | None],
    where: str = "",
    tags: bool = False,
    **options,
) -> None:
    """Register a query that returns every match with its score."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = score_matches(indexed(spark, sf_dir), tree, **options)
        return found.select("path", "ext", rounded())

    run.__doc__ = f"All documents for: {tree}"
    QUERIES[name] = run
    SQL[name] = matches_sql(leaves, match, gates, where, tags)


TAGGED = "path IN (SELECT path FROM document_tags WHERE name_key = '{}')"

matching("prd1_word", word("Réaux"), [leaf(["reaux"])], "m0", ["true"])
matching("prd2_compound_word", word("the-of"), [leaf(["the", "of"])], "m0", ["true"])
matching("prd3_phrase", phrase("en, la"), [leaf(["en", "la"])], "m0", ["true"])
matching("prd3_phrase_repeat", phrase("the of the"), [leaf(["the", "of", "the"])], "m0", ["true"])
matching("prd4_prefix", prefix("Thé"), [leaf(["the"], prefix=True)], "m0", ["true"])
matching("prd4_prefix_short", prefix("z"), [leaf(["z"], prefix=True)], "m0", ["true"])
matching("prd4_phrase_prefix", prefix("the th"), [leaf(["the", "th"], prefix=True)], "m0", ["true"])
matching("prd5_field_title", word("the", "Title"), [leaf(["the"], field="title")], "m0", ["true"])
matching("prd5_field_folder", word("src3", "folder"), [leaf(["src3"], field="folder")], "m0", ["true"])
matching("prd5_field_stem", prefix("17", "path"), [leaf(["17"], True, "stem")], "m0", ["true"])
matching(
    "prd6_and",
    all_of("ing", "ti", "src3"),
    [leaf(["ing"]), leaf(["ti"]), leaf(["src3"])],
    "m0 AND m1 AND m2",
    ["m0 AND m1 AND m2"] * 3,
)
matching(
    "prd7_or",
    any_of("ing", phrase("de la"), "ther"),
    [leaf(["ing"]), leaf(["de", "la"]), leaf(["ther"])],
    "m0 OR m1 OR m2",
    ["true"] * 3,
)
matching(
    "prd8_not",
    but_not("the", "of"),
    [leaf(["the"]), leaf(["of"])],
    "m0 AND NOT m1",
    ["m0 AND NOT m1", None],
)
matching(
    "prd9_nested",
    any_of(all_of("ing", but_not("the", "ther")), but_not(any_of("schen", "que"), word("de", "title"))),
    [leaf(["ing"]), leaf(["the"]), leaf(["ther"]), leaf(["schen"]), leaf(["que"]), leaf(["de"], field="title")],
    "(m0 AND m1 AND NOT m2) OR ((m3 OR m4) AND NOT m5)",
    ["m0 AND m1 AND NOT m2", "m0 AND m1 AND NOT m2", None, "(m3 OR m4) AND NOT m5", "(m3 OR m4) AND NOT m5", None],
)
matching(
    "prd9_repeated_leaf",
    all_of("ing", "ing"),
    [leaf(["ing"]), leaf(["ing"])],
    "m0 AND m1",
    ["true", "true"],
)
matching(
    "prd10_default_or",
    terms(["ing", but_not("ti", "ther")], "OR"),
    [leaf(["ing"]), leaf(["ti"]), leaf(["ther"])],
    "m0 OR (m1 AND NOT m2)",
    ["true", "m1 AND NOT m2", None],
)
matching(
    "prd10_default_and",
    terms(["ing", "ti"], "AND"),
    [leaf(["ing"]), leaf(["ti"])],
    "m0 AND m1",
    ["true", "true"],
)
matching(
    "prd13_tag_and_keyword",
    all_of(tag("EN"), any_of("ing", "ti")),
    [leaf(["ing"]), leaf(["ti"])],
    "m0 OR m1",
    ["true", "true"],
    f"WHERE {TAGGED.format('en')}",
    True,
)
matching(
    "prd13_keyword_not_tag",
    but_not("the", any_of(tag("toxic"), tag("Quality"))),
    [leaf(["the"])],
    "m0",
    ["true"],
    f"WHERE NOT {TAGGED.format('toxic')} AND NOT {TAGGED.format('quality')}",
    True,
)
matching(
    "prd14_required_tags",
    word("the"),
    [leaf(["the"])],
    "m0",
    ["true"],
    f"WHERE {TAGGED.format('quality')} AND {TAGGED.format('toxic')}",
    True,
    require_tags=("Toxic", "quality"),
)
matching(
    "prd15_extension", word("the"), [leaf(["the"])], "m0", ["true"], "WHERE ext = 'md'", ext="MD"
)
matching(
    "prd16_subtree",
    word("the"),
    [leaf(["the"])],
    "m0",
    ["true"],
    "WHERE starts_with(lower(path), 'src1/')",
    under="SRC1/",
)
matching(
    "prd18_no_token_or",
    any_of("ing", phrase("-")),
    [leaf(["ing"])],
    "m0",
    ["true"],
)
matching(
    "prd18_no_token_and", any_of("ing", all_of("the", phrase("..."))), [leaf(["ing"])], "m0", ["true"]
)
matching("prd18_no_token_not", but_not("ing", phrase("...")), [leaf(["ing"])], "m0", ["true"])
matching("rnk1_bm25", any_of("ing", "la", "und"), [leaf([t]) for t in ("ing", "la", "und")], "m0 OR m1 OR m2", ["true"] * 3)


def query(name: str, oracle: str | None = None):
    def register(function):
        QUERIES[name] = function
        if oracle is not None:
            SQL[name] = oracle
        return function

    return register


def _top(leaves: list[str], match: str, gates: list, k: int, columns: str, where: str = "", more: str = "") -> str:
    """SQL for the first k matches joined to their documents."""
    return (
        f"WITH {sql.BASE}, {sql.TAGS}, {sql.scored_cte(leaves, match, gates)}, top AS ("
        f"SELECT path, score, row_number() OVER (ORDER BY score, path) AS rank FROM scored {where} "
        f"ORDER BY score, path LIMIT {k}){more} SELECT {columns} FROM top JOIN docs USING (path)"
    )


FLAGSHIP = but_not(any_of("ing", "ti"), "ther")
FLAGSHIP_LEAVES = [leaf(["ing"]), leaf(["ti"]), leaf(["ther"])]
FLAGSHIP_MATCH = "(m0 OR m1) AND NOT m2"
FLAGSHIP_GATES = [FLAGSHIP_MATCH, FLAGSHIP_MATCH, None]


@query(
    "flagship_search",
    _top(FLAGSHIP_LEAVES, FLAGSHIP_MATCH, FLAGSHIP_GATES, 20, f"CAST(rank AS INTEGER) AS rank, {sql.SCORE}, path, title, docs.ext"),
)
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = search(indexed(spark, sf_dir), FLAGSHIP)
    return hits.select("rank", rounded(), "path", "title", "ext")


@query(
    "tok4_document_frequency",
    f"WITH {sql.BASE} SELECT 'word' AS leaf, count(*) AS n FROM ({leaf(['the'])}) "
    f"UNION ALL SELECT 'phrase', count(*) FROM ({leaf(['of', 'the'])}) "
    f"UNION ALL SELECT 'prefix', count(*) FROM ({leaf(['ing'], True)}) "
    f"UNION ALL SELECT 'title', count(*) FROM ({leaf(['the'], field='title')})",
)
def tok4(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = any_of("the", phrase("of the"), prefix("ing"), word("the", "title"))
    corpus = indexed(spark, sf_dir)
    wide = document_frequencies(candidates(corpus.postings, tree, corpus.shards))
    return wide.selectExpr("stack(4, 'word', f0, 'phrase', f1, 'prefix', f2, 'title', f3) AS (leaf, n)")


def _tagged_only(name: str, tree: Node, where: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return score_matches(indexed(spark, sf_dir), tree).select("path", "ext", rounded())

    run.__doc__ = f"All documents for: {tree}"
    QUERIES[name] = run
    SQL[name] = f"WITH {sql.DOCS}, {sql.TAGS} SELECT path, ext, 0.0::DOUBLE AS score FROM docs WHERE {where}"


_tagged_only("prd11_tag", tag("Toxic"), TAGGED.format("toxic"))
_tagged_only(
    "prd12_tag_boolean",
    any_of(but_not(tag("fr"), tag("quality")), all_of(tag("DE"), tag("QUALITY")), tag("toxic")),
    f"({TAGGED.format('fr')} AND NOT {TAGGED.format('quality')}) OR "
    f"({TAGGED.format('de')} AND {TAGGED.format('quality')}) OR {TAGGED.format('toxic')}",
)


@query(
    "prd11_unknown_tag_or_known",
    f"WITH {sql.DOCS}, {sql.TAGS} SELECT path FROM docs WHERE {TAGGED.format('es')}",
)
def unknown_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tag nobody created matches nothing and is not an error inside a query."""
    return score_matches(indexed(spark, sf_dir), any_of(tag("nope"), tag("ES"))).select("path")


@query(
    "prd12_tag_not_alone",
    f"WITH {sql.DOCS}, {sql.TAGS} SELECT path FROM docs WHERE path NOT IN "
    "(SELECT path FROM document_tags WHERE name_key = 'en')",
)
def not_tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scriptorium.operators.query import ButNot, Everything

    corpus = indexed(spark, sf_dir)
    return keep_tagged(
        corpus.documents.select("path"), corpus.document_tags, ButNot(Everything(), tag("en"))
    )


@query(
    "prd20_hit_columns",
    _top([leaf(["schen"])], "m0", ["true"], 10_000, f"path, title, docs.ext, url, {sql.SCORE}"),
)
def hit_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = search(indexed(spark, sf_dir), "schen", limit=10_000, snippets=False)
    return hits.select("path", "title", "ext", "url", rounded())


@query(
    "rnk2_tag_only",
    f"WITH {sql.DOCS}, {sql.TAGS} SELECT CAST(row_number() OVER (ORDER BY path) AS INTEGER) AS rank, "
    f"path, title, '' AS snippet, 0.0::DOUBLE AS score FROM docs WHERE {TAGGED.format('es')} ORDER BY path LIMIT 50",
)
def tag_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = search(indexed(spark, sf_dir), tag("es"), limit=50)
    return hits.select("rank", "path", "title", "snippet", rounded())


@query(
    "rnk3_top_k",
    _top([leaf(["the"]), leaf(["ing"])], "m0 OR m1", ["true", "true"], 100, f"path, {sql.SCORE}"),
)
def top_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = search(indexed(spark, sf_dir), any_of("the", "ing"), limit=100, snippets=False)
    return hits.select("path", rounded())


@query(
    "rnk4_rank",
    _top([leaf(["de", "la"])], "m0", ["true"], 200, "CAST(rank AS INTEGER) AS rank, path"),
)
def ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = search(indexed(spark, sf_dir), phrase("de la"), limit=200, snippets=False)
    return hits.select("rank", "path")


@query(
    "rnk8_absolute_path",
    _top([leaf(["ing"])], "m0", ["true"], 20, "path, '/data/corpus/' || path AS abs_path"),
)
def absolute(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = search(indexed(spark, sf_dir), "ing", root="/data/corpus/", snippets=False)
    return hits.select("path", "abs_path")


@query(
    "rnk9_hit_tags",
    _top(
        [leaf(["the"])],
        "m0",
        ["true"],
        100,
        "path, array_to_string(coalesce(names, []), ',') AS tags",
        more=", named AS (SELECT dt.path, list(t.name ORDER BY t.name_key) AS names FROM document_tags dt "
        "JOIN tags t USING (name_key) GROUP BY dt.path)",
    ).replace("FROM top JOIN docs USING (path)", "FROM top JOIN docs USING (path) LEFT JOIN named USING (path)"),
)
def hit_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = search(indexed(spark, sf_dir), "the", limit=100, snippets=False)
    return hits.select("path", F.array_join("tags", ",").alias("tags"))


@query(
    "jn5_agg2_tags_per_path",
    f"WITH {sql.TAGS} SELECT dt.path, array_to_string(list(t.name ORDER BY t.name_key), ',') AS tags FROM document_tags dt "
    "JOIN tags t USING (name_key) GROUP BY dt.path",
)
def tags_per_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = indexed(spark, sf_dir)
    found = tags_of(corpus.document_tags, corpus.tags, ["path"])
    return found.select("path", F.array_join("tags", ",").alias("tags"))


@query(
    "agg4_weighted_frequency",
    f"WITH {sql.BASE} SELECT path, sum(CASE WHEN term = 'the' THEN w ELSE 0 END)::DOUBLE AS the, "
    "sum(CASE WHEN term = 'of' AND field = 'title' THEN w ELSE 0 END)::DOUBLE AS of_title "
    "FROM tok WHERE term IN ('the', 'of') GROUP BY path",
)
def weighted_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = indexed(spark, sf_dir)
    wide = candidates(corpus.postings, any_of("the", word("of", "title")), corpus.shards)
    return wide.select("path", F.col("f0").alias("the"), F.col("f1").alias("of_title"))


def _clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query per benchmark item: one of all its three-word phrases, and its first word or the prefix of its last,
    but not 'que'."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), words.alias("t"))

    def clause(slot: int, alt: int | Column, kind: str, value: Column, negated: bool = False) -> Column:
        return F.struct(
            F.lit(slot).alias("slot"),
            F.lit(alt).cast("int").alias("alt"),
            F.lit(kind).alias("kind"),
            value.alias("value"),
            F.lit(None).cast("string").alias("field"),
            F.lit(negated).alias("negated"),
        )

    phrases = F.transform(
        F.sequence(F.lit(0), F.floor((F.size("t") - 1) / 3).cast("int")),
        lambda k: clause(0, k, "phrase", F.array_join(F.slice("t", 3 * k + 1, F.lit(3)), " ")),
    )
    made = F.concat(
        phrases,
        F.array(
            clause(1, 0, "word", F.get("t", F.lit(0))),
            clause(1, 1, "prefix", F.substring(F.element_at("t", -1), 1, 3)),
            clause(2, 0, "word", F.lit("que"), True),
        ),
    )
    return items.select("query_id", F.explode(made).alias("c")).select("query_id", "c.*")


_BATCH = f"""WITH {sql.BASE},
items AS (SELECT item_id AS query_id, regexp_extract_all(lower(strip_accents(text)), '[\\p{{L}}\\p{{N}}]+') AS t FROM benchmark),
threes AS (SELECT query_id, k AS s, t[3 * k + 1] AS t1, t[3 * k + 2] AS t2, t[3 * k + 3] AS t3
  FROM (SELECT query_id, t, unnest(range((len(t) + 2) // 3)) AS k FROM items)),
p0 AS (SELECT s, query_id, a.path, CAST(sum(a.w) AS DOUBLE) AS f FROM threes JOIN tok a ON a.term = t1
  LEFT JOIN tok b ON b.path = a.path AND b.field = a.field AND b.pos = a.pos + 1 AND b.term = t2
  LEFT JOIN tok c ON c.path = a.path AND c.field = a.field AND c.pos = a.pos + 2 AND c.term = t3
  WHERE (t2 IS NULL OR b.term IS NOT NULL) AND (t3 IS NULL OR c.term IS NOT NULL) GROUP BY ALL),
p2 AS (SELECT query_id, path, CAST(sum(w) AS DOUBLE) AS f FROM items JOIN tok ON term = t[1] GROUP BY ALL),
p3 AS (SELECT query_id, path, CAST(sum(w) AS DOUBLE) AS f FROM items JOIN tok ON starts_with(term, left(t[-1], 3)) GROUP BY ALL),
parts AS (FROM p0 UNION ALL SELECT 1000, * FROM p2 UNION ALL SELECT 1001, * FROM p3),
counts AS (SELECT s, query_id, count(*) AS n FROM parts GROUP BY ALL),
terms AS (SELECT s, query_id, path, f, ln((n_docs - n + 0.5) / (n + 0.5)) AS raw, dl, n_docs, n_tokens
  FROM parts JOIN counts USING (s, query_id) JOIN lens USING (path), stats),
sums AS (SELECT query_id, path, max(s < 1000) AS a, max(s >= 1000) AS b,
  sum((CASE WHEN raw <= 0 THEN 1e-6 ELSE raw END) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / (n_tokens / n_docs)))) AS total
  FROM terms GROUP BY ALL),
scored AS (SELECT query_id, path, 0 - total AS score FROM sums
  WHERE a AND b AND path NOT IN (SELECT path FROM tok WHERE term = 'que'))"""


@query("prd21_batched_search", f"{_BATCH} SELECT query_id, path, {sql.SCORE} FROM scored")
def batched(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = score_many(indexed(spark, sf_dir), _clauses(spark, sf_dir))
    return found.select("query_id", "path", rounded())


@query(
    "rnk6_top_k_per_query",
    f"{_BATCH} SELECT query_id, CAST(r AS INTEGER) AS rank, path, {sql.SCORE} FROM (SELECT *, row_number() OVER "
    "(PARTITION BY query_id ORDER BY round(score, 9), path) AS r FROM scored) WHERE r <= 5",
)
def batched_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search_many(indexed(spark, sf_dir), _clauses(spark, sf_dir), 5)
    return found.select("query_id", "rank", "path", rounded())


RAW = r"[\p{L}\p{N}\p{Co}][\p{L}\p{N}\p{Co}\x{300}-\x{36f}]*"


def _snippet_cte(words: list[str], k: int) -> str:
    """The window rule for single words, as joins between instances; ends in ``snip(path, snippet)``."""
    numbered = " ".join(f"WHEN '{w}' THEN {i}" for i, w in enumerate(words))
    return f""", bodies AS (
  SELECT path, score, rank, regexp_extract_all(body, '{RAW}') AS raw, string_split_regex(body, '{RAW}') AS gaps
  FROM top JOIN docs USING (path)),
words AS (SELECT path, unnest(range(len(raw))) AS p, unnest(raw) AS w, unnest(gaps[1:len(raw)]) AS gap FROM bodies),
inst AS (SELECT path, p AS o, CASE lower(strip_accents(w)) {numbered} END AS leaf FROM words
  WHERE lower(strip_accents(w)) IN ({', '.join(f"'{w}'" for w in words)})),
begins AS (SELECT path, p AS s FROM words WHERE p = 0 OR regexp_matches(gap, '[.:][ \\t\\n\\r]+$')),
points AS (SELECT i.path, i.o, 0 AS kind, i.o AS at FROM inst i UNION ALL
  SELECT i.path, i.o, 1, max(b.s) FROM inst i JOIN begins b ON b.path = i.path AND b.s <= i.o GROUP BY i.path, i.o),
rated AS (SELECT p.path, p.o, kind, p.at, count(DISTINCT leaf) * 1000 + count(leaf) - count(DISTINCT leaf) AS pts,
    min(i.o) AS lo, max(i.o) + 1 AS hi
  FROM points p LEFT JOIN inst i ON i.path = p.path AND i.o >= p.at AND i.o < p.at + 16 GROUP BY ALL),
chosen AS (SELECT r.path, len(raw) AS n,
    CASE kind WHEN 1 THEN r.at ELSE greatest(least(lo - CAST(trunc((16 - (hi - lo)) / 2) AS BIGINT), len(raw) - 16), 0) END AS b,
    row_number() OVER (PARTITION BY r.path ORDER BY
      pts + CASE WHEN kind = 0 THEN 0 WHEN r.at = 0 THEN 120 ELSE 100 END DESC, o, kind) AS nth
  FROM rated r JOIN bodies USING (path) WHERE kind = 0 OR (len(raw) > 16 AND r.at < o)),
win AS (SELECT bodies.*, coalesce(b, 0) AS b, least(coalesce(b, 0) + 16, len(raw)) AS e
  FROM bodies LEFT JOIN (SELECT * FROM chosen WHERE nth = 1) USING (path)),
snip AS (SELECT path, (CASE WHEN b > 0 THEN '…' ELSE '' END) || coalesce((SELECT string_agg(
      (CASE WHEN p > b OR p = 0 THEN gap ELSE '' END) || CASE WHEN lower(strip_accents(w)) IN ({', '.join(f"'{w}'" for w in words)})
        THEN '>>' || w || '<<' ELSE w END, '' ORDER BY p) FROM words WHERE words.path = win.path AND p >= b AND p < e), '')
    || CASE WHEN e < len(raw) THEN '…' ELSE gaps[-1] END AS snippet FROM win)"""


@query(
    "rnk5_snippets",
    _top(
        FLAGSHIP_LEAVES, FLAGSHIP_MATCH, FLAGSHIP_GATES, 1000, "path, snip.snippet",
        more=_snippet_cte(["ing", "ti"], 1000),
    ).replace("JOIN docs USING (path)", "JOIN docs USING (path) JOIN snip USING (path)").replace(
        "FROM top JOIN docs USING (path) JOIN snip USING (path)),", "FROM top JOIN docs USING (path)),"
    ),
)
def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(indexed(spark, sf_dir), FLAGSHIP, limit=1000).select("path", "snippet")


@query(
    "rnk7_snippet_off",
    _top([leaf(["ther"])], "m0", ["true"], 50, "path, title, '' AS snippet"),
)
def no_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = search(indexed(spark, sf_dir), "ther", limit=50, snippets=False)
    return hits.select("path", "title", "snippet")


@query(
    "rnk7_title_only_hit",
    _top(
        [leaf(["17"], True, "stem")], "m0", ["true"], 1000, "path, snip.snippet",
        more=_snippet_cte(["\x01"], 1000),
    ).replace("FROM top JOIN docs USING (path)", "FROM top JOIN docs USING (path) JOIN snip USING (path)").replace(
        "FROM top JOIN docs USING (path) JOIN snip USING (path)),", "FROM top JOIN docs USING (path)),"
    ),
)
def title_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hit outside the body shows the start of the body, nothing marked."""
    return search(indexed(spark, sf_dir), prefix("17", "path"), limit=1000).select("path", "snippet")


@query(
    "src13_json_export",
    _top(
        FLAGSHIP_LEAVES, FLAGSHIP_MATCH, FLAGSHIP_GATES, 20,
        "CAST(to_json({'query': 'ing|ti -ther', 'fts5': 'but_not(any_of(word(''ing''), word(''ti'')), word(''ther''))', 'limit': 20, 'hits': list({"
        "'rank': rank, 'score': round(score, 3) + 0.0, 'path': path, 'abs_path': '/c/' || path, 'title': title, "
        "'ext': docs.ext, 'url': url, 'snippet': snip.snippet, 'tags': names} ORDER BY rank)}) AS VARCHAR) AS json",
        more=_snippet_cte(["ing", "ti"], 20)
        + ", named AS (SELECT dt.path, list(t.name ORDER BY t.name_key) AS names FROM document_tags dt "
        "JOIN tags t USING (name_key) GROUP BY dt.path)",
    ).replace("FROM top JOIN docs USING (path)", "FROM top JOIN docs USING (path) JOIN snip USING (path) JOIN named USING (path)").replace(
        "FROM top JOIN docs USING (path) JOIN snip USING (path) JOIN named USING (path)),", "FROM top JOIN docs USING (path)),"
    ),
)
def json_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = search(indexed(spark, sf_dir), FLAGSHIP, root="/c")
    return to_envelope(hits, "ing|ti -ther", describe(FLAGSHIP), 20)
