"""Text of the equivalent SQL: shared common table expressions and a generator for ranked queries."""

from __future__ import annotations

from scriptorium.functions.text import WEIGHTS

LINES = r"[\n\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
WS = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
TOKEN = r"[\p{L}\p{N}\p{Co}]+"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def header(text: str, *keys: str) -> str:
    lines = f"string_split_regex({text}, '{LINES}')[1:30]"
    pairs = (
        f"list_transform(list_filter({lines}, lambda l: contains(l, ':')), lambda l: "
        f"struct_pack(k := {strip("split_part(l, ':', 1)")}, "
        f"v := {strip("substr(l, instr(l, ':') + 1)")}))"
    )
    found = [f"list_filter({pairs}, lambda p: p.k = '{k}' AND p.v <> '')[1].v" for k in keys]
    return f"coalesce({', '.join(found)})"


def md_title(text: str) -> str:
    lines = f"string_split_regex({text}, '{LINES}')[1:40]"
    heads = (
        f"list_filter(list_transform({lines}, lambda l: "
        f"{strip(f"regexp_extract(l, '^#{{1,6}}{WS}+(.*)', 1)")}), lambda h: h <> '')[1]"
    )
    plain = (
        f"list_filter(list_transform({lines}, lambda l: {strip('l')}), "
        f"lambda s: s <> '' AND left(s, 1) NOT IN ('*', '-'))[1]"
    )
    return f"coalesce({heads}, {plain})"


def tokens(x: str) -> str:
    return f"regexp_extract_all(lower(strip_accents({x})), '{TOKEN}')"


EXT = "CASE WHEN doc_id % 2 = 0 THEN 'txt' ELSE 'md' END"
PATH = f"source || '/' || doc_id || '.' || {EXT}"


def documents_cte(name: str, source: str, text: str = "text") -> str:
    return f"""{name} AS (
  SELECT doc_id, lang, source, {PATH} AS path, {EXT} AS ext, CAST(strlen({text}) AS BIGINT) AS size,
    coalesce(CASE WHEN {EXT} = 'txt' THEN {header(text, 'Title', 'title')} ELSE {md_title(text)} END,
      CAST(doc_id AS VARCHAR)) AS title,
    source AS folder, CAST(doc_id AS VARCHAR) AS stem,
    CASE WHEN {EXT} = 'txt' THEN {header(text, 'URL', 'titleUrl')} END AS url, {text} AS body
  FROM {source})"""


DOCS = documents_cte("docs", "documents")


def fields_cte(docs: str = "docs", name: str = "fields") -> str:
    parts = [
        f"SELECT path, ext, '{f}' AS field, {w} AS w, {tokens(f)} AS toks FROM {docs}"
        for f, w in WEIGHTS.items()
    ]
    return f"{name} AS ({' UNION ALL '.join(parts)})"


TOK = """tok AS (
  SELECT path, ext, field, w, unnest(toks) AS term, unnest(range(len(toks))) AS pos FROM fields)"""
LEN = "lens AS (SELECT path, ext, CAST(sum(len(toks)) AS BIGINT) AS dl FROM fields GROUP BY path, ext)"
STATS = "stats AS (SELECT count(*) AS n_docs, sum(dl) AS n_tokens FROM lens)"
BASE = ", ".join([DOCS, fields_cte(), TOK, LEN, STATS])

TAGS = f"""roles AS (SELECT DISTINCT upper(left(role, 1)) || lower(substr(role, 2)) AS name FROM conversations),
tags AS (
  SELECT name, lower(name) AS name_key FROM (
    SELECT upper(lang) AS name FROM documents UNION SELECT name FROM roles
    UNION SELECT 'Quality' FROM labels WHERE quality = 1 UNION SELECT 'Toxic' FROM labels WHERE toxic = 1)),
document_tags AS (
  SELECT {PATH} AS path, lower(lang) AS name_key FROM documents
  UNION ALL SELECT {PATH}, 'quality' FROM documents JOIN labels USING (doc_id) WHERE quality = 1
  UNION ALL SELECT {PATH}, 'toxic' FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)"""


def leaf(tokens_: list[str], prefix: bool = False, field: str | None = None) -> str:
    """Weighted instances of one leaf per path, by self-joins on neighbouring positions."""
    joins, tests = [], []
    for i, t in enumerate(tokens_):
        if i:
            joins.append(
                f"JOIN tok t{i} ON t{i}.path = t0.path AND t{i}.field = t0.field AND t{i}.pos = t0.pos + {i}"
            )
        last = i == len(tokens_) - 1
        tests.append(f"starts_with(t{i}.term, '{t}')" if prefix and last else f"t{i}.term = '{t}'")
    if field:
        tests.append(f"t0.field = '{field}'")
    return (
        f"SELECT t0.path, CAST(sum(t0.w) AS DOUBLE) AS f FROM tok t0 {' '.join(joins)} "
        f"WHERE {' AND '.join(tests)} GROUP BY t0.path"
    )


def scored_cte(leaves: list[str], match: str, gates: list[str | None], name: str = "scored") -> str:
    """CTEs that end in ``name(path, ext, score)``. ``gates[i]`` is the condition for leaf i to count.

    In ``match`` and ``gates``, ``m0, m1, ...`` say whether the leaf occurs in the document.
    """
    parts = [f"l{i} AS ({sql})" for i, sql in enumerate(leaves)]
    columns = ", ".join(f"coalesce(l{i}.f, 0) AS f{i}, l{i}.f IS NOT NULL AS m{i}" for i in range(len(leaves)))
    joins = " ".join(f"LEFT JOIN l{i} ON l{i}.path = lens.path" for i in range(len(leaves)))
    counts = ", ".join(f"(SELECT count(*) FROM l{i}) AS n{i}" for i in range(len(leaves)))
    parts.append(f"wide AS (SELECT lens.path, lens.ext, lens.dl, {columns} FROM lens {joins})")
    parts.append(f"freq AS (SELECT {counts})")

    def term(i: int, gate: str) -> str:
        raw = f"ln((n_docs - n{i} + 0.5) / (n{i} + 0.5))"
        idf = f"(CASE WHEN {raw} <= 0 THEN 1e-6 ELSE {raw} END)"
        norm = "(f{0} + 1.2 * (0.25 + 0.75 * dl / (n_tokens / n_docs)))".format(i)
        return f"(CASE WHEN ({gate}) AND m{i} THEN {idf} * f{i} * 2.2 / {norm} ELSE 0 END)"

    total = " + ".join(term(i, g) for i, g in enumerate(gates) if g is not None)
    parts.append(
        f"{name} AS (SELECT path, ext, 0 - ({total}) AS score FROM wide, freq, stats WHERE {match})"
    )
    return ", ".join(parts)


SCORE = "round(score, 6) + 0.0 AS score"


def matches_sql(leaves: list[str], match: str, gates: list[str | None], where: str = "", tags: bool = False) -> str:
    """Every match with its score."""
    ctes = ", ".join([BASE, *([TAGS] if tags else []), scored_cte(leaves, match, gates)])
    return f"WITH {ctes} SELECT path, ext, {SCORE} FROM scored {where}"
