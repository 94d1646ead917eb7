"""Personal data by rules, and by bootstrapped contextual extraction.

Rules find e-mail and IP addresses, card and phone numbers. The valid finds are seeds: the words around them induce
lexical patterns (two words before; the word before and after; the word before). Seeds and all tokens of 6 to 128
characters with a digit or an at sign are instances in a graph with these patterns. Seeds count 1 for their kind; tokens
that look like a kind and fail its check count 0; the rest starts at 0 and is scored in rounds:

* a pattern's confidence for a kind is the sum of its instances' scores over their number plus one, if at least
  ``min_support`` of that sum are there;
* an instance's score is the chance that one of its patterns of confidence ``min_pattern`` or more is right
  (1 minus the product of the complements).

All other tokens, of any length and with or without digits, are instances too where they stand in the slot of a pattern
that came out confident. They are scored in the same way in a second graph, in which a pattern's number counts the
distinct tokens of both: a slot that ordinary words fill as well gives them no confidence.

Instances that end at ``min_score`` or more are new identifiers, and all their occurrences become spans. Known spans
stay; new ones never overlap them.

All steps are column expressions, counts and joins on the graph; texts are read once for spans and candidates, once for
the other tokens and once more for the places of those found; they are never shuffled. A pattern with very many instances is pre-aggregated and is a skewed key that adaptive
execution splits. Regular expressions cannot backtrack over more than one token, so very long texts stay linear.

Defined cases: null and empty texts have no spans; repeated rows get the same spans; several matches that overlap across
kinds are all reported; without seeds nothing is discovered; an empty table gives no rows.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.bitmaps import NONE, bit_of, word_of
from scriptorium.llm.base import once, row_key, saved

KINDS = ("email", "ip", "card", "phone")
_LOCAL, _LABEL = "A-Za-z0-9._%+-", "A-Za-z0-9-"
#: As the plain rules, but possessive, and tried only where a run of their first characters begins.
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[{_LABEL}]++(?:\.[{_LABEL}]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_WHOLE = {kind: "^(?:" + pattern.replace(r"(?:\G|", "(?:^|") + ")$" for kind, pattern in PATTERNS.items()}
#: White space, digits and ASCII letters one by one: Java looks such a class up in one table, while a class that excludes
#: several ranges costs it a chain of calls for each character, some ten times the time.
_BLANK, _DIGIT, _LETTER = r"\t\n\x0B\f\r\x20", string.digits, string.ascii_letters
#: A phone number, a card number with blanks, or a token with a digit or an at sign.
_UNIT = (
    PATTERNS["phone"]
    + r"|(?<!\S)[0-9](?:[\x20-]?[0-9]){11,18}+(?![0-9A-Za-z])"
    + rf"|(?<!\S)[^{_BLANK}{_DIGIT}@]*+[{_DIGIT}@]\S*+"
)
#: Any token: a unit, or what else stands between blanks and such units. Most have no sign of a unit and are taken at once.
_TOKEN = rf"[^{_BLANK}{_DIGIT}@+]++(?!\S)|" + _UNIT + rf"|(?:[^{_BLANK}+]++|(?!" + PATTERNS["phone"] + r")\+)++"
#: Signs before and after a token.
_BEFORE, _AFTER = f"^[^{_LETTER}{_DIGIT}+]++", f"(?<![^{_LETTER}{_DIGIT}])[^{_LETTER}{_DIGIT}]++$"
ROUNDS, MIN_SUPPORT, MIN_PATTERN, MIN_SCORE = 3, 3.0, 0.5, 0.8
_BLOCK = 256
#: Bits of the table that tells most words before a token from those of patterns.
_BITS = 1 << 18
_CONTEXT = 64


def valid(kind: str, found: Column) -> Column:
    digits = F.regexp_replace(found, "[^0-9]", "")
    if kind == "ip":
        small = lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.right(F.concat(F.lit("000"), p), F.lit(3)).cast("int") <= 255)
        return F.forall(F.split(found, r"\."), small)
    if kind == "card":
        return F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _sums(lengths: Column) -> Column:
    """Sums of all elements before each one; linear but for blocks."""

    def block(part: Column, before: Column) -> Column:
        start = F.struct(before.alias("sum"), F.array().cast("array<int>").alias("all"))
        step = lambda acc, x: F.struct(
            (acc["sum"] + x).alias("sum"), F.concat(acc["all"], F.array(acc["sum"])).alias("all")
        )
        return F.aggregate(part, start, step, lambda acc: acc["all"])

    total = lambda part: F.aggregate(part, F.lit(0), lambda s, x: s + x)
    last = F.floor((F.size(lengths) - 1) / _BLOCK).cast("int")
    blocks = F.when(
        F.size(lengths) > 0,
        F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(lengths, b * _BLOCK + 1, F.lit(_BLOCK))),
    ).otherwise(F.array().cast("array<array<int>>"))
    return once(
        blocks,
        lambda parts: once(
            F.transform(parts, total),
            lambda sums: F.flatten(F.transform(parts, lambda part, b: block(part, total(F.slice(sums, F.lit(1), b))))),
        ),
    )


def _matches(text: Column, pattern: str) -> Column:
    """Array of (start, found, before, after): matches left to right, with the text between them and their neighbours."""

    def placed(found: Column) -> Column:
        return once(
            F.split(text, pattern, -1),
            lambda pieces: once(
                _sums(F.zip_with(F.slice(pieces, F.lit(1), F.size(found)), found, lambda p, m: F.length(p) + F.length(m))),
                lambda sums: F.transform(
                    found,
                    lambda m, i: F.struct(
                        (F.get(sums, i) + F.length(F.get(pieces, i))).alias("start"),
                        m.alias("found"),
                        F.get(pieces, i).alias("before"),
                        F.get(pieces, i + 1).alias("after"),
                    ),
                ),
            ),
        )

    return once(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


_SPANS = "array<struct<start:int,order:int,end:int,kind:string>>"


def base_spans(text: Column) -> Column:
    """Spans of the rules, by start, then kind: (start, order, end, kind) in code points, end exclusive."""
    def of(order: int, kind: str) -> Column:
        def span(m: Column) -> Column:
            end = m["start"] + F.length(m["found"])
            return F.struct(m["start"].alias("start"), F.lit(order).alias("order"), end.alias("end"), F.lit(kind).alias("kind"))

        possible = text.contains("@") if kind == "email" else text.rlike("[0-9]")
        good = F.filter(_matches(text, PATTERNS[kind]), lambda m: valid(kind, m["found"]))
        return F.when(possible, F.transform(good, span)).otherwise(F.array().cast(_SPANS))

    kinds = [of(order, kind) for order, kind in enumerate(KINDS)]
    return F.sort_array(F.concat(*kinds))


def as_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _plain(text: Column) -> Column:
    return F.translate(F.lower(text), "0123456789", "0000000000")


def _word(text: Column) -> Column:
    plain = _plain(text)
    return F.when(F.coalesce(F.length(plain), F.lit(0)) > 0, plain).otherwise("^")


def _core(token: Column) -> Column:
    """A token without the signs around it."""
    return F.regexp_replace(F.regexp_replace(token, _BEFORE, ""), _AFTER, "")


def _lead(token: Column) -> Column:
    return F.regexp_extract(token, f"^[^{_LETTER}{_DIGIT}+]*+", 0)


def _label(value: Column) -> Column:
    label = F.lit(None).cast("string")
    for kind in reversed(KINDS):
        looks = value.rlike(_WHOLE[kind])
        label = F.when(looks & valid(kind, value), kind).otherwise(F.when(label.isNull() & looks, "none").otherwise(label))
    return label


def _alike(value: Column, label: Column) -> Column:
    """Whether a token is an instance by its form: a seed, or of usual length with a digit or an at sign."""
    return F.coalesce(label.isin(*KINDS), F.lit(False)) | (F.length(value).between(6, 128) & (label.isNotNull() | value.rlike("[0-9@]")))


def units(text: Column) -> Column:
    """Identifier-like tokens: (start, end, value, label, patterns).

    ``label`` is a kind for seeds, ``none`` for tokens that fail the check of the kind they look like, null for open ones.
    """

    def unit(m: Column) -> Column:
        start = m["start"] + F.length(_lead(m["found"]))

        def described(value: Column) -> Column:
            before = F.split(F.trim(F.regexp_replace(F.right(m["before"], F.lit(_CONTEXT)), r"\s", " ")), " +")
            after = F.split(F.ltrim(F.regexp_replace(F.left(m["after"], F.lit(_CONTEXT)), r"\s", " ")), " +")
            one, two = F.get(before, F.size(before) - 1), F.get(before, F.size(before) - 2)
            patterns = F.array(
                F.concat(F.lit("2|"), _word(two), F.lit(" "), _word(one)),
                F.concat(F.lit("b|"), _word(one), F.lit(" _ "), _word(F.get(after, F.lit(0)))),
                F.concat(F.lit("1|"), _word(one)),
            )
            return F.struct(
                start.alias("start"),
                (start + F.length(value)).alias("end"),
                F.lower(value).alias("value"),
                _label(value).alias("label"),
                patterns.alias("patterns"),
            )

        return once(_core(m["found"]), described)

    found = F.transform(_matches(text, _UNIT), unit)
    useful = F.filter(found, lambda u: _alike(u["value"], u["label"]))
    return F.when(text.rlike("[0-9@]"), useful).otherwise(F.array().cast("array<struct<start:int,end:int,value:string,label:string,patterns:array<string>>>"))


def located(docs: DataFrame) -> DataFrame:
    """(row, doc_id, base, units) of every document, written to the shared folder; copies of a row share ``row``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select(row_key().alias("row"), "doc_id", text.alias("text")).select(
        "row", "doc_id", base_spans(F.col("text")).alias("base"), units(F.col("text")).alias("units")
    )
    return saved(found, "pii-located")


def _scored(open_edges: DataFrame, fixed: DataFrame, rounds: int, min_support: float, min_pattern: float) -> tuple[DataFrame, DataFrame]:
    """Scores of the values of ``open_edges``, and the confident patterns of the last round.

    ``fixed`` has the sums and the number of the instances of a pattern that keep their scores.
    """
    scores = confident = None
    for _ in range(rounds):
        scored = open_edges if scores is None else open_edges.join(scores, "value", "left")
        sums = scored.groupBy("pattern").agg(
            *[
                (F.lit(0.0) if scores is None else F.coalesce(F.sum(k), F.lit(0.0))).alias(f"new_{k}")
                for k in KINDS
            ],
            F.count("*").cast("double").alias("new"),
        )
        both = sums.join(fixed, "pattern", "full").na.fill(0)
        total = {k: F.col(f"fixed_{k}") + F.col(f"new_{k}") for k in KINDS}
        confident = saved(
            both.select(
                "pattern",
                *[total[k].alias(f"fixed_{k}") for k in KINDS],
                (F.col("fixed") + F.col("new")).alias("fixed"),
                *[
                    F.when(total[k] >= min_support, total[k] / (F.col("fixed") + F.col("new") + 1)).otherwise(0.0).alias(f"p_{k}")
                    for k in KINDS
                ],
            ).filter(F.greatest(*[F.col(f"p_{k}") for k in KINDS]) >= min_pattern),
            "pii-confident",
        )
        chance = lambda k: F.when(F.col(f"p_{k}") >= min_pattern, F.log1p(-F.least(F.col(f"p_{k}"), F.lit(0.999999)))).otherwise(0.0)
        scores = saved(
            open_edges.join(confident, "pattern").groupBy("value").agg(*[(1 - F.exp(F.sum(chance(k)))).alias(k) for k in KINDS]),
            "pii-scores",
        )
    return scores, confident.drop(*[f"p_{k}" for k in KINDS])


def _chosen(scores: DataFrame, min_score: float) -> DataFrame:
    best = F.greatest(*[F.col(k) for k in KINDS])
    kind = F.coalesce(*[F.when(F.col(k) == best, k) for k in KINDS])
    return scores.filter(best >= min_score).select("value", kind.alias("kind"))


def _maybe(known: DataFrame, name: str, value: Column) -> Column:
    """Whether a value may be among the ``known`` ones, by a table of fixed size; a join has to follow."""
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(_BITS)).cast("int")
    words = known.select(slot(F.col(name)).alias("slot")).groupBy(word_of(F.col("slot")).alias("word")).agg(F.bit_or(bit_of(F.col("slot"))).alias("bits"))
    table = dict(words.collect())
    flags = [bool(table.get(i // 64, NONE) >> i % 64 & 1) for i in range(_BITS)]
    # one flag each, so that a test computes and hashes the value once
    may = known.sparkSession.createDataFrame([(flags,)], "may array<boolean>").select("may").scalar()
    return F.get(may, slot(value))


def _in_slots(docs: DataFrame, confident: DataFrame) -> DataFrame:
    """(pattern, value): tokens that are no instances by their form, in the slots of confident patterns."""
    words = F.regexp_extract_all(F.coalesce(F.col("text"), F.lit("")), F.lit(_TOKEN), F.lit(0))
    none = F.array(F.lit(None).cast("string"))
    # outer, as a plain one looks at the tokens twice: once for rows without any
    shifted = docs.select(words.alias("w")).select(
        F.inline_outer(
            F.arrays_zip(
                F.col("w").alias("token"),
                F.concat(none, "w").alias("one"),
                F.concat(none, none, "w").alias("two"),
                F.slice("w", F.lit(2), F.greatest(F.size("w"), F.lit(1))).alias("after"),
            )
        )
    )

    def plain(c: str, cut) -> Column:
        """The word at this place; a unit, which has a digit or an at sign, ends a context."""
        word = _word(cut(c, F.lit(_CONTEXT)))
        unit = word.contains("0") | word.contains("@") | ((F.length(c) > _CONTEXT) & F.col(c).rlike("[0-9@]"))
        return F.when(unit, "^").otherwise(word)

    # most tokens follow a word that no pattern has
    rest = F.substr("pattern", F.lit(3))
    known = confident.select(
        F.when(F.col("pattern").startswith("2|"), F.substring_index(rest, " ", -1)).otherwise(F.substring_index(rest, " ", 1)).alias("one")
    )
    # a filter computes its terms anew wherever they stand, so this one has the word before once, and no test for a unit if
    # no pattern needs it
    likely = _maybe(known, "one", _plain(F.right("one", F.lit(_CONTEXT))))
    if not known.filter("one = '^'").isEmpty():
        likely = likely | F.col("one").isNull() | F.col("one").rlike(f"[{_DIGIT}@]")
    lead = shifted.filter("token is not null").filter(likely).withColumn("one", plain("one", F.right))
    near = lead.withColumns(
        {"two": F.when(F.col("one") == "^", "^").otherwise(plain("two", F.right)), "after": plain("after", F.left)}
    )
    patterns = F.array(
        F.concat(F.lit("2|"), "two", F.lit(" "), "one"), F.concat(F.lit("b|"), "one", F.lit(" _ "), "after"), F.concat(F.lit("1|"), "one")
    )
    placed = near.select("token", F.explode(patterns).alias("pattern")).join(confident.select("pattern"), "pattern", "left_semi")
    # written, as the tests of the values would otherwise move in front of the joins, to every token
    value = saved(placed.select("pattern", _core(F.col("token")).alias("core")).distinct(), "pii-slot-values")
    labelled = value.filter("core <> ''").select("pattern", F.lower("core").alias("value"), _label(F.col("core")).alias("label"))
    return labelled.filter(~_alike(F.col("value"), F.col("label"))).groupBy("pattern", "value").agg(F.max("label").alias("label"))


def discovered(
    rows: DataFrame,
    rounds: int = ROUNDS,
    min_support: float = MIN_SUPPORT,
    min_pattern: float = MIN_PATTERN,
    min_score: float = MIN_SCORE,
    docs: DataFrame | None = None,
) -> DataFrame:
    """(value, kind): new identifiers found by the patterns of the seeds in ``located`` rows.

    Tokens that are no instances by their form are looked up in ``docs``, the documents of these rows.
    """
    instances = rows.select(F.explode("units").alias("u")).select("u.value", "u.label", F.explode("u.patterns").alias("pattern"))
    edges = saved(instances.groupBy("pattern", "value").agg(F.max("label").alias("label")), "pii-edges")
    fixed = lambda some: saved(
        some.filter("label is not null")
        .groupBy("pattern")
        .agg(*[F.count_if(F.col("label") == k).cast("double").alias(f"fixed_{k}") for k in KINDS], F.count("*").cast("double").alias("fixed")),
        "pii-fixed",
    )
    # a pattern without enough seeds can gain support by new instances only beside patterns that have it
    open_edges = saved(edges.filter("label is null").select("pattern", "value"), "pii-open")
    scores, confident = _scored(open_edges, fixed(edges), rounds, min_support, min_pattern)
    found = _chosen(scores, min_score)
    if docs is None or confident.isEmpty():
        return found
    others = saved(_in_slots(docs, confident), "pii-slots")
    sums = confident.unionByName(fixed(others)).groupBy("pattern").agg(*[F.sum(c).alias(c) for c in confident.columns[1:]])
    more, _ = _scored(others.filter("label is null").select("pattern", "value"), sums, rounds, min_support, min_pattern)
    return found.unionByName(_chosen(more, min_score))


def _occurrences(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(row, start, end, kind): where the tokens in ``found`` stand that are no instances by their form."""
    text = F.coalesce(F.col("text"), F.lit(""))
    tokens = docs.select(row_key().alias("row"), F.explode_outer(_matches(text, _TOKEN)).alias("m")).filter("m is not null")
    placed = tokens.select("row", F.col("m.start").alias("at"), F.col("m.found").alias("token")).withColumn("core", _core(F.col("token")))
    start = (F.col("at") + F.length(_lead(F.col("token")))).alias("start")
    met = placed.withColumn("value", F.lower("core")).join(found, "value").select("row", start, "core", "value", "kind")
    # written, for the same reason as above
    return (
        saved(met, "pii-places")
        .filter(~_alike(F.col("value"), _label(F.col("core"))))
        .select("row", "start", (F.col("start") + F.length("core")).alias("end"), "kind")
    )


def _added(rows: DataFrame, found: DataFrame, docs: DataFrame) -> DataFrame:
    """(row, added): spans of new identifiers, none of which overlaps a span of the rules."""
    order = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int") - 1
    candidates = rows.select("row", "base", F.explode(F.filter("units", lambda u: u["label"].isNull())).alias("u"))
    spans = candidates.select("row", "base", "u.start", "u.end", "u.value").join(found, "value").select("row", "base", "start", "end", "kind")
    others = found.filter(~_alike(F.col("value"), F.lit(None).cast("string")))
    if not others.isEmpty():
        placed = _occurrences(docs, others).distinct()
        spans = spans.unionByName(placed.join(rows.select("row", "base"), "row").select("row", "base", "start", "end", "kind"))
    free = ~F.exists("base", lambda b: (b["start"] < F.col("end")) & (F.col("start") < b["end"]))
    return (
        spans.filter(free)
        .groupBy("row")
        .agg(F.sort_array(F.collect_set(F.struct("start", order.alias("order"), "end", "kind"))).alias("added"))
    )


def report(docs: DataFrame) -> DataFrame:
    rows = located(docs)
    added = _added(rows, saved(discovered(rows, docs=docs), "pii-found"), docs).withColumnRenamed("row", "r")
    none = F.array().cast(_SPANS)
    found = rows.select("row", "doc_id", "base").join(added, F.col("row") == F.col("r"), "left")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *[count(kind) for kind in KINDS],
        F.sha2(as_text(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        as_text(F.sort_array(F.concat("base", F.coalesce("added", none)))).alias("spans"),
        F.size(F.coalesce("added", none)).cast("long").alias("n_discovered"),
    )


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span (in order) replaced by its kind in brackets; overlapping spans by the first one's."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        mark = F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))
        out = F.when(s["start"] >= acc["at"], F.concat(acc["out"], gap, mark)).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    return F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def redact(docs: DataFrame) -> DataFrame:
    """Documents with personal data replaced in their texts; all rows and columns stay.

    New identifiers are looked up by a key of id and text, so rows that share an id get the spans of their own texts.
    """
    rows = located(docs)
    found = saved(discovered(rows, docs=docs), "pii-found")
    text = F.col("text")
    spans = F.when(text.rlike("[0-9@]"), base_spans(text))
    if found.isEmpty():
        return docs.withColumn("_spans", spans).withColumn(
            "text", F.when(F.size("_spans") > 0, redacted(text, F.col("_spans"))).otherwise(text)
        ).drop("_spans")
    added = _added(rows, found, docs).select(F.col("row").alias("_row"), F.col("added").alias("_added"))
    joined = docs.withColumn("_row", row_key()).join(added, "_row", "left")
    every = F.sort_array(F.concat(F.coalesce(spans, F.array().cast(_SPANS)), F.coalesce("_added", F.array().cast(_SPANS))))
    return joined.withColumn("_spans", every).withColumn(
        "text", F.when(F.size("_spans") > 0, redacted(text, F.col("_spans"))).otherwise(text)
    ).select(docs.columns)
