"""Benchmark decontamination with a generalised suffix automaton of the benchmark items.

Words are runs of ASCII letters and digits (A-Z folded) and of any non-ASCII characters. The automaton holds every
word sequence that occurs inside an item; a document's words are streamed through it once, keeping the length of the
longest suffix that occurs in some item. Where that length reaches ``window``, the last ``window`` words are a hit;
an item with fewer words is a window as a whole. The scan is linear in the document.

The benchmark is a stated query set: it is handled in blocks of about ``block_words`` words, and every document passes
every block. A benchmark of one block is part of the plan that reads the documents, and nothing is shuffled. With more,
each block is a job of its own: its automaton alone is broadcast, the hits of each distinct text that has any are written to the
shared folder, the broadcast is dropped, and at the end the hits of all blocks are merged and looked up by the text's digest.

Defined cases: null or empty texts have no words and no hits; items with null text or no words are ignored; those with
null id are windows like any other, but are in no list or number of items;
repeated items give the same windows; an empty benchmark contaminates nothing; repeated rows are judged alike.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from scriptorium.llm.base import saved

WINDOW = 10
BLOCK_WORDS = 500_000
MAX_COVERAGE = 0.5

_WORDS = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
#: The same words in a text of characters.
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else (b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32) for b in range(256)
)

_FOUND = StructType(
    [
        StructField("n_words", LongType()),
        StructField("starts", ArrayType(LongType())),
        StructField("ends", ArrayType(LongType())),
        StructField("items", ArrayType(StringType())),
    ]
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class Automaton:
    """Generalised suffix automaton over words: ``step`` maps a state and a word to the next state."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.step: list[dict[bytes, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        ends = []
        for _, words in items:
            at = 0
            for word in words:
                at = self._extend(at, word)
            ends.append(at)
        n = len(self.step)
        by_length = sorted(range(n), key=self.length.__getitem__)
        #: state that stands for the last ``window`` words of a match
        self.anchor = [-1] * n
        for v in by_length[1:]:
            if self.length[v] >= window:
                up = self.link[v]
                self.anchor[v] = self.anchor[up] if self.length[up] >= window else v
        #: items that contain the window of an anchor
        inside: dict[int, dict[str, None]] = {}
        #: (words, item) for items shorter than a window, at the state where they end and all states below
        self.whole: list[tuple[tuple[int, str], ...]] = [()] * n
        for (item, words), end in zip(items, ends, strict=True):
            if len(words) < window:
                self.whole[end] += ((len(words), item),)
                continue
            at = length = 0
            for word in words:
                at, length = self.advance(at, length, word)
                if length >= window:
                    inside.setdefault(self.anchor[at], {})[item] = None
        self.inside = {v: tuple(found) for v, found in inside.items()}
        for v in by_length[1:]:
            self.whole[v] += self.whole[self.link[v]]

    def _extend(self, last: int, word: bytes) -> int:
        step, link, length = self.step, self.link, self.length
        if word in step[last]:
            old = step[last][word]
            return old if length[old] == length[last] + 1 else self._split(last, word, old)
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and word not in step[at]:
            step[at][word] = new
            at = link[at]
        if at >= 0:
            old = step[at][word]
            link[new] = old if length[old] == length[at] + 1 else self._split(at, word, old)
        return new

    def _split(self, at: int, word: bytes, old: int) -> int:
        step, link, length = self.step, self.link, self.length
        copy = len(step)
        step.append(dict(step[old]))
        length.append(length[at] + 1)
        link.append(link[old])
        link[old] = copy
        while at >= 0 and step[at].get(word) == old:
            step[at][word] = copy
            at = link[at]
        return copy

    def advance(self, state: int, length: int, word: bytes) -> tuple[int, int]:
        step = self.step
        to = step[state].get(word)
        while to is None and state:
            state = self.link[state]
            length = self.length[state]
            to = step[state].get(word)
        return (0, 0) if to is None else (to, length + 1)

    def scan(self, words: list[bytes]) -> tuple[list[int], list[int], list[str]]:
        """Word spans covered by windows (merged, in order) and the items found."""
        step, link, lengths, window, whole = self.step, self.link, self.length, self.window, self.whole
        root = step[0]
        starts: list[int] = []
        ends: list[int] = []
        items: dict[str, None] = {}
        state = length = 0
        for i, word in enumerate(words, 1):
            if state:
                to = step[state].get(word)
                while to is None and state:
                    state = link[state]
                    length = lengths[state]
                    to = step[state].get(word)
            else:
                to = root.get(word)
            if to is None:
                state = length = 0
                continue
            state = to
            length += 1
            hit = 0
            if length >= window:
                hit = window
                items.update(dict.fromkeys(self.inside[self.anchor[state]]))
            if whole[state]:
                for size, item in whole[state]:
                    if size <= length:
                        hit = max(hit, size)
                        items[item] = None
            if hit:
                begin = i - hit
                while starts and starts[-1] >= begin:
                    starts.pop()
                    ends.pop()
                if starts and begin <= ends[-1]:
                    ends[-1] = i
                else:
                    starts.append(begin)
                    ends.append(i)
        return starts, ends, list(items)


def _blocks(items: DataFrame, block_words: int) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    """The items, about ``block_words`` words at a time; always at least one block."""
    rows = items.select(F.col("item_id").cast("string").alias("item"), F.encode("text", "utf-8").alias("raw")).dropna(subset=["raw"])
    total = rows.agg(F.sum(F.length("raw"))).first()[0] or 0
    blocks = int(total // (block_words * 6)) + 1
    for k in range(blocks):
        found = rows.filter(F.pmod(F.xxhash64("item", "raw"), F.lit(blocks)) == k).collect()
        block = sorted(((r["item"], words_of(bytes(r["raw"]))) for r in found), key=lambda r: (r[0] is None, r[0] or "", r[1]))
        yield [(item, words) for item, words in block if words]


def _finder(automaton):
    """The hits of a broadcast automaton as a function of the encoded text."""

    @F.arrow_udf(_FOUND)
    def find(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scan = automaton.value.scan
        schema = pa.struct(
            [
                ("n_words", pa.int64()),
                ("starts", pa.list_(pa.int64())),
                ("ends", pa.list_(pa.int64())),
                ("items", pa.list_(pa.string())),
            ]
        )
        for batch in texts:
            counts, starts, ends, items = [], [], [], []
            for raw in batch:
                words = words_of(raw.as_py() or b"")
                s, e, found = scan(words)
                counts.append(len(words))
                starts.append(s)
                ends.append(e)
                items.append([item for item in found if item is not None])
            yield pa.StructArray.from_arrays(
                [pa.array(x, f.type) for x, f in zip((counts, starts, ends, items), schema, strict=True)],
                names=[f.name for f in schema],
            )

    return find


def find(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` plus ``_found``: n_words, word spans ``[start, end)`` in ``starts``/``ends``, and the items hit.

    Spans of different blocks may overlap; those of one block are merged and in order.
    """
    context = docs.sparkSession.sparkContext
    blocks = _blocks(items, block_words)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        found = _finder(context.broadcast(Automaton(first, window)))(F.encode("text", "utf-8"))
        return docs.withColumn("_found", found).withColumn(
            "_found", F.col("_found").withField("items", F.sort_array(F.array_distinct("_found.items")))
        )
    digest = F.sha2(F.col("text").cast("binary"), 256)
    texts = docs.select("text").filter("text is not null")
    hits = None
    for block in chain([first, second], blocks):
        automaton = context.broadcast(Automaton(block, window))
        found = texts.select(digest.alias("_text"), _finder(automaton)(F.encode("text", "utf-8")).alias("h"))
        rows = found.filter(F.size("h.starts") > 0).groupBy("_text").agg(F.any_value("h").alias("h"))
        part = saved(rows, "benchmark-hits")
        automaton.destroy()
        hits = part if hits is None else hits.unionByName(part)
    # one row of a text for each block
    merged = hits.groupBy("_text").agg(F.collect_list("h").alias("h")).select(
        "_text",
        *[F.flatten(f"h.{f}").alias(f"_{f}") for f in ("starts", "ends", "items")],
    )
    none = lambda kind: F.array().cast(f"array<{kind}>")
    keyed = docs.withColumn("_digest", digest)
    return (
        keyed.join(merged, F.col("_digest") == F.col("_text"), "left")
        .withColumn(
            "_found",
            F.struct(
                F.coalesce(F.size(F.regexp_extract_all("text", F.lit(_WORD), F.lit(0))), F.lit(0)).cast("long").alias("n_words"),
                F.coalesce("_starts", none("bigint")).alias("starts"),
                F.coalesce("_ends", none("bigint")).alias("ends"),
                F.sort_array(F.array_distinct(F.coalesce("_items", none("string")))).alias("items"),
            ),
        )
        .drop("_digest", "_text", "_starts", "_ends", "_items")
    )


def hit_words(found: Column) -> Column:
    """Number of words inside any span."""
    spans = F.arrays_zip(found["starts"].alias("a"), found["ends"].alias("b"))
    inside = F.transform(spans, lambda s: F.sequence(s["a"], s["b"] - 1))
    return F.size(F.array_distinct(F.flatten(inside))).cast("long")


def report(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    found = F.col("_found")
    hits = hit_words(found)
    return find(docs.select("doc_id", "text"), items, window).select(
        "doc_id",
        found["n_words"].alias("n_words"),
        hits.alias("n_hit"),
        F.size(found["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(found["items"], ",").cast("binary"), 256).alias("items_sha256"),
        (hits > 0).alias("contaminated"),
    )


@F.arrow_udf(StringType())
def _cut(texts: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
    """Texts without the words of the given spans and what stands between those words; null where there is no span."""
    out = []
    for raw, a, b in zip(texts, starts, ends, strict=True):
        raw = raw.as_py()
        if raw is None or not len(a.as_py()):
            out.append(None)  # keeps its text
            continue
        words = [m.span() for m in _WORDS.finditer(raw)]
        keep, at = [], 0
        for s, e in sorted(zip(a.as_py(), b.as_py(), strict=True)):
            if words[e - 1][1] > at:
                keep.append(raw[at : max(at, words[s][0])])
                at = words[e - 1][1]
        keep.append(raw[at:])
        out.append(b"".join(keep).decode("utf-8", "replace"))
    return pa.array(out, pa.string())


def remove(
    docs: DataFrame,
    items: DataFrame,
    window: int = WINDOW,
    max_coverage: float = MAX_COVERAGE,
) -> DataFrame:
    """Documents without benchmark passages, columns unchanged.

    Every span found, a run of windows or a whole item shorter than a window, is cut from the text; a document of which
    more than ``max_coverage`` of the words are hits is left out as a whole.
    """
    found = F.col("_found")
    marked = find(docs, items, window).withColumn("_hits", hit_words(found))
    kept = marked.filter(F.col("_hits") <= found["n_words"] * F.lit(max_coverage))
    clean = _cut(F.encode("text", "utf-8"), found["starts"], found["ends"])
    return kept.withColumn("text", F.coalesce(clean, F.col("text"))).select(docs.columns)


SQL = r"""
WITH di AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
              'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w, row_number() OVER () AS r FROM documents),
bi AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
              'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
       WHERE text IS NOT NULL),
iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS size,
              array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS win
       FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM bi WHERE len(w) > 0)),
dw AS (SELECT r, i, size, array_to_string(w[i : i + size - 1], ' ') AS win
       FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i
             FROM di, (SELECT DISTINCT size FROM iw) WHERE len(w) >= size)),
h AS (SELECT DISTINCT r, i, dw.size, item_id FROM dw JOIN iw ON dw.size = iw.size AND dw.win = iw.win),
hw AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + size)) AS p FROM h) GROUP BY r),
it AS (SELECT r, count(item) AS n, string_agg(item, ',' ORDER BY item) AS items
       FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM h) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(hw.n, 0)::BIGINT AS n_hit, coalesce(it.n, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(hw.n, 0) > 0 AS contaminated
FROM di LEFT JOIN hw USING (r) LEFT JOIN it USING (r)
"""
