"""Main text of HTML pages by the maximum-scoring subsequence of words and tags.

A page is read once into a sequence of words and tags. Words have the score of the element around them, tags that of
their name and class; a linear scan finds the contiguous region with the largest sum, which is the main content. From
that region parts that are never content (scripts, forms, adverts, comments of readers, …) are left out. These are
told by their element, or by a class, id or role that is such a name as a whole (``sidebar``, ``site-footer``, but not
``has-sidebar`` or ``post-header``); an element so named stays if it holds all marked articles of the page, or nearly all
words of a page without any.

The scores are log-odds of lying inside, learned from labelled pages: pages whose author marked the content with an
``article`` or ``main`` element (or ``itemprop=articleBody``). Words in elements seen more inside than outside score
positive, tags score negative, more so the rarer they are inside. At most about ``sample_pages`` pages are used for that.
Elements never seen keep fixed prior scores, so pages can also be read without any labelled page.

White space inside a block, no-break spaces too, becomes one blank, blocks are joined by one blank; inline tags do not break a block.

Defined cases: null, empty and text-free pages give an empty text; a page without a positive word gives an empty text;
unclosed or cut markup is read as far as it goes; of equal regions the first is taken, as long as possible.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE_PAGES = 5_000
MAX_SCORE, MIN_TAG, NEVER_SCORE = 4.0, -0.25, -0.2

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)|[^<]++|<",
    re.S,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_BLANK = re.compile(r"\s+")

RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
#: Elements that are never part of the main text.
NEVER = RAW | set(
    "head nav header footer aside form button select option input menu dialog template svg canvas object audio video "
    "math map".split()
)
#: Words of class, id and role names that mark such parts.
NEVER_NAMES = set(
    "ad ads advert advertisement adverts sponsor sponsored promo promotion banner cookie cookies consent notice notices "
    "nav navigation navbar menu breadcrumb breadcrumbs sidebar aside footer header masthead comment comments disqus "
    "reply replies share sharing social related recommended newsletter subscribe signup login popup modal widget "
    "complementary contentinfo search".split()
)
#: Words that leave such a name what it is: ``site-footer``, ``comment-list``.
QUALIFIERS = set("site page main top bottom left right global primary secondary list section box block bar area slot unit".split())
#: What readers and advertisers wrote is never content, however much of a page it is.
READERS = set("comment comments disqus reply replies".split())
ADVERTS = set("ad ads advert advertisement adverts sponsor sponsored promo promotion".split())
#: A named part with more than this share of the words is the content of a page without a marked article.
MOST = 0.9
ARTICLE = {"article", "main"}
#: These end an open paragraph.
ENDS_P = set(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav "
    "ol p pre section table ul".split()
)


def _never_name(token: str) -> str:
    """The word by which a class, id or role names a part that is never content, else an empty string."""
    words = [w for w in re.split(r"[-_]+", token) if w]
    named = [w for w in words if w in NEVER_NAMES]
    return named[0] if named and all(w in NEVER_NAMES or w in QUALIFIERS for w in words) else ""


def _names(attributes: str) -> tuple[set[str], set[str], bool]:
    """Name words of class, id and role; those that name a part that is never content; whether it is an article body."""
    words: set[str] = set()
    never: set[str] = set()
    body = False
    if "=" in attributes:
        for key, a, b, c in _ATTRIBUTE.findall(attributes):
            value = a or b or c
            if key.lower() in ("class", "id", "role"):
                value = value.lower()
                words |= {w for w in re.split(r"[^a-zA-Z]+", value) if w}
                never |= {w for token in value.split() if (w := _never_name(token))}
            body |= key.lower() == "itemprop" and value == "articleBody"
    return words, never, body


class _Named:
    """Elements whose name says that they are no content; decided when the whole page is known."""

    def __init__(self) -> None:
        self.parent: list[int] = []
        self.names: list[set[str]] = []
        self.articles: list[int] = []
        self.all_articles = 0

    def add(self, parent: int, names: set[str]) -> int:
        self.parent.append(parent)
        self.names.append(names)
        self.articles.append(0)
        return len(self.parent) - 1

    def article(self, around: int) -> None:
        self.all_articles += 1
        if around >= 0:
            self.articles[around] += 1

    def left_out(self, words: list[int], all_words: int) -> list[bool]:
        """Whether each one is left out; ``words`` are those directly below each. Parents come before children."""
        articles = list(self.articles)
        for i in range(len(self.parent) - 1, -1, -1):
            if (up := self.parent[i]) >= 0:
                words[up] += words[i]
                articles[up] += articles[i]
        out: list[bool] = []
        for i, up in enumerate(self.parent):
            if self.names[i] & READERS:
                stays = False
            elif self.all_articles:
                stays = articles[i] == self.all_articles
            else:
                stays = not self.names[i] & ADVERTS and words[i] > MOST * all_words
            out.append(not stays or (up >= 0 and out[up]))
        return out


#: Open elements that the start of one of these closes.
_SAME = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, **dict.fromkeys(ENDS_P, {"p"}),
}


def sequence(page: str) -> list[tuple[str, str, str, bool, bool]]:
    """(kind, name, text, never, inside) for each tag and text run.

    ``kind`` is word, tag or end; ``name`` the element's name, with its first class word; ``never``: below an element
    that cannot be content; ``inside``: below an element marked as the article.
    """
    # element, name, never by an element, inside, name of the block around, named element around, nearest non-inline place
    stack: list[tuple[str, str, bool, bool, str, int, int]] = []
    opened: Counter = Counter()  # open elements by name: a stray closing tag costs no walk
    runs: list[tuple[str, str, str, bool, bool, int]] = []
    named = _Named()
    root = ("", "", False, False, "", -1, -1)
    at, end = 0, len(page)

    def close(depth: int) -> None:
        for entry in stack[depth:]:
            opened[entry[0]] -= 1
        del stack[depth:]

    while at < end:
        m = _TOKEN.match(page, at)
        at = m.end()
        token = m[0]
        top = stack[-1] if stack else root
        closing, element, rest = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not element:
            if token[:2] not in ("<!", "<?"):
                runs.append(("word", top[4], token, top[2], top[3], top[5]))
            continue
        element = element.lower()
        if closing:
            if opened[element]:
                depth = len(stack) - 1
                while stack[depth][0] != element:
                    depth -= 1
                name = stack[depth][1]
                close(depth)
                top = stack[-1] if stack else root
                runs.append(("end", name, element, top[2], top[3], top[5]))
            continue
        words, never, body = _names(rest)
        name = ".".join([element, *sorted(words)[:1]])
        if (same := _SAME.get(element)) and top[6] >= 0 and stack[top[6]][0] in same:
            close(top[6])
            top = stack[-1] if stack else root
        hard = top[2] or element in NEVER
        around = top[5]
        if never and not hard and element not in ("html", "body", *ARTICLE):
            around = named.add(around, never)
        marks = element in ARTICLE or body
        if marks and not hard:
            named.article(around)
        runs.append(("tag", name, element, hard, top[3], around))
        if element in VOID or rest.endswith("/") and element not in ARTICLE:
            continue
        if element in RAW:
            closer = re.compile(rf"</{re.escape(element)}", re.I).search(page, at)
            at = closer.start() if closer else end
        inline = element in INLINE
        stack.append((element, name, hard, top[3] or marks, top[4] if inline else name, around, top[6] if inline else len(stack)))
        opened[element] += 1
    if not named.parent:
        return [run[:5] for run in runs]
    total, below = 0, [0] * len(named.parent)
    for kind, _, text, hard, _, around in runs:
        if kind == "word" and not hard:
            n = len(text.split())
            total += n
            if around >= 0:
                below[around] += n
    out = named.left_out(below, total)
    return [(kind, name, text, hard or (around >= 0 and out[around]), inside) for kind, name, text, hard, inside, around in runs]


def _counted(page: str) -> tuple[Counter, Counter]:
    """Words and tags by name, inside and outside the marked article, where they can be content at all."""
    inner: Counter = Counter()
    outer: Counter = Counter()
    for kind, name, text, never, inside in sequence(page):
        if never:
            continue
        side = inner if inside else outer
        if kind == "word":
            if n := len(text.split()):
                side["word " + name] += n
        elif kind == "tag" and text not in ARTICLE:
            side["tag " + name] += 1
    return inner, outer


def learn(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> dict[str, float]:
    """Scores by feature from about ``sample_pages`` labelled pages; features are element names, so few."""
    labelled = pages.select(F.col("html").alias("h")).filter(
        F.col("h").rlike(r"(?i)<(article|main)[\s>]|itemprop\s*=\s*.?articleBody")
    )
    n = labelled.count()
    if n > sample_pages:
        labelled = labelled.filter(F.pmod(F.xxhash64("h"), F.lit(1_000_000)) < int(1_000_000 * sample_pages / n))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            inner: Counter = Counter()
            outer: Counter = Counter()
            for page in batch.column(0).to_pylist():
                a, b = _counted(page)
                inner += a
                outer += b
            names = sorted(inner | outer)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names), pa.array([inner[x] for x in names], pa.int64()), pa.array([outer[x] for x in names], pa.int64())],
                names=["feature", "inner", "outer"],
            )

    counts = (
        labelled.mapInArrow(count, "feature string, inner long, outer long")
        .groupBy("feature")
        .agg(F.sum("inner").alias("inner"), F.sum("outer").alias("outer"))
        # names that are almost never seen keep the prior; at most 1,000 are learned
        .filter("inner + outer >= 5")
        .orderBy(F.desc(F.col("inner") + F.col("outer")), "feature")
        .limit(1000)
        .collect()
    )
    scores: dict[str, float] = {}
    for r in counts:
        odds = math.log((r["inner"] + 1) / (r["outer"] + 1))
        if r["feature"].startswith("word "):
            scores[r["feature"]] = max(-MAX_SCORE, min(MAX_SCORE, odds))
        else:
            scores[r["feature"]] = max(-MAX_SCORE, min(MIN_TAG, odds - MAX_SCORE / 2))
    return scores


def extract(page: str | None, scores: dict[str, float]) -> str:
    """The main text of one page."""
    if not page:
        return ""
    parts: list[tuple[str, str, bool]] = []  # kind, text or element, never
    best = total = 0.0
    first = start = 0
    last = -1
    skipped = False
    for kind, name, text, never, _ in sequence(page):
        # what is left out anyway should not part an article, however long it is: it costs as much as one tag
        if never:
            score = 0.0 if skipped else NEVER_SCORE
        elif kind == "word":
            score = len(text.split()) * scores.get("word " + name, scores.get("word " + name.split(".")[0], 1.0))
        else:
            score = scores.get("tag " + name, -0.5) / (1 if kind == "tag" else 2)
        skipped = never
        if total <= 0 and score > 0:
            total, start = 0.0, len(parts)
        total += score
        parts.append((kind, text, never))
        if total > best or (total == best and start == first and last >= 0 and kind == "word"):
            best, first, last = total, start, len(parts) - 1
    text = []
    for kind, value, never in parts[first : last + 1]:
        if kind == "word":
            if not never:
                text.append(html.unescape(value))
        elif value not in INLINE:
            text.append(" ")
    return _BLANK.sub(" ", "".join(text)).strip()


def main_text(pages: DataFrame, scores: dict[str, float] | None = None) -> DataFrame:
    """``pages`` plus ``text``, replacing a column of that name."""
    shared = pages.sparkSession.sparkContext.broadcast(learn(pages) if scores is None else scores)

    @F.arrow_udf("string")
    def text(htmls: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in htmls:
            yield pa.array([extract(page.as_py(), shared.value) for page in batch], pa.string())

    return pages.withColumn("text", text("html"))


def report(pages: DataFrame) -> DataFrame:
    found = main_text(pages.select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
