"""Titles and links read from the head of a text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptorium.functions.text import SPACE, head_lines, strip

# How many lines are looked at, and the keys in order of precedence.
TXT_HEAD = 30
MD_HEAD = 40
TITLE_KEYS = ("Title", "title")
URL_KEYS = ("URL", "titleUrl")


# Lines worth a closer look; both tests are anchored, so long lines cost nothing.
_KEYED = f"(?U)^{SPACE}*({'|'.join(TITLE_KEYS + URL_KEYS)}){SPACE}*:"
_PLAIN = f"(?U)^{SPACE}*[^\\s\\x1c-\\x1f*-]"


def _first_value(body: Column, keys: tuple[str, ...]) -> Column:
    """The first non-empty value among the head lines, the first key taking precedence."""
    keyed = F.filter(head_lines(body, TXT_HEAD), lambda line: line.rlike(_KEYED))
    pairs = F.transform(
        keyed,
        lambda line: F.struct(
            strip(F.substring_index(line, ":", 1)).alias("key"),
            strip(F.substring(line, F.instr(line, ":") + 1, F.length(line))).alias("val"),
        ),
    )

    def first(key: str) -> Column:
        found = F.filter(pairs, lambda p: (p["key"] == key) & (p["val"] != ""))
        return F.get(found, F.lit(0))["val"]

    return F.coalesce(*[first(k) for k in keys])


def txt_title(body: Column) -> Column:
    return _first_value(body, TITLE_KEYS)


def txt_url(body: Column) -> Column:
    return _first_value(body, URL_KEYS)


def md_title(body: Column) -> Column:
    """The first non-empty heading, else the first plain line that is not a list item."""
    lines = head_lines(body, MD_HEAD)
    headings = F.transform(
        F.filter(lines, lambda line: line.startswith("#")),
        lambda line: strip(F.regexp_extract(line, f"(?U)^#{{1,6}}{SPACE}+(.*)", 1)),
    )
    heading = F.get(F.filter(headings, lambda h: h != ""), F.lit(0))
    plain = F.get(F.filter(lines, lambda line: line.rlike(_PLAIN)), F.lit(0))
    return F.coalesce(heading, strip(plain))


def title_of(body: Column, ext: Column, stem: Column) -> Column:
    return F.coalesce(F.when(ext == "txt", txt_title(body)).otherwise(md_title(body)), stem)


def url_of(body: Column, ext: Column) -> Column:
    """Only plain-text headers carry a link."""
    return F.when(ext == "txt", txt_url(body))
