"""Text columns: trimming, line splitting, folding and tokenising."""

from __future__ import annotations

import unicodedata
from functools import lru_cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Searchable fields and their ranking weights.
WEIGHTS = {"title": 10.0, "stem": 2.0, "folder": 4.0, "body": 1.0}
FIELDS = tuple(WEIGHTS)

# Whitespace and line boundaries as Unicode text processing sees them.
SPACE = r"[\s\x1c-\x1f]"
RARE_BREAKS = "\u000b\u000c\u001c\u001d\u001e\u0085\u2028\u2029"
LINE_BREAK = "[\n\u000b\u000c\u001c-\u001e\u0085\u2028\u2029]"

# A token is a run of letters, numbers or private-use characters; combining marks never split one.
TOKEN = r"[\p{L}\p{N}\p{Co}]+"
MARKS = "[\u0300-\u036f]"
RAW_TOKEN = r"[\p{L}\p{N}\p{Co}][\p{L}\p{N}\p{Co}" + "\u0300-\u036f" + "]*"


def strip(c: Column) -> Column:
    """Remove whitespace of any kind from both ends."""
    return F.regexp_replace(c, f"(?U)^{SPACE}+|{SPACE}+$", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, f"(?U){SPACE}+$", "")


def unify_newlines(c: Column) -> Column:
    return F.when(F.contains(c, F.lit("\r")), F.regexp_replace(c, "\r\n?", "\n")).otherwise(c)


def head_lines(c: Column, n: int) -> Column:
    """The first ``n`` lines as an array; the rest of the text is not split.

    Rare line boundaries are looked for by byte search first, as the pattern is far slower.
    """
    rare = reduce(Column.__or__, [F.contains(c, F.lit(b)) for b in RARE_BREAKS])
    lines = F.when(rare, F.split(c, LINE_BREAK, n + 1)).otherwise(F.split(c, "\n", n + 1))
    return F.slice(lines, 1, n)


@lru_cache(maxsize=1)
def _fold_table() -> tuple[str, str]:
    """Single-character replacements applied after lower-casing, derived from the Unicode database."""
    source, target = [], []
    for code in range(0x80, 0x10000):
        ch = chr(code)
        if not unicodedata.category(ch).startswith("L") or ch.lower() != ch:
            continue
        folded = ch.casefold()
        folded = folded if len(folded) == 1 and folded.lower() == folded else ch
        parts = unicodedata.normalize("NFD", folded)
        accented = len(parts) > 1 and all("\u0300" <= m <= "\u036f" for m in parts[1:])
        script = unicodedata.name(parts[0], "").split(" ")[0]
        if accented and script in ("LATIN", "GREEK", "CYRILLIC"):
            folded = parts[0].lower()
        if folded != ch:
            source.append(ch)
            target.append(folded)
    return "".join(source), "".join(target)


def fold(c: Column) -> Column:
    """Lower-case and drop diacritics."""
    source, target = _fold_table()
    return F.regexp_replace(F.translate(F.lower(c), source, target), MARKS, "")


def is_ascii(c: Column) -> Column:
    return F.octet_length(c) == F.char_length(c)


def tokens(c: Column) -> Column:
    """Folded tokens. Pure ASCII text, by far the quicker case, needs no character table."""
    plain = F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))
    full = F.regexp_extract_all(fold(c), F.lit(TOKEN), F.lit(0))
    return F.when(is_ascii(c), plain).otherwise(full)


def separated(c: Column) -> Column:
    """The text with its tokens as runs of ASCII letters and digits (of any case) and of bytes from 0x80 on.

    Other ASCII characters separate tokens and are kept. Text that is ASCII already is not touched; a text of stray
    bytes is as long in bytes as in characters too, so validity is asked for.
    """
    other = F.regexp_replace(fold(c), r"[^\x00-\x7F\p{L}\p{N}\p{Co}]", " ")
    return F.when(is_ascii(c) & F.is_valid_utf8(c), c).otherwise(other)


def token_count(c: Column) -> Column:
    """Same number as ``size(tokens(c))`` without building the array."""
    return F.when(is_ascii(c), F.regexp_count(c, F.lit("[A-Za-z0-9]+"))).otherwise(
        F.regexp_count(c, F.lit(RAW_TOKEN))
    )


def query_tokens(value: str) -> list[str]:
    """Tokenise one query value on the driver by the rule of :func:`tokens`."""
    source, target = _fold_table()
    text = value.lower().translate(str.maketrans(source, target))
    out, word = [], ""
    for ch in text + " ":
        if "\u0300" <= ch <= "\u036f":
            continue
        kind = unicodedata.category(ch)
        if kind[0] in "LN" or kind == "Co":
            word += ch
        elif word:
            out.append(word)
            word = ""
    return out


def ascii_key(c: Column) -> Column:
    """Case-fold the 26 ASCII letters only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
