"""File bytes to text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptorium.functions.text import unify_newlines

# Fixed value: larger files are reported, never read.
MAX_FILE_BYTES = 8 * 1024 * 1024

_C1 = "".join(chr(b) for b in range(0x80, 0xA0))
_CP1252 = bytes(range(0x80, 0xA0)).decode("cp1252", errors="replace")


def decode_text(content: Column) -> Column:
    """UTF-8 without its byte-order mark, else Windows-1252; line ends become ``\\n``."""
    as_utf8 = content.cast("string")
    latin = F.translate(F.decode(content, "ISO-8859-1"), _C1, _CP1252)
    text = F.when(F.is_valid_utf8(as_utf8), F.regexp_replace(as_utf8, "^\ufeff", "")).otherwise(latin)
    return unify_newlines(text)
