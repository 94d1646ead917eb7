"""Fill-in-the-middle rearrangement of texts, computed on whole Arrow arrays.

A text is cut into units (runs of ASCII letters, or any other single character) and two cut points split it into prefix,
middle and suffix. Per batch: a separator that no text of the batch holds is put behind every unit, the marked texts are
split into list arrays, the lists are flattened beside the index of their row, ordinals follow from the list offsets,
each role's units are filtered out and rebuilt into lists, and the lists are joined into pieces. Nothing runs per unit or
per row in Python.

Cut points and form are drawn from the sha256 of ``seed:doc_id``, so they depend on the row alone and a lost task repeats
them. ``plain`` leaves the text as it is; ``psm`` is ``<P>prefix<S>suffix<M>middle``, ``spm`` is
``<S>suffix<P>prefix<M>middle``. No text that holds a sentinel is rearranged, and two sentinels cannot overlap, so
every output can be taken apart again.

Defined cases: null and empty texts are plain with no units; a null ``doc_id`` draws as an id without digits; repeated
rows get the same result; texts of any length are cut whole (a slice holds at least one text and else about
``SLICE_BYTES``); no rows give no rows; columns of ``docs`` named like a result column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNIT = "[A-Za-z]+|[^A-Za-z]"
#: Texts rearranged, of 100; of those, the ones with the suffix first.
RATE, SPM_RATE = 90, 20
SLICE_BYTES = 1 << 20

_RESULT = "n long, form string, prefix_chars long, middle_chars long, output string"
_TYPE = pa.struct(
    [("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())]
)


def draws(seed: int, doc_id: Column) -> list[Column]:
    """The first four 8-digit groups of the row's hash as unsigned integers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(start, length) of neighbouring texts with about ``SLICE_BYTES`` together."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(texts):
        limit = (ends[start - 1] if start else 0) + SLICE_BYTES
        stop = max(start + 1, int(np.searchsorted(ends, limit, "right")))
        yield start, stop - start
        start = stop


def _separator(texts: pa.Array) -> str:
    """A character that no text holds; there are more characters than a slice can use up."""
    for point in [0x1F, 0x1E, *range(0xE000, 0xF900), *range(0xF0000, 0x110000)]:
        if not pc.any(pc.match_substring(texts, chr(point))).as_py():
            return chr(point)
    raise ValueError("every private-use character is taken")


def _modulo(a: pa.Array, b) -> pa.Array:
    return pc.subtract(a, pc.multiply(pc.divide(a, b), b))


def _pieces(flat: pa.Array, keep: pa.Array, counts: pa.Array) -> pa.Array:
    """The kept units of each row, ``counts`` of them, joined."""
    offsets = pa.concat_arrays([pa.array([0], pa.int64()), pc.cumulative_sum(counts)]).cast(pa.int32())
    return pc.binary_join(pa.ListArray.from_arrays(offsets, pc.filter(flat, keep)), "")


def rearrange(texts: pa.Array, h: list[pa.Array], rate: int = RATE, spm_rate: int = SPM_RATE) -> pa.StructArray:
    """``n, form, prefix_chars, middle_chars, output`` of texts without nulls and their four draws."""
    mark = _separator(texts)
    # every unit is followed by the mark, so each list ends with one empty string more than the text has units
    units = pc.split_pattern(pc.replace_substring_regex(texts, f"({UNIT})", rf"\1{mark}"), mark)
    n = pc.subtract(pc.list_value_length(units).cast(pa.int64()), 1)
    flat, parent = pc.list_flatten(units), pc.list_parent_indices(units)
    ends = pc.cumulative_sum(pc.add(n, 1))
    starts = pc.subtract(ends, pc.add(n, 1))
    ordinal = pc.subtract(pa.array(np.arange(len(flat))), pc.take(starts, parent))
    one, two = _modulo(h[0], pc.add(n, 1)), _modulo(h[1], pc.add(n, 1))
    low, high = pc.min_element_wise(one, two), pc.max_element_wise(one, two)
    before, until = pc.less(ordinal, pc.take(low, parent)), pc.less(ordinal, pc.take(high, parent))
    prefix = _pieces(flat, before, low)
    middle = _pieces(flat, pc.and_(until, pc.invert(before)), pc.subtract(high, low))
    suffix = _pieces(flat, pc.invert(until), pc.subtract(pc.add(n, 1), high))
    plain = pc.or_(
        pc.or_(pc.equal(n, 0), pc.match_substring_regex(texts, "<[PSM]>")), pc.greater_equal(_modulo(h[2], 100), rate)
    )
    first = pc.less(_modulo(h[3], 100), spm_rate)
    form = pc.if_else(plain, "plain", pc.if_else(first, "spm", "psm"))
    output = pc.if_else(
        plain,
        texts,
        pc.if_else(
            first,
            pc.binary_join_element_wise(SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle, ""),
            pc.binary_join_element_wise(PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle, ""),
        ),
    )
    none = pa.scalar(None, pa.int64())
    sizes = [pc.if_else(plain, none, pc.utf8_length(piece).cast(pa.int64())) for piece in (prefix, middle)]
    return pa.StructArray.from_arrays([n, form, *sizes, output], fields=list(_TYPE))


def rebuilt(outputs: pa.Array, forms: pa.Array) -> pa.Array:
    """The texts that were rearranged, from output and form alone."""
    parts = pc.split_pattern_regex(pc.if_else(pc.equal(forms, "plain"), f"{PREFIX}{SUFFIX}{MIDDLE}", outputs), "<[PSM]>")
    first, second, third = (pc.list_element(parts, i) for i in (1, 2, 3))
    spm = pc.equal(forms, "spm")
    return pc.if_else(
        pc.equal(forms, "plain"),
        outputs,
        pc.binary_join_element_wise(pc.if_else(spm, second, first), third, pc.if_else(spm, first, second), ""),
    )


def transformed(docs: DataFrame, seed: int = 1, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """``docs`` plus ``n, form, prefix_chars, middle_chars, output``."""

    @F.arrow_udf(_RESULT)
    def cut(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for texts, *h in batches:
            found = [
                rearrange(texts.slice(at, size), [x.slice(at, size) for x in h], rate, spm_rate) for at, size in _slices(texts)
            ]
            yield pa.concat_arrays(found) if found else pa.array([], _TYPE)

    names = ("n", "form", "prefix_chars", "middle_chars", "output")
    keyed = docs.withColumn("_cut", cut(F.coalesce("text", F.lit("")), *draws(seed, F.col("doc_id"))))
    return keyed.drop(*names).select("*", "_cut.*").drop("_cut")


def restored(docs: DataFrame) -> DataFrame:
    """``docs`` (with ``output`` and ``form``) plus ``restored``, the text before it was rearranged."""

    @F.arrow_udf("string")
    def back(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for outputs, forms in batches:
            found = [rebuilt(outputs.slice(at, size), forms.slice(at, size)) for at, size in _slices(outputs)]
            yield pa.concat_arrays(found) if found else pa.array([], pa.string())

    return docs.withColumn("restored", back("output", "form"))


def report(docs: DataFrame) -> DataFrame:
    found = restored(transformed(docs.select("doc_id", "text")))
    return found.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2("restored", 256).alias("restored_sha256"),
    )


SQL = f"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{UNIT}') AS u,
         sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS d
  FROM documents),
h AS (
  SELECT doc_id, text, u, len(u) AS n, ('0x' || d[1:8])::BIGINT % (len(u) + 1) AS a, ('0x' || d[9:16])::BIGINT % (len(u) + 1) AS b,
         ('0x' || d[17:24])::BIGINT % 100 AS p, ('0x' || d[25:32])::BIGINT % 100 AS s
  FROM t),
c AS (
  SELECT doc_id, text, n, array_to_string(u[1:least(a, b)], '') AS prefix, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS middle,
         array_to_string(u[greatest(a, b) + 1:], '') AS suffix,
         CASE WHEN n = 0 OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR p >= {RATE} THEN 'plain'
              WHEN s < {SPM_RATE} THEN 'spm' ELSE 'psm' END AS form
  FROM h)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle
              ELSE '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle END) AS output_sha256,
       sha256(prefix || middle || suffix) AS restored_sha256
FROM c
"""
