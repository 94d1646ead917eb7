"""The best short window of a body, with matches marked.

Works on the few rows that survive the top-k, so array functions over one row's tokens are enough. They are
written as SQL text, which the planner parses at once; building them call by call takes longer than running them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.decode import MAX_FILE_BYTES
from scriptorium.functions.text import RAW_TOKEN, tokens
from scriptorium.operators.query import Leaf

# Window length in tokens, markers, and the bonus for starting at a sentence.
WINDOW = 16
OPEN, CLOSE, CUT = ">>", "<<", "…"
FIRST_SENTENCE, SENTENCE = 120, 100
FIRST_HIT, REPEAT_HIT = 1000, 1

_NO_HITS = "CAST(array() AS array<struct<off:int,leaf:int,last:int>>)"


# Steps of a binary search over the tokens of the largest document.
_STEPS = MAX_FILE_BYTES.bit_length()


def _count(array: str, field: str, test: str, value: str) -> str:
    """How many leading elements of a sorted array have ``field test value``, by binary search."""
    middle = "CAST((s.lo + s.hi) DIV 2 AS int)"
    after, before = f"named_struct('lo', {middle} + 1, 'hi', s.hi)", f"named_struct('lo', s.lo, 'hi', {middle})"
    return f"""aggregate(sequence(1, {_STEPS}), named_struct('lo', 0, 'hi', size({array})), (s, i) -> if(s.lo >= s.hi, s,
        if(get({array}, {middle}){field} {test} {value}, {after}, {before})), s -> s.lo)"""


def _leaf_hits(leaf: Leaf, number: int) -> str:
    """Where a leaf starts in ``_terms``, as ``(off, leaf, last)`` structs; empty unless it counts."""
    tests = []
    for k, token in enumerate(leaf.tokens):
        term = f"get(_terms, i + {k})"
        is_start = leaf.is_prefix and k == len(leaf.tokens) - 1
        tests.append(f"startswith({term}, '{token}')" if is_start else f"{term} = '{token}'")
    places = f"filter(_places, i -> {' AND '.join(tests)})"
    size = len(leaf.tokens) - 1
    found = f"transform({places}, i -> named_struct('off', i, 'leaf', {number}, 'last', i + {size}))"
    return f"if(get(active, {number}), {found}, {_NO_HITS})"


def _pool(leaves: int) -> str:
    """Candidate windows with the hits inside, in the order they compete.

    One starts at each hit, one at the sentence of each hit that does not begin it. Hits are sorted and at
    most ``leaves`` share an offset, so a window's hits are a short slice, found by binary search.
    """
    before, until = _count("_hits", ".off", "<", "s0"), _count("_hits", ".off", "<=", "s0")
    at_hits = f"""transform(_hits, (x, k) -> named_struct(
        'inside', filter(slice(_hits, greatest(k + 2 - {leaves}, 1), {leaves * (WINDOW + 1)}),
                         h -> h.off >= x.off AND h.off < x.off + {WINDOW}),
        'bonus', 0, 'nth', 2 * k, 'at', x.off))"""
    at_sentences = f"""transform(_sentences, s0 -> named_struct(
        'inside', filter(slice(_hits, {before} + 1, {leaves * WINDOW}), h -> h.off < s0 + {WINDOW}),
        'bonus', if(s0 = 0, {FIRST_SENTENCE}, {SENTENCE}), 'nth', 2 * {until} + 1, 'at', s0))"""
    return f"concat({at_hits}, if(size(_terms) > {WINDOW}, {at_sentences}, slice({at_sentences}, 1, 0)))"


def _best_start() -> str:
    """Start of the best candidate; windows that begin at a hit are shifted to have their hits in the middle."""
    kinds = "size(array_distinct(transform(c.inside, h -> h.leaf)))"
    points = f"{kinds} * {FIRST_HIT} + (size(c.inside) - {kinds}) * {REPEAT_HIT} + c.bonus"
    first, last = "get(c.inside, 0).off", "element_at(c.inside, -1).last + 1"
    half = f"CAST(({WINDOW} - ({last} - {first})) DIV 2 AS int)"
    centred = f"greatest(least({first} - {half}, size(_terms) - {WINDOW}), 0)"
    rated = f"""transform(_pool, c -> named_struct('points', {points}, 'order', -c.nth,
        'start', if(c.nth % 2 = 0, {centred}, c.at)))"""
    return f"coalesce(array_max({rated}).start, 0)"


def _piece() -> str:
    """One token of the window with what precedes it, and its markers."""
    opens = (
        "exists(_hits, h -> h.off = p) AND NOT exists(_hits, h -> h.off < p AND h.last >= p) AND p > _muted"
    )
    closes = (
        "exists(_hits, h -> h.off <= p AND h.last >= p) AND p > _muted "
        "AND NOT (exists(_hits, h -> h.off <= p AND h.last > p) AND p + 1 < _e)"
    )
    return f"""concat(if(p > _b OR p = 0, get(_gaps, p), ''), if({opens}, '{OPEN}', ''), get(_raw, p),
        if({closes}, '{CLOSE}', ''))"""


def add_snippet(rows: DataFrame, leaves: list[Leaf], body: str = "body", out: str = "snippet") -> DataFrame:
    """Add the snippet column. ``active`` says which of ``leaves`` count for each row."""
    keep = [c for c in rows.columns if c != out]
    found = [_leaf_hits(leaf, i) for i, leaf in enumerate(leaves) if leaf.column in (None, "body")]
    base = rows.select(
        *keep,
        tokens(F.col(body)).alias("_terms"),
        F.regexp_extract_all(F.col(body), F.lit(RAW_TOKEN), F.lit(0)).alias("_raw"),
        F.split(F.col(body), RAW_TOKEN, -1).alias("_gaps"),
    ).withColumn("_places", F.expr("transform(_terms, (t, i) -> i)"))
    base = base.withColumns(
        {
            "_hits": F.expr(f"sort_array(concat({', '.join([_NO_HITS, *found])}))"),
            "_starts": F.filter(
                "_places", lambda i: (i == 0) | F.get("_gaps", i).rlike("[.:][ \\t\\n\\r]+$")
            ),
        }
    )
    sentence = f"nullif(get(_starts, {_count('_starts', '', '<=', 'x.off')} - 1), x.off)"
    base = base.withColumn(
        "_sentences", F.expr(f"array_compact(array_distinct(transform(_hits, x -> {sentence})))")
    )
    base = base.withColumn("_pool", F.expr(_pool(max(len(found), 1))))
    base = base.withColumn("_b", F.expr(_best_start()))
    # A match that begins before the window stays unmarked up to the end of its merged run.
    muted = """if(exists(_hits, h -> h.off < _b AND h.last >= _b),
        coalesce(array_min(filter(slice(_places, _b + 1, _e - _b), p -> NOT exists(_hits, h -> h.off <= p AND h.last > p))), _e), -1)"""
    base = base.withColumn("_e", F.expr(f"least(_b + {WINDOW}, size(_terms))"))
    base = base.withColumn("_muted", F.expr(muted))
    text = f"""concat(if(_b > 0, '{CUT}', ''),
        array_join(transform(slice(_places, _b + 1, _e - _b), p -> {_piece()}), ''),
        if(_e < size(_terms), '{CUT}', element_at(_gaps, -1)))"""
    return base.select(*keep, F.expr(text).alias(out))
