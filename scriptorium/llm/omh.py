"""Order MinHash fingerprints: sketches whose likeness follows edit distance rather than shared content alone.

A text's words give k-mers of ``k`` words, each with its occurrence number, so that repeats differ. One hash places
every numbered k-mer on a circle; component ``j`` of ``m`` starts at the j-th of ``m`` equal parts of the circle and
selects the next ``l`` k-mers (the minimal ones in the order that begins there), restores their order in the text and
hashes that tuple to 16 bits. Two fingerprints are as alike as their share of equal components; moving passages about
changes tuples even where all k-mers stay.

Everything is a column expression on one row: two sorts of the k-mer hashes and ``m`` look-ups, so a text costs
``n log n``; nothing is exploded. Hash and position share one long (42 and 22 bits).

Defined cases: null and empty texts have one empty k-mer, so they equal each other; a text of fewer than ``k`` words is
one k-mer; with fewer than ``l`` k-mers they recur around the circle; positions beyond four million wrap around; equal
texts have equal fingerprints.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm.base import BLANKS, once, saved, text_or_empty

K, L, M = 5, 2, 64
_PLACE = (1 << 22) - 1
_TAIL = (1 << 41) - 1


def _numbered(sorted_kmers: Column) -> Column:
    """Hashes of k-mers with their occurrence numbers, from k-mer hashes sorted with their positions."""
    high = F.lit(~_PLACE)

    def same(at: Column, value: Column) -> Column:
        return F.get(sorted_kmers, at).bitwiseAND(high) == value.bitwiseAND(high)

    def number(value: Column, i: Column) -> Column:
        # equal k-mers are neighbours: how many come before is found by halving steps
        steps = F.array(*[F.lit(1 << s) for s in range(22, -1, -1)])
        return F.aggregate(
            steps, F.lit(0), lambda n, step: F.when((i - n - step >= 0) & same(i - n - step, value), n + step).otherwise(n)
        )

    def hashed(value: Column, i: Column) -> Column:
        renamed = F.xxhash64(value.bitwiseAND(high), number(value, i)).bitwiseAND(high).bitwiseOR(value.bitwiseAND(F.lit(_PLACE)))
        return F.when((i > 0) & same(i - 1, value), renamed).otherwise(value)

    return F.transform(sorted_kmers, hashed)


def fingerprint(text: Column, k: int = K, l: int = L, m: int = M) -> Column:
    """Array of ``m`` integers of 16 bits; ``m`` is a power of two."""
    part = (1 << 64) // m
    marks = [-(1 << 63) + j * part for j in range(m)]
    place = F.lit(_PLACE)

    def kmers(words: Column) -> Column:
        last = F.greatest(F.size(words) - (k - 1), F.lit(1))
        return F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice(words, i, F.lit(k))).bitwiseAND(F.lit(~_PLACE)))

    def numbered(found: Column) -> Column:
        placed = F.transform(found, lambda value, i: value.bitwiseOR((i + 1).cast("long").bitwiseAND(place)))
        # only texts with repeats need their k-mers side by side
        return F.when(F.size(F.array_distinct(found)) == F.size(found), placed).otherwise(once(F.sort_array(placed), _numbered))

    def in_text_order(value: Column) -> Column:
        return F.shiftleft(value.bitwiseAND(place), 41).bitwiseOR(F.shiftrightunsigned(value, 23))

    def is_mark(value: Column) -> Column:
        # marks are the multiples of a part; positions begin with 1, so a k-mer's low bits are not all zero
        return value.bitwiseAND(F.lit(part - 1)) == 0

    def components(marked: Column) -> Column:
        def component(circle: Column, at: Column) -> Column:
            def of(found: Column, j: Column) -> Column:
                first = found - j
                chosen = [in_text_order(F.get(circle, F.pmod(first + t, F.size(circle)))) for t in range(l)]
                return F.xxhash64(F.transform(F.sort_array(F.array(*chosen)), lambda c: c.bitwiseAND(F.lit(_TAIL))))

            return F.transform(at, lambda found, j: of(found, j).bitwiseAND(F.lit(0xFFFF)).cast("int"))

        at = F.filter(F.sequence(F.lit(0), F.size(marked) - 1), lambda i: is_mark(F.get(marked, i)))
        return once(F.filter(marked, lambda value: ~is_mark(value)), lambda circle: component(circle, at))

    return once(
        F.split(F.coalesce(text, F.lit("")), f"[{BLANKS}]+"),
        lambda words: once(
            kmers(words),
            lambda found: once(F.sort_array(F.concat(numbered(found), F.array(*[F.lit(x) for x in marks]))), components),
        ),
    )


def likeness(one: Column, other: Column) -> Column:
    """Share of equal components, 0 to 1."""
    equal = F.zip_with(one, other, lambda a, b: (a == b).cast("int"))
    return F.aggregate(equal, F.lit(0), lambda n, x: n + x) / F.size(one)


def as_text(components: Column) -> Column:
    return F.array_join(F.transform(components, lambda c: F.lower(F.lpad(F.hex(c), 4, "0"))), "")


def following(docs: DataFrame) -> DataFrame:
    """(doc_id, n, next_id): the next greater id, after the last the first; n is the longest text of an id.

    Ids alone are put in order, by ranges; only the first id of each range is seen together.
    """
    ids = docs.filter("doc_id is not null").groupBy("doc_id").agg(F.max(F.length("text")).alias("n"))
    ranged = saved(ids.repartitionByRange("doc_id").withColumn("part", F.spark_partition_id()), "omh-order")
    firsts = ranged.groupBy("part").agg(F.min("doc_id").alias("first"))
    by_part = Window.orderBy("part")
    after = firsts.select(
        F.col("part").alias("p"),
        F.coalesce(F.lead("first").over(by_part), F.min("first").over(Window.partitionBy())).alias("next_first"),
    )
    inside = F.lead("doc_id").over(Window.partitionBy("part").orderBy("doc_id"))
    return (
        ranged.withColumn("inside", inside)
        .join(after, F.col("part") == F.col("p"))
        .select("doc_id", "n", F.coalesce("inside", "next_first").alias("next_id"))
    )


def report(docs: DataFrame, k: int = K, l: int = L, m: int = M) -> DataFrame:
    """Fingerprints of every text, of its edited form, and how alike it is to that and to the next document.

    The edited form replaces the last quarter of the characters by as many from the start of the next document. Texts
    are placed by id once; the next document sends only its beginning, later only its fingerprint. Rows with a repeated
    id share the next document; where that id repeats, its smallest beginning and its smallest fingerprint count. Rows
    with null ids have no next document.
    """
    texts = docs.select("doc_id", text_or_empty().alias("text"))
    order = saved(following(texts), "omh-next")
    # the same rows on both sides, so that the texts' exchange is made once and used twice
    named = texts.filter("doc_id is not null")
    needs = order.select(F.col("next_id").alias("id"), F.col("doc_id").alias("to"), F.floor(F.col("n") / 4).cast("int").alias("need"))
    sent = (
        named.join(needs, F.col("doc_id") == F.col("id"))
        .groupBy("to")
        .agg(F.min(F.expr("substring(text, 1, need)")).alias("begin"))
    )
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.coalesce("begin", F.lit("")), F.lit(1), cut))
    both = named.join(sent, F.col("doc_id") == F.col("to"), "left").unionByName(
        texts.filter("doc_id is null"), allowMissingColumns=True
    )
    printed = saved(
        both.select(
            "doc_id",
            n.cast("long").alias("n_chars"),
            F.sha2(edited.cast("binary"), 256).alias("edited_sha256"),
            fingerprint(F.col("text"), k, l, m).alias("fp"),
            fingerprint(edited, k, l, m).alias("edited_fp"),
        ),
        "omh-printed",
    )
    following_fp = (
        order.select(F.col("doc_id").alias("to"), "next_id")
        .join(printed.select(F.col("doc_id").alias("id"), F.col("fp").alias("next_fp")), F.col("next_id") == F.col("id"))
        .groupBy("to")
        .agg(F.min("next_fp").alias("next_fp"))
    )
    return printed.join(following_fp, F.col("doc_id") == F.col("to"), "left").select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("fp")).alias("fingerprint"),
        as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        F.coalesce(likeness(F.col("fp"), F.col("next_fp")), F.lit(0.0)).alias("near_next"),
    )
