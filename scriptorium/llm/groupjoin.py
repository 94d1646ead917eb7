"""Jaccard self-join of documents on word shingles, by prefix groups, with the classes of linked documents.

A document's set holds the hashes of its distinct shingles. Documents with equal sets form a *class*. All sets are put
in one global order, rare shingles first; two sets with Jaccard at least ``t`` must share a shingle within their first
``n - ceil(t n) + 1`` (the prefix). Classes of the same size whose prefixes are identical form a *group*, which stands in
the prefix index once.

1. A first scan finds shingles that occur in many documents; they come last in the order, so that a passage shared by
   very many documents does not fill the index. The order only steers cost; any order gives the same links.
2. A second scan writes size, class, group, prefix and a bitmap of each document.
3. Among the groups that share a shingle, neighbours by size, pairs with the group of most documents (in one more round:
   of most links), and the members of a group are filtered as pairs by size, position and bitmap bounds; the rest is
   verified on the sets. That is linear in the index, and links most of each component.
4. Groups that share a shingle but are not yet in one component are expanded to their members, filtered and verified
   pair by pair. Pairs inside a component need no proof, as they can change no result. So no link between components
   is lost, and a large group of near copies costs no all-pairs work.

The result is components, not links: it holds no list of linked pairs and no number of links.

Sets are made again from the texts for those classes that a surviving pair names (found by a bit filter of fixed size
over document ids, then by a join), so whole texts are never shuffled.

Defined cases: null and empty texts and texts of blanks have no shingles and link with nothing; texts of fewer words
than ``size`` are one shingle; rows with null ids take part, and a component's id is its smallest id that is not null;
repeated rows are copies; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from scriptorium.llm import base
from scriptorium.llm.base import WORD, row_key
from scriptorium.llm.components import components

SIZE = 5
PERCENT = 80
#: Shingles seen this often (in parts of the data where they occur twice or more) come last in the order …
FREQUENT = 4
#: … but no more than this many shingles, the most frequent ones: 24 MB of hashes and counts in a task.
MAX_FREQUENT = 2_000_000
#: Rounds of pairs with the most linked group, before all pairs that are left.
STAR_ROUNDS = 1
#: Bits of the filter on document ids.
FILTER_BITS = 1 << 24

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_CACHE = 100_000
#: Documents handled at a time, and hashes counted at a time, in a task.
_ROWS, _HASHES = 1000, 1 << 20
_BATCHES = base.BATCHES


def saved(frame: DataFrame, label: str) -> DataFrame:
    """:func:`base.saved`, with small batches between Spark and Python while the frame is made: pairs carry two whole sets."""
    with base.small_batches(frame.sparkSession):
        return base.saved(frame, label)


class _Words(dict):
    """Hashes of words; forgets when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


class Shingler:
    def __init__(self, size: int = SIZE):
        self.size = size
        self.words = _Words()

    def __call__(self, raw: bytes | None) -> np.ndarray:
        """Sorted hashes of the distinct shingles of a text in UTF-8."""
        words = (raw or b"").translate(_FOLD).split()
        if not words:
            return np.empty(0, np.uint64)
        h = np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))
        n = min(self.size, len(h))
        m = len(h) - n + 1
        out = np.full(m, n, np.uint64)
        for i in range(n):
            out = (out ^ h[i : i + m]) * _A
            out ^= out >> np.uint64(29)
        out *= _B
        return np.unique(out ^ (out >> np.uint64(32)))


def _key(data: bytes) -> bytes:
    return xxhash.xxh3_128_digest(data)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first in range(0, batch.num_rows, _ROWS):
            yield batch.slice(first, _ROWS)


def needed(n: np.ndarray, percent: int) -> np.ndarray:
    """Least overlap of a set of size n with any partner: ceil(t n)."""
    return (n * percent + 99) // 100


def _raw(docs: DataFrame) -> DataFrame:
    return docs.select(F.encode("text", "utf-8").alias("raw"))


def frequent_shingles(docs: DataFrame, size: int, frequent: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) and counts of shingles in many different sets; at most ``most`` of them.

    Each task counts its own part and reports what it saw twice or more.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, seen, held, n = Shingler(size), set(), [], 0

        def report() -> pa.RecordBatch:
            found, times = np.unique(np.concatenate(held), return_counts=True)
            at = times >= 2
            return pa.RecordBatch.from_arrays([pa.array(found[at].view(np.int64)), pa.array(times[at])], names=["s", "n"])

        for batch in _parts(batches):
            for raw in batch.column(0):
                found = shingle(raw.as_py())
                key = _key(found.tobytes())
                if key in seen or not len(found):
                    continue
                seen.add(key)
                held.append(found)
                n += len(found)
                if n >= _HASHES:
                    yield report()
                    held, n = [], 0
        if held:
            yield report()

    # what only a handful of near copies share is of no use here
    counted = saved(
        _raw(docs).mapInArrow(count, "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).filter(F.col("n") >= frequent),
        "join-frequent",
    )
    total = counted.agg(F.sum("n")).first()[0] or 0
    # fewer than total / bound shingles reach the bound
    rows = counted.filter(F.col("n") >= max(frequent, total // most)).toArrow()
    found = np.asarray(rows["s"].combine_chunks(), np.int64).view(np.uint64)
    order = np.argsort(found)
    times = np.minimum(np.asarray(rows["n"].combine_chunks(), np.int64), 2**31 - 1).astype(np.int32)
    return found[order], times[order]


class Frequent:
    """Look-up of frequent shingles: a small bit table first, then the sorted hashes."""

    def __init__(self, hashes: np.ndarray, times: np.ndarray):
        self.hashes, self.times = hashes, times
        self.maybe = np.zeros(1 << 24, np.bool_)
        self.maybe[hashes >> np.uint64(40)] = True

    def rare_first(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of a set in the global order, and their counts: first those that are not frequent (count 0)."""
        common = self.maybe[found >> np.uint64(40)]
        if not common.any():
            return found, np.zeros(len(found), np.int32)
        some = found[common]
        at = np.minimum(np.searchsorted(self.hashes, some), len(self.hashes) - 1)
        hit = self.hashes[at] == some
        common[np.flatnonzero(common)[~hit]] = False
        at = at[hit]
        at = at[np.lexsort((at, self.times[at]))]
        rare = found[~common]
        return np.concatenate([rare, self.hashes[at]]), np.concatenate([np.zeros(len(rare), np.int32), self.times[at]])


def _bits(found: np.ndarray, times: int) -> np.ndarray:
    """Bitmap of a set with about ``times`` bits for each element (64 at least, 4,096 ``times`` at most), in 64-bit words."""
    width = times << min(12, max(6, int(len(found)).bit_length()))
    bits = np.zeros(width, np.uint8)
    bits[(found >> np.uint64(20)) & np.uint64(width - 1)] = 1
    return np.packbits(bits).view(np.int64)


def profiles(docs: DataFrame, size: int = SIZE, percent: int = PERCENT, frequent: int = FREQUENT, most: int = MAX_FREQUENT) -> DataFrame:
    """One row per document: doc_id, id_hash, n, class, group, prefix, the prefix's last
    place in the order (times, last), bits, wide. Sizes of 0 have no class."""
    last = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, size, frequent, most))

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, frequent = Shingler(size), Frequent(*last.value)
        for batch in _parts(batches):
            sizes, classes, groups, prefixes, times, lasts, bitmaps, wider = [], [], [], [], [], [], [], []
            for raw in batch.column(0):
                found = shingle(raw.as_py())
                n = len(found)
                sizes.append(n)
                if not n:
                    for column in (classes, groups, prefixes, times, lasts, bitmaps, wider):
                        column.append(None)
                    continue
                length = n - int(needed(n, percent)) + 1
                prefix, counts = (x[:length] for x in frequent.rare_first(found))
                times.append(int(counts[-1]))
                lasts.append(int(prefix[-1]) - (1 << 63))
                classes.append(_key(found.tobytes()))
                groups.append(int.from_bytes(_key(prefix.tobytes() + n.to_bytes(8, "little"))[:8], "little", signed=True))
                prefixes.append(prefix.view(np.int64))
                bitmaps.append(_bits(found, 1))
                wider.append(_bits(found, 8))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(1),
                    batch.column(2),
                    pa.array(sizes, pa.int64()),
                    pa.array(classes, pa.binary()),
                    pa.array(groups, pa.int64()),
                    pa.array(prefixes, pa.list_(pa.int64())),
                    pa.array(times, pa.int64()),
                    pa.array(lasts, pa.int64()),
                    pa.array(bitmaps, pa.list_(pa.int64())),
                    pa.array(wider, pa.list_(pa.int64())),
                ],
                names=["doc_id", "id_hash", "n", "class", "group", "prefix", "times", "last", "bits", "wide"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select(F.encode("text", "utf-8").alias("raw"), "doc_id", F.xxhash64("doc_id").alias("id_hash")).mapInArrow(
        profile,
        f"doc_id {kind}, id_hash long, n long, class binary, group long, prefix array<long>, times long, last long, bits array<long>, wide array<long>",
    )


def _size_fits(a: str, b: str, percent: int):
    """Jaccard of sets of these sizes can reach the threshold; null if there is no other set."""
    return (F.col(a) * 100 >= F.col(b) * percent) & (F.col(b) * 100 >= F.col(a) * percent)


def _place_fits(n1: str, p1: str, n2: str, p2: str, percent: int, k1: str | None = None, k2: str | None = None):
    """Overlap is at most what lies before the shared shingle (k of it, if known, can be shared), it, and what follows."""
    most = F.least(k1 or p1, k2 or p2) + 1 + F.least(F.col(n1) - F.col(p1), F.col(n2) - F.col(p2)) - 1
    return most * (100 + percent) >= (F.col(n1) + F.col(n2)) * percent


def _bits_fit(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes whose bitmaps allow the overlap they need: first the small ones, then the wide ones."""
    return _fit(_fit(pairs, sketches, "bits", percent), sketches, "wide", percent)


def _fit(pairs: DataFrame, sketches: DataFrame, bits: str, percent: int) -> DataFrame:
    one = sketches.select(F.col("class").alias("a"), F.col("n").alias("n_a"), F.col(bits).alias("bits_a"))
    two = sketches.select(F.col("class").alias("b"), F.col("n").alias("n_b"), F.col(bits).alias("bits_b"))
    both = pairs.join(one, "a").join(two, "b").filter(_size_fits("n_a", "n_b", percent))
    # sizes within the threshold differ by one doubling at most: the wider bitmap is folded to the narrower
    width = F.least(F.size("bits_a"), F.size("bits_b"))

    def folded(bits: str):
        rest = F.slice(F.col(bits), width + 1, width)
        return F.when(
            F.size(bits) > width, F.zip_with(F.slice(F.col(bits), F.lit(1), width), rest, lambda x, y: x.bitwiseOR(y))
        ).otherwise(F.col(bits))

    both = both.withColumn("fa", folded("bits_a")).withColumn("fb", folded("bits_b"))
    missing = lambda x, y: F.aggregate(
        F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q)))), F.lit(0), lambda s, c: s + c
    )
    most = F.least(F.col("n_a") - missing("fa", "fb"), F.col("n_b") - missing("fb", "fa"))
    return both.filter(most * (100 + percent) >= (F.col("n_a") + F.col("n_b")) * percent).select("a", "b")


@F.arrow_udf(LongType())
def _overlap(one: pa.Array, two: pa.Array) -> pa.Array:
    sets = lambda x: np.frombuffer(x.as_buffer(), np.uint64)
    return pa.array([len(np.intersect1d(sets(a), sets(b), assume_unique=True)) for a, b in zip(one, two, strict=True)], pa.int64())


def _verified(pairs: DataFrame, docs: DataFrame, owners: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The pairs (a, b) of classes, and those that are links. ``owners`` has a document's id_hash for each class."""
    pairs = saved(pairs, "join-pairs")
    if pairs.isEmpty():
        return pairs, pairs
    named = pairs.select(F.col("a").alias("class")).unionByName(pairs.select(F.col("b").alias("class"))).distinct()
    bit = F.pmod("id_hash", F.lit(FILTER_BITS)).cast("int")
    byte, mask = F.floor(bit / 8).cast("int"), F.expr(f"shiftleft(1, cast(pmod(id_hash, {FILTER_BITS}) as int) % 8)")
    rows = owners.join(named, "class").groupBy(byte.alias("byte")).agg(F.bit_or(mask).alias("bits")).toArrow()
    table = np.zeros(FILTER_BITS // 8, np.uint8)
    table[np.asarray(rows["byte"].combine_chunks())] = np.asarray(rows["bits"].combine_chunks())
    chosen = docs.sparkSession.createDataFrame([(bytearray(table.tobytes()),)], "b binary").select("b").scalar()
    found = F.conv(F.hex(F.substring(chosen, byte + 1, F.lit(1))), 16, 10).cast("int")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(size)
        for batch in _parts(batches):
            sets = [shingle(raw.as_py()) for raw in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([_key(s.tobytes()) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())],
                names=["class", "members"],
            )

    texts = docs.select(F.encode("text", "utf-8").alias("raw"), F.xxhash64("doc_id").alias("id_hash"))
    made = texts.filter(found.bitwiseAND(mask) != 0).select("raw").mapInArrow(make, "class binary, members binary")
    sets = saved(made.join(named, "class").groupBy("class").agg(F.first("members").alias("members")), "join-sets")
    one = sets.select(F.col("class").alias("a"), F.col("members").alias("set_a"))
    two = sets.select(F.col("class").alias("b"), F.col("members").alias("set_b"))
    both = pairs.join(one, "a").join(two, "b")
    sizes = (F.octet_length("set_a") + F.octet_length("set_b")) / 8
    common = both.withColumn("common", _overlap("set_a", "set_b")).withColumn("sizes", sizes)
    is_link = F.col("common") * 100 >= (F.col("sizes") - F.col("common")) * percent
    return pairs, saved(common.filter(is_link).select("a", "b"), "join-links")


def linked(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n, class, component): every document's set size, class and component of classes (null without words)."""
    rows = saved(profiles(docs, size, percent), "join-profiles")
    filled = rows.filter("n > 0")
    classes = saved(
        filled.groupBy("class").agg(
            F.first("n").alias("n"), F.first("group").alias("group"), F.min("id_hash").alias("id_hash"), F.first("bits").alias("bits"), F.first("wide").alias("wide")
        ),
        "join-classes",
    )
    sketches, owners = classes.select("class", "n", "bits", "wide"), classes.select("class", "id_hash")
    groups = filled.groupBy("group").agg(
        F.first("n").alias("n"), F.min("class").alias("lead"), F.first("prefix").alias("prefix")
    )
    by_size = Window.partitionBy("shingle").orderBy("n", "group")
    fields = ["group", "n", "place", "lead"]
    index = groups.select("group", "n", "lead", F.posexplode("prefix").alias("place", "shingle"))
    index = index.withColumns(
        {f"{side}_{c}": f(c).over(by_size) for side, f in (("before", F.lag), ("after", F.lead)) for c in (fields if side == "before" else ["n"])}
    ).filter(
        F.coalesce(_size_fits("n", "before_n", percent), F.lit(False)) | F.coalesce(_size_fits("n", "after_n", percent), F.lit(False))
    )
    # entries that have some partner of fitting size
    index = saved(index.drop("after_n"), "join-index")
    neighbours = index.filter(
        _size_fits("n", "before_n", percent) & _place_fits("n", "place", "before_n", "before_place", percent)
    ).select(F.least("lead", "before_lead").alias("a"), F.greatest("lead", "before_lead").alias("b"))
    leads = classes.groupBy("group").agg(F.min("class").alias("lead"), F.count("*").alias("of")).filter("of > 1")
    members = classes.join(leads, "group").filter("class <> lead").select(F.col("lead").alias("a"), F.col("class").alias("b"))

    # shingles of a prefix that are not in the index are in no prefix of a group of fitting size
    bounds = saved(
        index.groupBy("group").agg(F.count("*").alias("indexed")).join(
            filled.groupBy("group").agg(F.first("n").alias("n"), F.first("times").alias("times"), F.first("last").alias("last")), "group"
        ).select(
            "group",
            F.struct("times", "last").alias("end"),
            (F.floor((F.col("n") * percent + 99) / 100) - 1 + F.col("indexed")).alias("possible"),
        ),
        "join-bounds",
    )
    tested = links = None
    placed = classes.select("class", "group", F.col("class").alias("component"))
    weights = filled.groupBy("class").agg(F.count("*").alias("weight"))
    for step in range(STAR_ROUNDS + 2):
        if step == 0:
            pairs = neighbours.unionByName(members).unionByName(_stars(index, placed, weights, percent)).distinct()
        elif step <= STAR_ROUNDS:
            weights = saved(
                links.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count("*").alias("weight")),
                "join-weights",
            )
            pairs = _stars(index, placed, weights, percent)
        else:
            pairs = _across(index, placed, bounds, percent)
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        more_tested, more = _verified(_bits_fit(pairs, sketches, percent), docs, owners, size, percent)
        tested = more_tested if tested is None else tested.unionByName(more_tested)
        links = more if links is None else links.unionByName(more)
        if step == 0 or not more.isEmpty():
            joined = components(links)
            placed = saved(
                classes.select("class", "group")
                .join(joined, F.col("class") == F.col("node"), "left")
                .select("class", "group", F.coalesce("component", "class").alias("component")),
                "join-placed",
            )
    return rows.select("doc_id", "n", "class").join(placed.select("class", "component"), "class", "left").select(
        "doc_id", "n", "class", "component"
    )


def _stars(index: DataFrame, placed: DataFrame, weights: DataFrame, percent: int) -> DataFrame:
    """Pairs of each group's lead with the lead of most weight among those that share an index shingle with it.

    Near copies often link to the text they were made from and not to each other; that text has most copies or links.
    """
    entries = (
        index.select("shingle", "n", "place", F.col("lead").alias("class"))
        .join(placed.select("class", "component"), "class")
        .join(weights, "class", "left")
        .select("shingle", F.coalesce("weight", F.lit(0)).alias("w"), "class", "n", "place", "component")
    )
    center = entries.groupBy(F.col("shingle").alias("s")).agg(F.max(F.struct("w", "class", "n", "place", "component")).alias("top"))
    return (
        entries.join(center.select("s", *[F.col(f"top.{c}").alias(f"top_{c}") for c in ("class", "n", "place", "component")]), F.col("shingle") == F.col("s"))
        .filter("component <> top_component")
        .filter(_size_fits("n", "top_n", percent) & _place_fits("n", "place", "top_n", "top_place", percent))
        .select(F.least("class", "top_class").alias("a"), F.greatest("class", "top_class").alias("b"))
        .distinct()
    )


def _across(index: DataFrame, placed: DataFrame, bounds: DataFrame, percent: int) -> DataFrame:
    """Pairs of classes in different components that share an index shingle, or a group, and fit in size and place.

    Of two sets, take the one whose prefix ends first in the global order: what it shares with the other within its
    prefix lies in both prefixes, so it shares at most its indexed prefix shingles and what follows its prefix. For near
    copies that differ in their own rare shingles this bound leaves few pairs.
    """
    inside = placed.groupBy("group").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    torn = placed.join(inside.filter("low <> high").select("group"), "group", "left_semi")
    # shared shingles up to a place are in both prefixes, hence indexed: their number counts, not the place
    before = F.row_number().over(Window.partitionBy("group").orderBy("place")) - 1
    entries = index.select("shingle", "group", "n", "place", before.alias("known")).join(
        placed.select("group", "component").distinct(), "group"
    )
    mixed = entries.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    previous = F.lag("shingle").over(Window.partitionBy("group").orderBy("place"))
    entries = entries.join(mixed.filter("low <> high").select("shingle"), "shingle", "left_semi").join(bounds, "group")
    entries = saved(entries.withColumn("previous", previous), "join-mixed")
    pairs = _meeting(entries, percent)
    torn_sides = torn.select(F.col("group").alias("g1"), F.col("component").alias("c1")).distinct()
    torn_pairs = (
        torn_sides.join(torn_sides.select("g1", F.col("c1").alias("c2")), "g1")
        .filter("c1 < c2")
        .select("g1", "c1", F.col("g1").alias("g2"), "c2")
    )
    members = placed.select("group", "component", "class")
    return (
        pairs.unionByName(torn_pairs)
        .distinct()
        .join(members.select(F.col("group").alias("g1"), F.col("component").alias("c1"), F.col("class").alias("a")), ["g1", "c1"])
        .join(members.select(F.col("group").alias("g2"), F.col("component").alias("c2"), F.col("class").alias("b")), ["g2", "c2"])
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )


def _sides(entries: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Entries with short names, once in their own band of sizes and once in it and those beside it."""
    # sizes that fit are at most one band apart
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(100 / percent))).cast("int")
    named = {"component": "c", "group": "g", "n": "n", "place": "p", "known": "k", "end": "e", "possible": "m", "previous": "v"}
    fields = tuple(named)
    one = entries.select("shingle", band.alias("band"), *[F.col(c).alias(named[c] + "1") for c in fields])
    two = entries.select(
        "shingle", F.explode(F.array(band - 1, band, band + 1)).alias("band"), *[F.col(c).alias(named[c] + "2") for c in fields]
    )
    return one, two


def _parted(before_1, before_2):
    """Two entries of a shingle have no common one right before it."""
    return ~F.coalesce(before_1 == before_2, F.lit(False))


def _held(one: DataFrame, two: DataFrame, percent: int) -> DataFrame:
    """Entries of components with the components after theirs that may fit them at their shingle.

    What any entry of a component can share at most, and its sizes, rule out most pairs of components. An entry of the
    first component is then held against these figures of the second: a large component meets many small ones, each
    of which fits only few of its entries. Entries with the same shingle before them meet there already: a pair is made
    once for each run of shingles that both have, and at the first of these all bounds hold for a link.
    """

    def figures(rows: DataFrame, i: int) -> DataFrame:
        """Of a component's entries: known (K), following (Q), both (R), size (S to T), end (A to B), possible (M) and the
        previous shingle (V), if it is the same for all."""
        follow = F.col(f"n{i}") - F.col(f"p{i}")
        return rows.groupBy("shingle", "band", f"c{i}").agg(
            F.max(f"k{i}").alias(f"K{i}_"), F.max(follow).alias(f"Q{i}_"), F.max(F.col(f"k{i}") + follow).alias(f"R{i}_"),
            F.min(f"n{i}").alias(f"S{i}_"), F.max(f"n{i}").alias(f"T{i}_"),
            F.min(f"e{i}").alias(f"A{i}_"), F.max(f"e{i}").alias(f"B{i}_"), F.max(f"m{i}").alias(f"M{i}_"),
            F.when((F.min(f"v{i}") == F.max(f"v{i}")) & (F.count(f"v{i}") == F.count("*")), F.min(f"v{i}")).alias(f"V{i}_"),
        )

    def able(known, follow, both, low, high, first, last, possible, before):
        """Some entry with the figures given can fit some entry of the second component."""
        shared = F.least(F.least(known, "K2_") + F.least(follow, "Q2_"), both, "R2_")
        bound = F.greatest(F.when(first <= F.col("B2_"), possible).otherwise(0), F.when(last > F.col("A2_"), F.col("M2_")).otherwise(0))
        sizes = (high * 100 >= F.col("S2_") * percent) & (F.col("T2_") * 100 >= low * percent)
        return sizes & (F.least(shared, bound) * (100 + percent) >= (low + F.col("S2_")) * percent) & _parted(before, F.col("V2_"))

    col = F.col
    meet = (
        figures(one, 1)
        .join(figures(two, 2), ["shingle", "band"])
        .filter(col("c1") < col("c2"))
        .filter(able(col("K1_"), col("Q1_"), col("R1_"), col("S1_"), col("T1_"), col("A1_"), col("B1_"), col("M1_"), col("V1_")))
        .select("shingle", "band", "c1", "c2", "K2_", "Q2_", "R2_", "S2_", "T2_", "A2_", "B2_", "M2_", "V2_")
    )
    follow = col("n1") - col("p1")
    return meet.join(one, ["shingle", "band", "c1"]).filter(
        able(col("k1"), follow, col("k1") + follow, col("n1"), col("n1"), col("e1"), col("e1"), col("m1"), col("v1"))
    ).select(*one.columns, "c2")


def _meeting(entries: DataFrame, percent: int) -> DataFrame:
    """(g1, c1, g2, c2): groups of different components with entries of one shingle that fit in size, place and bounds."""
    one, two = _sides(entries, percent)
    return (
        _held(one, two, percent)
        .join(two, ["shingle", "band", "c2"])
        .filter(
            _size_fits("n1", "n2", percent)
            & _place_fits("n1", "p1", "n2", "p2", percent, "k1", "k2")
            & _parted(F.col("v1"), F.col("v2"))
            & (F.when(F.col("e1") <= F.col("e2"), F.col("m1")).otherwise(F.col("m2")) * (100 + percent) >= (F.col("n1") + F.col("n2")) * percent)
        )
        .select("g1", "c1", "g2", "c2")
        .distinct()
    )


def report(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every document."""
    found = saved(linked(docs.select("doc_id", "text"), size, percent), "join-documents")
    ids = found.filter("component is not null").groupBy(F.col("component").alias("c")).agg(F.min("doc_id").alias("smallest"))
    return found.join(ids, F.col("component") == F.col("c"), "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("smallest")).alias("component_id"),
    )


def keep_one(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """One row of each component, that with the smallest id, and all rows without words. Columns unchanged.

    Ids come before nulls: of a component with null ids only, one row stays. Of a component's rows with the same id it is
    one row of the text with the smallest key.
    """
    named = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), row_key().alias("key"))
    found = linked(docs.select(named.alias("doc_id"), "text"), size, percent)
    first = found.filter("component is not null").groupBy("component").agg(F.min("doc_id").alias("first"))
    chosen = first.select(F.col("first.key").alias("_key"))
    worded = F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    # copies of a row are in one component, so a key stands for one chosen row
    kept = docs.filter(worded).withColumn("_key", row_key()).join(chosen, "_key", "left_semi").dropDuplicates(["_key"])
    return kept.select(docs.columns).unionByName(docs.filter(~worded))


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) c ON c.a = d.doc_id
"""
