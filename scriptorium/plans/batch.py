"""Many searches in one job.

A clause table describes each query as required slots of alternatives plus excluded slots. The hits of all leaves are found
document by document (:mod:`scriptorium.operators.leaves`) and written as one row for each path, so that queries are
judged without another shuffle. A query is driven by its rarest required slot: its other slots are only looked up for
documents that are candidates already.

The best ``limit`` matches are found in two phases. The part of a score that the driving slot gives is known for each
candidate; what its other slots can add at most is known for each block of neighbouring documents, from the highest part
of each leaf in the block. The candidates with the highest bounds are scored first, and of the others only those whose
bound reaches the ``limit``-th of these scores.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from scriptorium.functions.bm25 import B, K1, idf, term_score
from scriptorium.functions.text import tokens
from scriptorium.operators import leaves as packing
from scriptorium.operators.filters import check_limit, has_extension, in_subtree
from scriptorium.operators.match import place_of
from scriptorium.operators.postings import PLACE, path_shard, shard_column
from scriptorium.operators.query import FIELD_NAMES
from scriptorium.operators.rank import top_k_per_query
from scriptorium.plans.corpus import Corpus, settings
from scriptorium.session import shared_dir

#: Documents of a block, as a power of two, and candidates that are scored first, for each row asked for.
BLOCK_LOG2, FIRST = 12, 2
#: Rows of clauses that are judged at a time, about.
JUDGED_ROWS = 1_000_000


def _check(clauses: DataFrame) -> None:
    """Reject malformed clauses; looks at the clause table only."""
    known = F.col("field").isNull() | F.lower("field").isin(*FIELD_NAMES)
    bad = clauses.filter(~known | ~F.col("kind").isin("word", "phrase", "prefix")).limit(1).collect()
    if bad:
        raise ValueError(f"unsupported clause {bad[0].asDict()}")
    negative = clauses.groupBy("query_id").agg(F.min("negated").alias("none")).filter("none").limit(1)
    lone = negative.collect()
    if lone:
        raise ValueError(f"query {lone[0]['query_id']} excludes without requiring anything")


def _prepared(clauses: DataFrame) -> DataFrame:
    column = reduce(
        lambda out, item: F.when(F.lower("field") == item[0], item[1]).otherwise(out),
        FIELD_NAMES.items(),
        F.lit(None).cast("string"),
    )
    split = clauses.select(
        "query_id",
        "slot",
        "alt",
        "negated",
        tokens(F.col("value")).alias("toks"),
        (F.col("kind") == "prefix").alias("is_prefix"),
        column.alias("column"),
    )
    key = F.concat(
        F.array_join("toks", " "),
        F.when(F.col("is_prefix"), "*").otherwise(""),
        F.lit("|"),
        F.coalesce("column", F.lit("")),
    )
    return split.withColumn("leaf", F.when(F.size("toks") > 0, key))


def _numbered(prepared: DataFrame) -> DataFrame:
    """The clauses with a number in place of each leaf. The batch's own leaves are few beside the postings."""
    names = prepared.select("leaf").filter(F.col("leaf").isNotNull()).distinct()
    names = names.withColumn("_number", F.row_number().over(Window.orderBy("leaf")) - 1)
    return prepared.join(names, "leaf", "left").drop("leaf").withColumnRenamed("_number", "leaf")


def _leaf_terms(leaves: DataFrame, terms: DataFrame) -> DataFrame:
    """``leaf, m, column, off, term, n``: the index terms that may stand at each offset of a leaf."""
    spread = leaves.select(
        "leaf", "is_prefix", "column", F.size("toks").alias("m"), F.posexplode("toks").alias("off", "tok")
    )
    open_end = F.col("is_prefix") & (F.col("off") == F.col("m") - 1)
    columns = ("leaf", "m", "column", "off", "term", "n")

    def summed(found: DataFrame) -> DataFrame:
        """The vocabulary is a log of signed counts; only the words of the leaves are summed up."""
        return found.groupBy(*columns[:-1]).agg(F.sum("n").alias("n")).filter(F.col("n") > 0)

    exact = spread.filter(~open_end).withColumnRenamed("tok", "term").join(terms, "term").select(*columns)
    starts = spread.filter(open_end)
    # As many lengths as the clauses hold; each term is cut to those only.
    lengths = [r["n"] for r in starts.select(F.length("tok").alias("n")).distinct().collect()]
    if not lengths:
        return summed(exact)
    cuts = F.array(*[F.when(F.length("term") >= n, F.substring("term", 1, n)) for n in sorted(lengths)])
    heads = terms.select("term", "n", F.explode(cuts).alias("tok"))
    return summed(exact.unionByName(starts.join(heads, "tok").select(*columns)))


def _saved(frame: DataFrame) -> DataFrame:
    """Write an intermediate table that several steps read to the shared folder.

    Its size on disk then tells the planner whether it is small enough to be sent to every executor.
    """
    spark = frame.sparkSession
    path = f"{shared_dir(spark)}/batch-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.parquet(path)


def _prefix_hits(corpus: Corpus, prefixes: DataFrame) -> list[DataFrame]:
    """Posting rows of single-token prefixes, one frame for each prefix length.

    A prefix is compared with the head of each term, so it stays one row however many terms it covers.
    """
    prefixes = _saved(prefixes.select("leaf", "column", F.get("toks", F.lit(0)).alias("tok")))
    # As many lengths as the clauses hold.
    lengths = sorted(r["n"] for r in prefixes.select(F.length("tok").alias("n")).distinct().collect())
    found = []
    for n in lengths:
        wanted, by = prefixes.filter(F.length("tok") == n), ["tok"]
        post = corpus.postings.filter(F.length("term") >= n).withColumn("tok", F.substring("term", 1, n))
        if corpus.shards and n > 1:
            wanted, by = wanted.withColumn("shard", shard_column(F.col("tok"), corpus.shards)), ["shard", "tok"]
        found.append(post.join(wanted, by))
    return found


def leaf_hits(corpus: Corpus, leaves: DataFrame) -> DataFrame:
    """One row for each path that holds a leaf: ``path, ext`` and lists of equal length ``leaf, f, dl, segment, ord``, one entry
    for each leaf and copy of the path. Documents without a place have zeros."""
    single = F.col("is_prefix") & (F.size("toks") == 1)
    terms = _saved(_leaf_terms(leaves.filter(~single), corpus.terms))
    number = F.row_number().over(Window.orderBy("term")) - 1
    codes = terms.groupBy("term").agg(F.max(F.col("m") > 1).alias("whole")).withColumn("code", number)
    by = ["term"]
    if corpus.shards:
        codes, by = codes.withColumn("shard", shard_column(F.col("term"), corpus.shards)), ["shard", "term"]
    codes = _saved(codes)
    table = _collected(terms.join(codes.select("term", "code"), "term").select("leaf", "m", "off", "code", "n"))
    asked = _collected(leaves.select("leaf", "column", single.alias("single")).orderBy("leaf"))
    fields = pc.fill_null(pc.index_in(asked["column"], pa.array(packing.FIELD_ORDER)), -1).to_numpy().astype(np.int64)
    prefixes = asked["leaf"].to_numpy()[asked["single"].to_numpy()]
    known = codes.count()
    numbers = packing.leaves_of(len(fields), known, fields, prefixes, {c: table[c].to_numpy() for c in table.schema.names})

    total = corpus.stats.agg(F.sum("n_tokens").alias("n")).first()["n"] or 0
    buckets = max(1, -(-total // packing.BUCKET_TOKENS))
    place = place_of(corpus.postings)
    places = [(F.col(c) if c in place else F.lit(0)).cast(t).alias(c) for c, t in zip(PLACE, ("int", "bigint"))]
    named = F.array(*[F.lit(f) for f in packing.FIELD_ORDER])
    field = (F.array_position(named, F.col("field")) - 1).cast("byte").alias("field")

    def packed(rows: DataFrame, code: Column, *more: str) -> DataFrame:
        bucket, n = path_shard(F.col("path"), buckets).alias("bucket"), F.size("positions").alias("n")
        sent = rows.select(bucket, code.cast("int").alias("code"), "path", "ext", "dl", *places, field, n, *more)
        return sent.mapInArrow(packing.packed, packing.PACK_SCHEMA)

    exact = corpus.postings.join(codes.select("code", "whole", *by), by)
    runs = F.transform(
        F.sequence(F.lit(0), F.floor((F.size("positions") - 1) / packing.RUN).cast("int")),
        lambda i: F.slice("positions", i * packing.RUN + 1, F.lit(packing.RUN)),
    )
    runs = F.when(F.size("positions") <= packing.RUN, F.array("positions")).otherwise(runs)
    in_runs = exact.filter("whole").select("*", F.posexplode(runs).alias("run", "held")).drop("positions").withColumnRenamed("held", "positions")
    blocks = [packed(in_runs, F.col("code"), "run", "positions"), packed(exact.filter(~F.col("whole")), F.col("code"))]
    in_field = F.col("column").isNull() | (F.col("column") == F.col("field"))
    for rows in _prefix_hits(corpus, leaves.filter(single)):
        blocks.append(packed(rows.filter(in_field), F.col("leaf") + known))
    together = reduce(DataFrame.unionByName, blocks).groupBy("bucket")
    return together.applyInArrow(lambda group: packing.found(group, numbers), packing.FOUND_SCHEMA)


def _collected(frame: DataFrame) -> pa.Table:
    """A table about the batch's own leaves and clauses, as small as the batch, on the driver."""
    return frame.toArrow().combine_chunks()


def block_of(segment: Column, ord: Column) -> Column:
    """A document's block of neighbours in the index; documents without a place are one block."""
    return F.concat_ws(":", segment, F.shiftright(ord, BLOCK_LOG2))


@dataclass(frozen=True)
class _Judge:
    """The clauses of a batch as arrays, and what turns frequencies into parts of a score."""

    queries: pa.Array
    required: np.ndarray
    #: In order of the leaf: leaf, query, slot and alt of the driving clauses.
    driving: dict[str, np.ndarray]
    #: In order of the query: the same of all others, whether a clause must match (``adds``) and whether it must not.
    others: dict[str, np.ndarray]
    idf: np.ndarray
    length: float

    def slices(self, batches):
        """Runs of paths that come to about ``JUDGED_ROWS`` rows of clauses, one path at least."""
        each = 1 + np.bincount(self.others["query"], minlength=len(self.required))
        cost = np.bincount(self.driving["leaf"], each[self.driving["query"]], len(self.idf))
        for batch in batches:
            leaf = batch.column("leaf")
            ends = packing._ends(leaf.value_lengths().to_numpy(zero_copy_only=False))
            sums = packing._ends(1 + cost[leaf.flatten().to_numpy(zero_copy_only=False)])[ends]
            runs = (sums[1:] // JUDGED_ROWS).astype(np.int64)
            edges = [0, *(np.flatnonzero(np.diff(runs)) + 1).tolist(), batch.num_rows]
            for low, high in zip(edges[:-1], edges[1:]):
                if high > low:
                    yield batch.slice(low, high - low)

    def hits(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, leaf and part of all hits."""
        leaf, f, dl = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("leaf", "f", "dl"))
        row = np.repeat(np.arange(batch.num_rows), batch.column("leaf").value_lengths().to_numpy(zero_copy_only=False))
        part = self.idf[leaf] * (f * (K1 + 1.0)) / (f + K1 * (1.0 - B + B * (dl / self.length)))
        return row, leaf.astype(np.int64), part

    def driven(self, row: np.ndarray, leaf: np.ndarray):
        """Candidates, as row and query in one number, with the hit and the driving clause of each."""
        hit, clause = packing._matches(self.driving["leaf"], leaf)
        return row[hit] * len(self.required) + self.driving["query"][clause], hit, clause

    def partials(self, batches, log2: int):
        """``query_id, required, path, segment, ord, partial``: the part of the driving slot for each candidate and block that it
        is in, with the first place of the block."""
        for batch in self.slices(batches):
            row, leaf, part = self.hits(batch)
            candidate, hit, _ = self.driven(row, leaf)
            segment, place = (batch.column(c).flatten().to_numpy(zero_copy_only=False)[hit] for c in PLACE)
            keys = [candidate, segment, place >> log2]
            order = np.lexsort(keys[::-1])
            keys = [k[order] for k in keys]
            new = packing._starts(keys)
            pair, segment, place = (k[new] for k in keys)
            partial = np.bincount(np.cumsum(new) - 1, part[hit][order], len(pair))
            row, query = pair // len(self.required), pair % len(self.required)
            columns = [self.queries.take(pa.array(query)), pa.array(self.required[query]), batch.column("path").take(pa.array(row))]
            columns += [pa.array(segment), pa.array(place << log2), pa.array(partial, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["query_id", "required", "path", *PLACE, "partial"])

    def matches(self, batches):
        """``query_id, path, ext, score`` of the candidates that match, of those in the list ``only`` where rows have one."""
        for batch in self.slices(batches):
            row, leaf, part = self.hits(batch)
            candidate, hit, clause = self.driven(row, leaf)
            if "only" in batch.schema.names:
                only = batch.column("only")
                allowed = pc.index_in(only.flatten(), self.queries).to_numpy(zero_copy_only=False)
                allowed = np.repeat(np.arange(batch.num_rows), only.value_lengths().to_numpy(zero_copy_only=False)) * len(self.required) + allowed
                kept = np.isin(candidate, allowed)
                candidate, hit, clause = candidate[kept], hit[kept], clause[kept]
            pair, number = np.unique(candidate, return_inverse=True)
            # the other clauses of each candidate's query, then the hits of their leaves in its row
            at, other = packing._matches(self.others["query"], pair % len(self.required))
            key = row * len(self.idf) + leaf
            order = np.argsort(key, kind="stable")
            asked, found = packing._matches(key[order], pair[at] // len(self.required) * len(self.idf) + self.others["leaf"][other])
            other, more = other[asked], at[asked]
            excluded = np.bincount(more, self.others["excludes"][other], len(pair)) > 0
            adds = self.others["adds"][other]
            number = np.append(number, more[adds])
            slot = np.append(self.driving["slot"][clause], self.others["slot"][other[adds]])
            alt = np.append(self.driving["alt"][clause], self.others["alt"][other[adds]])
            part = np.append(part[hit], part[order[found[adds]]])
            # added up in this order, whatever the order of the hits
            by = np.lexsort((part, alt, slot, number))
            number, slot, part = number[by], slot[by], part[by]
            met = np.bincount(number, packing._starts([number, slot]), len(pair))
            total = np.bincount(number, part, len(pair))
            row, query = pair // len(self.required), pair % len(self.required)
            good = ~excluded & (met == self.required[query])
            columns = [self.queries.take(pa.array(query[good]))]
            columns += [batch.column(c).take(pa.array(row[good])) for c in ("path", "ext")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(0.0 - total[good], pa.float64())], ["query_id", "path", "ext", "score"])


@dataclass(frozen=True)
class _Plan:
    """Intermediate tables of a batch, all written to the shared folder."""

    #: query_id, slot, alt, negated, leaf, required, driving
    clauses: DataFrame
    #: leaf, block, top: the most a leaf adds to the score of a document in the block
    tops: DataFrame
    #: path, ext, and lists leaf, f, dl, segment, ord: the paths that the filters leave
    rows: DataFrame
    judge: _Judge


def _judge(corpus: Corpus, clauses: DataFrame, counts: DataFrame, n_leaves: int) -> _Judge:
    whole = corpus.stats.agg(F.sum("n_docs").alias("docs"), F.sum("n_tokens").alias("tokens"))
    rated = counts.crossJoin(whole).select("leaf", idf(F.col("n_with"), F.col("docs")).alias("idf"))
    rated, length = _collected(rated), whole.select((F.col("tokens") / F.col("docs")).alias("n")).first()["n"]
    idfs = np.zeros(max(n_leaves, 1))
    idfs[rated["leaf"].to_numpy()] = rated["idf"].to_numpy()
    flags = {"adds": ~F.col("negated"), "excludes": F.col("negated")}
    numbers = [F.coalesce(F.col(c).cast("bigint"), F.lit(-(2**63))).alias(c) for c in ("leaf", "slot", "alt", "required")]
    held = clauses.select("query_id", *numbers, "driving", *[F.coalesce(c, F.lit(False)).alias(n) for n, c in flags.items()])
    held = _collected(held.filter(F.col("driving").isNotNull()))
    queries = packing._array(held, "query_id").dictionary_encode()
    columns = {c: held[c].to_numpy() for c in held.schema.names if c != "query_id"}
    columns["query"] = queries.indices.to_numpy().astype(np.int64)
    required = np.zeros(len(queries.dictionary), np.int64)
    required[columns["query"]] = columns["required"]

    def part(chosen: np.ndarray, by: str) -> dict[str, np.ndarray]:
        at = np.flatnonzero(chosen)
        at = at[np.argsort(columns[by][at], kind="stable")]
        return {c: columns[c][at] for c in ("leaf", "query", "slot", "alt", "adds", "excludes")}

    driving = columns["driving"]
    return _Judge(queries.dictionary, required, part(driving, "leaf"), part(~driving, "query"), idfs, length or 1.0)


def _planned(corpus: Corpus, clauses: DataFrame, ext: str | None, under: str | None) -> _Plan:
    _check(clauses)
    prepared = _saved(_numbered(_saved(_prepared(clauses))))
    leaves = _saved(prepared.filter(F.col("leaf").isNotNull()).select("leaf", "toks", "is_prefix", "column").distinct())
    # rows on their way to be packed are of bounded size, so that their number bounds a batch
    with settings(clauses.sparkSession, {"spark.sql.execution.arrow.maxBytesPerBatch": 2**31 - 1}):
        found = _saved(leaf_hits(corpus, leaves))
    counts = _saved(found.select(F.explode("leaf").alias("leaf")).groupBy("leaf").agg(F.count("*").alias("n_with")))
    counted = prepared.join(counts, "leaf", "left").select(
        "query_id", "slot", "alt", "negated", "leaf", F.coalesce("n_with", F.lit(0)).alias("n_with")
    )
    slots = (
        counted.filter(~F.col("negated"))
        .groupBy("query_id", "slot")
        .agg(F.sum("n_with").alias("n"))
        .groupBy("query_id")
        .agg(F.min_by("slot", F.struct("n", "slot")).alias("drive"), F.count("*").alias("required"))
    )
    driving = ~F.col("negated") & (F.col("slot") == F.col("drive"))
    known = _saved(
        counted.join(slots, "query_id")
        .filter("leaf is not null")
        .select("query_id", "slot", "alt", "negated", "leaf", "required", driving.alias("driving"))
    )
    totals = corpus.stats.agg(
        F.struct(F.sum("n_docs").alias("docs"), F.sum("n_tokens").alias("tokens")).alias("c")
    ).scalar()
    part = term_score(F.col("f"), F.col("dl"), F.col("n_with"), F.col("_total.docs"), F.col("_total.tokens"))
    hits = found.select(F.inline(F.arrays_zip("leaf", "f", "dl", *PLACE))).join(counts, "leaf")
    block = block_of(F.col("segment"), F.col("ord")).alias("block")
    tops = hits.withColumn("_total", totals).groupBy("leaf", block).agg(F.max(part).alias("top"))
    rows = found
    # filters stand beside the match: they change no statistics
    if ext is not None:
        rows = rows.filter(has_extension(F.col("ext"), ext))
    if under is not None:
        rows = rows.filter(in_subtree(F.col("path"), under))
    return _Plan(known, tops, rows, _judge(corpus, known, counts, leaves.count()))


def _judged(plan: _Plan, chosen: DataFrame | None = None) -> DataFrame:
    """``query_id, path, ext, score`` of the candidates that match: all of them, or the ``chosen`` (query_id, path)."""
    rows, judge = plan.rows.select("path", "ext", "leaf", "f", "dl"), plan.judge
    if chosen is not None:
        rows = rows.join(chosen.groupBy("path").agg(F.collect_set("query_id").alias("only")), "path")
    made = StructType([plan.clauses.schema["query_id"], *rows.schema.fields[:2]]).add("score", "double")
    return rows.mapInArrow(judge.matches, made)


def score_many(
    corpus: Corpus, clauses: DataFrame, *, ext: str | None = None, under: str | None = None
) -> DataFrame:
    """Every match of every query: ``query_id, path, ext, score``."""
    return _judged(_planned(corpus, clauses, ext, under))


def _bounded(plan: _Plan) -> DataFrame:
    """``query_id, path, upper``: what a candidate's score can come to, where every slot can be met in its block."""
    others = plan.clauses.filter(~F.col("driving") & ~F.col("negated")).select("query_id", "slot", "leaf")
    rest = others.join(plan.tops, "leaf").groupBy("query_id", "block").agg(
        F.sum("top").alias("rest"), F.count_distinct("slot").alias("met")
    )
    rows, judge, log2 = plan.rows.select("path", "leaf", "f", "dl", *PLACE), plan.judge, BLOCK_LOG2
    made = StructType([plan.clauses.schema["query_id"]]).add("required", "long").add(rows.schema["path"])
    made = made.add("segment", "integer").add("ord", "long").add("partial", "double")
    partial = rows.mapInArrow(lambda batches: judge.partials(batches, log2), made)
    partial = partial.withColumn("block", block_of(F.col("segment"), F.col("ord")))
    able = F.coalesce("met", F.lit(0)) >= F.col("required") - 1
    upper = F.col("partial") + F.coalesce("rest", F.lit(0.0))
    return partial.join(_saved(rest), ["query_id", "block"], "left").filter(able).select("query_id", "path", upper.alias("upper"))


def search_many(
    corpus: Corpus, clauses: DataFrame, limit: int, *, ext: str | None = None, under: str | None = None
) -> DataFrame:
    """The best ``limit`` matches per query, ranked."""
    plan = _planned(corpus, clauses, ext, under)
    bounded = _saved(_bounded(plan))
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("upper"), "path"))
    best = bounded.withColumn("nth", order).filter(F.col("nth") <= FIRST * check_limit(limit))
    best = _saved(best.select("query_id", "path"))
    first = _saved(_judged(plan, best))
    reached = top_k_per_query(first, limit).filter(F.col("rank") == limit).select("query_id", (-F.col("score")).alias("reached"))
    # sums in another order differ in the last digits
    able = F.col("reached").isNull() | (F.col("upper") * (1 + 1e-9) >= F.col("reached"))
    left = bounded.join(best, ["query_id", "path"], "left_anti").join(_saved(reached), "query_id", "left").filter(able)
    return top_k_per_query(first.unionByName(_judged(plan, left.select("query_id", "path"))), limit)
