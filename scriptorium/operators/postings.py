"""Postings, document lengths and corpus statistics."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, ByteType, IntegerType, StringType, StructField, StructType

from scriptorium.functions.text import FIELDS, separated


#: A document's change and its number in it; see :mod:`scriptorium.plans.segments`.
PLACE = ("segment", "ord")
#: What all rows of a block share.
_OF_BLOCK = ("term", "ext")
#: Bytes of text whose tokens are grouped at a time.
SLICE_BYTES = 4 * 1024**2
#: Bytes of tokens in separated texts, folded; zero for all others.
_TOKEN_BYTES = np.zeros(256, np.uint8)
for _low, _high, _shift in ((0x30, 0x39, 0), (0x41, 0x5A, 32), (0x61, 0x7A, 0), (0x80, 0xFF, 0)):
    _TOKEN_BYTES[_low : _high + 1] = np.arange(_low, _high + 1) + _shift


def postings(documents: DataFrame) -> DataFrame:
    """One row per (term, document, field) with the sorted token positions.

    ``lead`` marks the first row of each (term, document), so documents can be counted without grouping.

    Grouping happens inside each document row, so nothing is shuffled here and the rows that a writer
    later shuffles are already combined. ``dl`` rides along so that scoring never joins for it, and so does a document's
    place in the index (``segment, ord``), where it has one. Tokens are cut and grouped many documents at a time, as arrays.
    """
    texts, made = _texts(documents)
    return texts.mapInArrow(_grouped, made)


def posting_blocks(documents: DataFrame) -> DataFrame:
    """The rows of :func:`postings`, those of a term in a slice of neighbouring documents (of one extension) as one row:
    ``term, ext, rows``.

    A writer shuffles and sorts these, far fewer than rows, and unpacks them in place. A slice bounds a block.
    """
    texts, made = _texts(documents)
    rows = [f if f.name != "field" else StructField("field", ByteType()) for f in made.fields if f.name not in _OF_BLOCK]
    return texts.mapInArrow(
        _blocks_by_term, StructType([*[made[name] for name in _OF_BLOCK], StructField("rows", ArrayType(StructType(rows), False))])
    )


def unpacked(blocks: DataFrame) -> DataFrame:
    """Posting rows of blocks, in the order of the blocks and of the rows in them."""
    rows = blocks.select(*[c for c in blocks.columns if c != "rows"], F.inline("rows"))
    return rows.withColumn("field", F.get(F.array(*[F.lit(f) for f in sorted(FIELDS)]), F.col("field").cast("int")))


def _texts(documents: DataFrame) -> tuple[DataFrame, StructType]:
    """What tokenising reads of documents, and the columns of posting rows."""
    keys = ["path", "ext", "dl", *[c for c in PLACE if c in documents.columns]]
    whole = documents.dropna(subset=list(FIELDS))
    texts = whole.select(*keys, *[separated(F.col(f)).alias(f"_{f}") for f in FIELDS])
    made = StructType(
        [StructField("term", StringType()), *texts.schema.fields[:2], StructField("field", StringType())]
        + [texts.schema["dl"], StructField("lead", BooleanType()), StructField("positions", ArrayType(IntegerType(), False))]
        + texts.schema.fields[3 : len(keys)]
    )
    return texts, made


def _bytes_of(texts) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in one array, and where each text begins and ends in it."""
    raw = texts.cast(pa.large_binary())
    _, offsets, data = raw.buffers()
    ends = np.frombuffer(offsets, np.int64)[raw.offset : raw.offset + len(raw) + 1]
    held = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.empty(0, np.uint8)
    return held, ends - ends[0]


def _cut(texts) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All tokens of some separated texts, the number of each token's text and its position in it."""
    data, ends = _bytes_of(texts)
    folded = _TOKEN_BYTES[data]
    inside = folded != 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    # a text never continues the last token of the text before
    heads = ends[:-1][ends[:-1] < ends[1:]]
    first[heads] = inside[heads]
    starts = np.flatnonzero(first)
    kept = folded[inside]
    offsets = np.append(np.cumsum(inside)[starts] - 1, len(kept)).astype(np.int32)
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(kept))
    bounds = np.searchsorted(starts, ends)
    counts = np.diff(bounds)
    return words, np.repeat(np.arange(len(texts)), counts), np.arange(len(starts)) - np.repeat(bounds[:-1], counts)


def _slices(batch: pa.RecordBatch, texts: list[str]):
    """Runs of neighbouring rows with about ``SLICE_BYTES`` of text each, one row at least."""
    sizes = sum(np.diff(_bytes_of(batch.column(name))[1]) for name in texts)
    numbers = np.cumsum(sizes) // SLICE_BYTES
    edges = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), batch.num_rows]
    for low, high in zip(edges[:-1], edges[1:]):
        if high > low:
            yield batch.slice(low, high - low)


def _grouped(batches):
    """Posting rows of documents whose separated texts are the columns ``_<field>``, slice by slice."""
    # Document by document, so that a shuffle packs their paths well.
    for rows, _ in _numbered(batches, False):
        yield rows


def _numbered(batches, by_term: bool):
    """The same with the number of each row's term: in order of document, term and field, or of term, document and field."""
    # ``lead`` goes to the first field by name
    fields = sorted(FIELDS)
    for batch in batches:
        for part in _slices(batch, [f"_{f}" for f in fields]):
            cut = [_cut(part.column(f"_{f}")) for f in fields]
            codes = pa.concat_arrays([words for words, _, _ in cut]).dictionary_encode()
            field = np.repeat(np.arange(len(fields)), [len(words) for words, _, _ in cut])
            sorted_terms = pc.array_sort_indices(codes.dictionary)
            rank = np.empty(len(sorted_terms), np.int64)
            rank[sorted_terms.to_numpy()] = np.arange(len(sorted_terms))
            doc, term = np.concatenate([doc for _, doc, _ in cut]), rank[codes.indices.to_numpy()]
            pair = term * part.num_rows + doc if by_term else doc * max(len(rank), 1) + term
            # stable: fields stay in order within a pair of document and term, and positions within a field
            order = np.argsort(pair, kind="stable")
            pair, field = pair[order], field[order]
            lead = np.append(True, pair[1:] != pair[:-1])[: len(pair)]
            starts = np.flatnonzero(lead | np.append(True, field[1:] != field[:-1])[: len(pair)])
            offsets = np.append(starts, len(pair)).astype(np.int32)
            positions = np.concatenate([pos for _, _, pos in cut])[order].astype(np.int32)
            doc, term = doc[order][starts], term[order][starts]
            column = {name: part.column(name).take(pa.array(doc)) for name in part.schema.names if not name.startswith("_")}
            column["term"] = codes.dictionary.take(sorted_terms).take(pa.array(term))
            column["field"] = pa.array(fields).take(pa.array(field[starts]))
            column["lead"] = pa.array(lead[starts])
            column["positions"] = pa.ListArray.from_arrays(pa.array(offsets), pa.array(positions))
            names = ["term", "path", "ext", "field", "dl", "lead", "positions", *[c for c in PLACE if c in column]]
            yield pa.RecordBatch.from_arrays([column[n] for n in names], names), term


def _blocks_by_term(batches):
    number = pa.array(sorted(FIELDS))
    for rows, term in _numbered(_same_extension(batches), True):
        starts = np.flatnonzero(np.append(True, term[1:] != term[:-1])[: len(term)])
        ends = pa.array(np.append(starts, len(term)).astype(np.int32))
        first = pa.array(starts)
        inner = {name: rows.column(name) for name in rows.schema.names if name not in _OF_BLOCK}
        inner["field"] = pc.index_in(inner["field"], number).cast(pa.int8())
        packed = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(list(inner.values()), list(inner)))
        yield pa.RecordBatch.from_arrays([*[rows.column(name).take(first) for name in _OF_BLOCK], packed], [*_OF_BLOCK, "rows"])


def _same_extension(batches):
    """Runs of neighbouring rows with the same extension."""
    for batch in batches:
        codes = batch.column("ext").dictionary_encode().indices.to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist(), batch.num_rows]
        for low, high in zip(edges[:-1], edges[1:]):
            if high > low:
                yield batch.slice(low, high - low)


def token_rows(post: DataFrame) -> DataFrame:
    """One row per token occurrence."""
    return post.select("path", "field", F.explode("positions").alias("pos"), "term")


def document_lengths(documents: DataFrame) -> DataFrame:
    """Tokens over all four fields, counted when the document row is built."""
    return documents.select("path", "dl")


def term_counts(post: DataFrame) -> DataFrame:
    """The vocabulary: posting rows, documents, and documents per field of each term."""
    by_field = [F.count_if(F.col("field") == f).alias(f"n_{f}") for f in FIELDS]
    return post.groupBy("term").agg(
        F.count("*").alias("n"), F.count_if("lead").alias("n_docs"), *by_field
    )


def corpus_stats(documents: DataFrame) -> DataFrame:
    """One row: number of documents and of tokens."""
    return documents.agg(
        F.count("*").alias("n_docs"), F.coalesce(F.sum("dl"), F.lit(0)).alias("n_tokens")
    )


def shard_column(term: Column, shards: int) -> Column:
    """Directory of a term: a hash of its first two characters, so words and prefixes both prune."""
    return F.pmod(F.crc32(F.encode(F.substring(term, 1, 2), "UTF-8")), F.lit(shards)).cast("int")


def shard_of(term: str, shards: int) -> int:
    """Driver-side twin of :func:`shard_column`."""
    return zlib.crc32(term[:2].encode("utf-8")) % shards


def path_shard(path: Column, shards: int) -> Column:
    return F.pmod(F.crc32(F.encode(path, "UTF-8")), F.lit(shards)).cast("int")


def path_shard_of(path: str, shards: int) -> int:
    """Driver-side twin of :func:`path_shard`."""
    return zlib.crc32(path.encode("utf-8", "surrogatepass")) % shards


def update_postings(stored: DataFrame, touched: DataFrame, changed: DataFrame) -> DataFrame:
    """Drop the postings of every touched path and add those of the changed documents."""
    kept = stored.join(touched.select("path"), "path", "left_anti")
    # dealt like what is kept, so that a grouping by term and path that follows finds its rows in place
    return kept.select(*stored.columns).unionByName(postings(changed).select(*stored.columns).repartition("path"))
