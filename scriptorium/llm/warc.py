"""WARC archives: writing records in segments, and reading them back whole.

A capture is a ``response`` record whose block is an HTTP response with a chunked body, or, if another capture has the
same payload, a ``revisit`` that refers to that one and repeats its headers alone. Blocks above ``segment_bytes`` are
split: the first piece stays with the record, the others are ``continuation`` records with the origin's id and a
segment number, the last of which states the total length.

Writing: records are rows of a text table whose line end is the two empty lines that close a WARC record, so Spark's
own writer with its commit protocol makes the files (``.gz``), and a lost executor leaves no half file behind. A file
holds at most ``FILE_RECORDS`` records and about ``FILE_BYTES`` bytes before compression. Texts are cut into chunks and
segments in one pass each, so a record costs time in proportion to its length.

Reading: every file is unpacked as a stream and cut by ``Content-Length``, one record at a time. Records without
segments are complete; segments are grouped by origin, ordered by number and joined, and a record is complete if its
segments are numbered without a gap and their length is the stated total. Only then the chunked framing is decoded.
A group is one record, so its size is that of a capture.

Defined cases: a null payload is empty; equal payloads below ``min_revisit`` bytes are all responses; repeated rows and
null ids are kept as records of their own (of equal payloads one of those with the largest id is the response, a null
id being smaller than any other);
an incomplete or damaged record is returned with ``complete`` false and no payload; an empty table gives no records.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from scriptorium.llm.base import folder

SEGMENT_BYTES = 16 << 10
CHUNK_CHARS = 4096
MIN_REVISIT = 1000
FILE_RECORDS = 20_000
FILE_BYTES = 512 << 20
DATE = "2024-01-01T00:00:00Z"
_ID = "<urn:capture:{}>"
_PIECE = 1 << 20

_RECORD = "id string, type string, refers_to string, origin string, segment int, total long, digest string, block binary"


def _identity(key: Column) -> Column:
    return F.concat(F.lit("<urn:capture:"), key, F.lit(">"))


def captures(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, html plus ``key`` (unique), ``digest``, ``refers_to`` (key of the response, null if it is one).

    The key of a page whose id no other has is the id; other rows get a key made of their values, so it is the same when a
    task runs again. Equal rows meet as one row with a count, counted before the shuffle, and are numbered when they are
    taken apart: no group gathers the rows of one id, or those without.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    own = F.coalesce(F.col("page_id").cast("string"), F.lit("none"))
    # spelt in letters, so that an id is the only number in a key
    values = F.sha1(F.concat("digest", F.coalesce(F.concat(F.lit("+"), "url"), F.lit("-"))).cast("binary"))
    rows = (
        pages.select("page_id", "url", html.alias("html"))
        .withColumn("digest", F.sha1(F.col("html").cast("binary")))
        .withColumn("_row", F.concat_ws("~", own, F.translate(values, "0123456789", "ghijklmnop")))
    )
    # narrow: keys, and the newest capture of each payload that occurs more than once
    repeated = pages.filter("page_id is not null").groupBy(F.col("page_id").alias("p")).count().filter("count > 1").select("p")
    narrow = rows.select("page_id", "_row", "digest", (F.octet_length("html") >= min_revisit).alias("_large"))
    narrow = narrow.join(repeated, F.col("page_id") == F.col("p"), "left").select(
        "page_id", "_row", "digest", "_large", (F.col("page_id").isNotNull() & F.col("p").isNull()).alias("_plain")
    )
    newest = (
        narrow.filter("_large")
        .groupBy("digest")
        .agg(F.max(F.struct("page_id", "_row", "_plain")).alias("first"), F.count("*").alias("n"))
        .filter("n > 1")
        .select(F.col("digest").alias("d"), "first")
    )
    known = (
        narrow.join(newest, F.col("_large") & (F.col("digest") == F.col("d")), "left")
        .groupBy(F.col("_row").alias("r"))
        .agg(F.any_value("_plain").alias("_plain"), F.any_value("first").alias("first"))
    )
    # joined on the key by which the rows are placed already
    distinct = rows.groupBy("_row").agg(
        F.count("*").alias("_n"), *[F.any_value(c).alias(c) for c in ("page_id", "url", "html", "digest")]
    )
    copies = distinct.join(known, F.col("_row") == F.col("r")).select(
        "page_id", "url", "html", "_row", "digest", "_plain", "first", F.explode(F.sequence(F.lit(1).cast("long"), "_n")).alias("_copy")
    )

    def key(row: Column, plain: Column, copy: Column) -> Column:
        return F.when(plain, F.substring_index(row, "~", 1)).otherwise(F.concat(row, F.lit("~"), copy.cast("string")))

    response = (F.col("_row") == F.col("first._row")) & (F.col("_copy") == 1)
    return copies.select(
        "page_id",
        "url",
        "html",
        key(F.col("_row"), F.col("_plain"), F.col("_copy")).alias("key"),
        "digest",
        F.when(F.col("first").isNotNull() & ~response, key(F.col("first._row"), F.col("first._plain"), F.lit(1))).alias("refers_to"),
    )


def _cut(text: Column, chars: int) -> Column:
    """Pieces of ``chars`` characters, the last one shorter, in one pass; none of an empty text."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{chars}}}"), F.lit(0))


def _chunked(html: Column) -> Column:
    """The text in chunks of at most ``CHUNK_CHARS`` characters, framed for chunked transfer."""

    def framed(part: Column) -> Column:
        return F.concat(F.lower(F.hex(F.octet_length(part))), F.lit("\r\n"), part, F.lit("\r\n"))

    return F.concat(F.array_join(F.transform(_cut(html, CHUNK_CHARS), framed), ""), F.lit("0\r\n\r\n"))


def write(pages: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES, min_revisit: int = MIN_REVISIT) -> None:
    """Write every row of (page_id, url, html) as a record into gzip files below ``path``."""
    rows = captures(pages, min_revisit)
    head = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Payload-Length: "),
        F.octet_length("html").cast("string"),
        F.lit("\r\nTransfer-Encoding: chunked\r\n\r\n"),
    )
    block = F.when(F.col("refers_to").isNull(), F.concat(head, _chunked(F.col("html")))).otherwise(head)
    rows = rows.withColumn("block", block).withColumn("size", F.octet_length("block"))
    # cut between characters: a segment takes as many characters as fit if all took four bytes
    step = max(1, segment_bytes // 4)
    split = F.col("size") > segment_bytes
    pieces = F.when(split, _cut(F.col("block"), step)).otherwise(F.array("block"))
    # the page and its block stay behind: only a record's fields are copied to its pieces
    rows = rows.select("key", "url", "digest", "refers_to", "size", split.alias("_split"), pieces.alias("_pieces"))
    parts = rows.select(
        "key", "url", "digest", "refers_to", "size", "_split", F.size("_pieces").alias("_of"), F.posexplode("_pieces").alias("_at", "_part")
    )
    part = F.col("_part")
    first, last = F.col("_at") == 0, F.col("_at") + 1 == F.col("_of")
    own = F.when(first, F.col("key")).otherwise(F.concat("key", F.lit("/"), (F.col("_at") + 1).cast("string")))
    kind = F.when(~first, "continuation").when(F.col("refers_to").isNull(), "response").otherwise("revisit")
    url = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]+", " ")
    line = lambda name, value, when=None: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")) if when is None else F.when(
        when, F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    ).otherwise("")
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", kind),
        line("WARC-Record-ID", _identity(own)),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")), first),
        line("WARC-Refers-To", _identity(F.col("refers_to")), first & F.col("refers_to").isNotNull()),
        line("WARC-Segment-Number", (F.col("_at") + 1).cast("string"), F.col("_split")),
        line("WARC-Segment-Origin-ID", _identity(F.col("key")), ~first),
        line("WARC-Segment-Total-Length", F.col("size").cast("string"), F.col("_split") & last),
        line("Content-Length", F.octet_length(part).cast("string")),
        F.lit("\r\n"),
    )
    parts.select(F.concat(header, part).alias("value")).write.options(
        lineSep="\r\n\r\n", compression="gzip", maxRecordsPerFile=max(1, min(FILE_RECORDS, FILE_BYTES // segment_bytes))
    ).text(path)


_FIELD = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)\r?\n")


def records(unpacked: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of each record in a stream of bytes; a torn end is left out."""
    buffer = bytearray()
    more = True

    def fill(n: int) -> bool:
        nonlocal more
        while len(buffer) < n and more:
            piece = next(unpacked, None)
            more = piece is not None
            buffer.extend(piece or b"")
        return len(buffer) >= n

    while True:
        while fill(2) and buffer[:2] == b"\r\n":
            del buffer[:2]
        end = -1
        seen = 0
        while end < 0:
            end = buffer.find(b"\r\n\r\n", max(0, seen - 3))
            seen = len(buffer)
            if end < 0 and not fill(seen + 1):
                return
        fields = {k.decode().strip().lower(): v.decode("utf-8", "replace").strip() for k, v in _FIELD.findall(bytes(buffer[: end + 2]))}
        size = fields.get("content-length", "")
        if not buffer.startswith(b"WARC/") or not size.isdigit() or not fill(end + 4 + int(size)):
            return
        yield fields, bytes(buffer[end + 4 : end + 4 + int(size)])
        del buffer[: end + 4 + int(size)]


def unpack(content: bytes) -> Iterator[bytes]:
    """Pieces of a file that is plain or gzip of one or many members."""
    if content[:2] != b"\x1f\x8b":
        for at in range(0, len(content), _PIECE):
            yield content[at : at + _PIECE]
        return
    rest = content
    while rest[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        data = rest
        while data and not member.eof:
            yield member.decompress(data, _PIECE)
            data = member.unconsumed_tail
        rest = member.unused_data


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.binary()]
        names = ["id", "type", "refers_to", "origin", "segment", "total", "digest", "block"]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names
        )

    number = lambda text: int(text) if text and text.isdigit() else None
    for files in batches:
        for content in files.column(0):
            rows, size = [], 0
            for f, block in records(unpack(content.as_buffer().to_pybytes())):
                rows.append(
                    (
                        f.get("warc-record-id"),
                        f.get("warc-type"),
                        f.get("warc-refers-to"),
                        f.get("warc-segment-origin-id"),
                        number(f.get("warc-segment-number")),
                        number(f.get("warc-segment-total-length")),
                        f.get("warc-payload-digest"),
                        block,
                    )
                )
                size += len(block)
                if size >= 4 * _PIECE:
                    yield batch(rows)
                    rows, size = [], 0
            if rows:
                yield batch(rows)


def dechunk(body: bytes) -> bytes | None:
    """The payload of a chunked body, or null if the framing is broken."""
    parts, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            return None
        try:
            size = int(body[at:end].split(b";", 1)[0].strip(), 16)
        except ValueError:
            return None
        if size == 0:
            return b"".join(parts)
        if body[end + 2 + size : end + 4 + size] != b"\r\n":
            return None
        parts.append(body[end + 2 : end + 2 + size])
        at = end + 4 + size


@F.arrow_udf(StructType([StructField("payload", BinaryType()), StructField("stated", LongType())]))
def _payload(blocks: pa.Array) -> pa.Array:
    """Payload and stated length of records, each given as the list of its segments' blocks in order."""
    payloads, stated = [], []
    for block in blocks:
        segments = block.as_py()
        block = None if segments is None else b"".join(segments)
        head, gap, body = (block or b"").partition(b"\r\n\r\n")
        fields = {k.strip().lower(): v.strip() for k, v in _FIELD.findall(head + b"\r\n")}
        size = fields.get(b"x-payload-length", fields.get(b"content-length", b""))
        stated.append(int(size) if size.isdigit() else None)
        if block is None or not gap:
            payloads.append(None)
        elif fields.get(b"transfer-encoding", b"").lower() == b"chunked":
            payloads.append(dechunk(body))
        else:
            payloads.append(body)
    return pa.StructArray.from_arrays([pa.array(payloads, pa.binary()), pa.array(stated, pa.int64())], names=["payload", "stated"])


def read(spark: SparkSession, path: str) -> DataFrame:
    """All records below ``path``: id, type, refers_to, digest, payload, payload_bytes, complete.

    A revisit has no payload of its own; its ``payload_bytes`` is the length that its headers state.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    found = files.mapInArrow(_parse, _RECORD)
    whole = found.filter("segment is null and origin is null").select(
        "id", "type", "refers_to", "digest", F.array("block").alias("blocks"), F.lit(True).alias("joined")
    )
    segments = (
        found.filter("segment is not null or origin is not null")
        .groupBy(F.coalesce("origin", "id").alias("id"))
        .agg(
            F.max(F.when(F.col("segment") == 1, F.struct("type", "refers_to", "digest"))).alias("first"),
            F.max("total").alias("total"),
            F.sort_array(F.collect_list(F.struct("segment", F.octet_length("block").alias("n"), "block"))).alias("parts"),
        )
    )
    numbers = F.transform("parts", lambda p: p["segment"])
    size = F.aggregate(F.col("parts.n"), F.lit(0).cast("long"), lambda total, n: total + n)
    fits = (numbers == F.sequence(F.lit(1), F.size("parts"))) & (size == F.col("total"))
    together = segments.select(
        "id",
        "first.type",
        "first.refers_to",
        "first.digest",
        F.when(fits, F.col("parts.block")).alias("blocks"),
        F.coalesce(fits, F.lit(False)).alias("joined"),
    )
    named = whole.unionByName(together).withColumn("_p", _payload("blocks"))
    revisit = F.col("type") == "revisit"
    payload = F.when(~revisit, F.col("_p.payload"))
    bare = F.regexp_replace("digest", "^sha1:", "")
    right = F.when(revisit, F.col("_p.stated").isNotNull()).otherwise(F.sha1(payload) == bare)
    return named.select(
        "id",
        "type",
        "refers_to",
        bare.alias("digest"),
        payload.alias("payload"),
        F.when(revisit, F.col("_p.stated")).otherwise(F.octet_length(payload).cast("long")).alias("payload_bytes"),
        (F.col("joined") & F.coalesce(right, F.lit(False))).alias("complete"),
    )


def page_of(identity: Column) -> Column:
    """The page id in a record id."""
    return F.regexp_extract(identity, r"^<urn:capture:(-?[0-9]+)(?:~[a-p]+~[0-9]+)?>$", 1).try_cast("long")


def report(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write all pages as archives and read them back: one row per record."""
    path = folder(spark, "warc")
    write(pages, path)
    return read(spark, path).select(
        page_of(F.col("id")).alias("page_id"),
        "payload_bytes",
        F.col("digest").alias("payload_digest"),
        F.col("type").alias("record_type"),
        page_of(F.col("refers_to")).alias("refers_to"),
    )


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
r AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS payload_digest FROM p),
f AS (SELECT payload_digest AS d, max(page_id) AS first FROM r WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM r LEFT JOIN f ON d = payload_digest AND payload_bytes >= 1000
"""
