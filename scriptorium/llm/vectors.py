"""Vector codes by product quantisation, each part's codebook found by Ball k-means.

Vectors become integers (``floor(1024 x)``) and are cut into four equal parts; each part position has its own 256 entries.
An assignment starts from the entry ``i`` that a part had in the round before. With the squared distance ``d`` from the
part to ``i`` and ``D`` between entries, all exact integers:

* the ball of ``i`` reaches as far as its farthest part; entries with ``D`` above twice that radius are no neighbours;
* parts with ``4 d`` below the least ``D`` of a neighbour are in the stable core and keep ``i`` without any other distance;
* the other parts lie in rings: only entries with ``D <= 4 d`` can be as near as ``i`` (triangle inequality), so the
  neighbours in order of distance are a prefix, and parts are compared with that prefix only. Rings are taken in
  classes of doubling width, so that many parts share a matrix product.

The test is inclusive, so ties go to the lower index as in a full search, and results equal a full search's.

Each round is one job: tasks assign their rows and write them (integers as packed bytes, codes, distances) to the shared
folder; a task's last row holds its sums, counts and radii by entry, which Spark adds up. Only codebooks (4 x 256
entries) reach the driver. A radius under the new entries is bounded by the one measured under the old plus the entry's
shift, so no job of its own measures it.

Defined cases: vectors that are null or hold a null, NaN or infinite component are dropped; shorter vectors are filled
with zeros up to the table's longest, and that up to a multiple of four; integers are held within +-2^24 (components
beyond +-16384), which keeps every distance exact; rows with equal or null ids are rows of their own, the starting ones
are taken in order of id, then vector, null ids last; with fewer than 256 rows the codebooks have as many entries; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.base import saved

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
LIMIT = 1 << 24
#: Rows that a task assigns at a time.
ROWS = 16384

_STATE = (
    "vec_id long, label int, q binary, codes binary, d array<long>, "
    "sums array<struct<part:int,entry:int,n:long,far:long,total:array<long>>>"
)
_SUM = pa.struct([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("far", pa.int64()), ("total", pa.list_(pa.int64()))])
_TYPES = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(_SUM)]
_NAMES = ["vec_id", "label", "q", "codes", "d", "sums"]


def kept(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows whose vector and all of its components are there and finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.filter(F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(False)))


def quantised(batch: pa.Array, width: int) -> np.ndarray:
    """Lists of finite numbers as rows of ``width`` integers."""
    lengths = batch.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    values = np.floor(batch.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
    out = np.zeros((len(batch), width), np.int64)
    starts = np.cumsum(lengths) - lengths
    at = np.arange(len(values)) - np.repeat(starts, lengths)
    out[np.repeat(np.arange(len(batch)), lengths), at] = np.clip(values, -LIMIT, LIMIT).astype(np.int64)
    return out


def packed(rows: np.ndarray) -> pa.Array:
    """Each row as little-endian bytes, in 16-bit integers where they suffice."""
    small = (np.abs(rows) < 1 << 15).all(axis=1)
    return pa.array([row.astype("<i2" if s else "<i4").tobytes() for row, s in zip(rows, small, strict=True)], pa.binary())


def unpacked(column: pa.Array, width: int) -> np.ndarray:
    out = np.empty((len(column), width), np.int64)
    for i, data in enumerate(column.to_pylist()):
        out[i] = np.frombuffer(data, "<i2" if len(data) == 2 * width else "<i4")
    return out


@dataclass
class Book:
    """The entries of one part position, and what the ball rules need to know of them."""

    entries: np.ndarray
    #: Bounds of the radii (not squared); none before the first assignment.
    radii: np.ndarray | None = None

    def __post_init__(self) -> None:
        apart = _squares(self.entries, self.entries)
        np.fill_diagonal(apart, -1)
        order = np.argsort(apart, axis=1, kind="stable")[:, 1:]
        self.rings: list[tuple[np.ndarray, np.ndarray]] = []
        for i, near in enumerate(order):
            distance = apart[i, near]
            if self.radii is not None:
                inside = distance <= (2.0 * self.radii[i]) ** 2 * (1 + 1e-9) + 1
                near, distance = near[inside], distance[inside]
            self.rings.append((near, distance))

    def assign(self, parts: np.ndarray, before: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry and its squared distance for each part; ``before`` has the entries of the last round."""
        entries = self.entries
        if before is None:
            return _nearest(parts, entries, np.arange(len(entries)))
        codes = before.astype(np.int64)
        own = parts - entries[codes]
        best = np.einsum("ij,ij->i", own, own)
        order = np.argsort(codes, kind="stable")
        bounds = np.searchsorted(codes[order], np.arange(len(entries) + 1))
        out = codes.copy()
        for i in range(len(entries)):
            members = order[bounds[i] : bounds[i + 1]]
            if not len(members):
                continue
            near, distance = self.rings[i]
            reach = np.searchsorted(distance, 4 * best[members], "right")
            # stable core: nothing within reach
            ring = np.where(reach > 0, np.ceil(np.log2(np.maximum(reach, 1))).astype(int), -1)
            for r in np.unique(ring[ring >= 0]):
                some = members[ring == r]
                choice = np.sort(np.append(near[: 1 << r], i))
                out[some], best[some] = _nearest(parts[some], entries[choice], choice)
        return out, best


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances between rows of integers, as a matrix product where every term is below 2^53."""
    big = float(max(np.abs(a).max(initial=0), np.abs(b).max(initial=0)))
    if 4 * max(1, a.shape[1]) * big * big < 2**53:
        x, y = a.astype(np.float64), b.astype(np.float64)
        apart = np.einsum("ij,ij->i", x, x)[:, None] - 2.0 * (x @ y.T) + np.einsum("ij,ij->i", y, y)[None, :]
        return apart.astype(np.int64)
    return np.stack([np.einsum("ij,ij->i", a - e, a - e) for e in b], axis=1)


def _nearest(x: np.ndarray, entries: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of the nearest entries; ``names`` ascend, so ties go to the lower index."""
    apart = _squares(x, entries)
    at = apart.argmin(axis=1)
    return names[at], apart[np.arange(len(x)), at]


def _first_books(vectors: DataFrame, vector: str, width: int, entries: int) -> list[Book]:
    """Parts of the rows with the smallest ids; at most ``entries`` rows reach the driver."""
    first = (
        vectors.select("vec_id", vector).orderBy(F.col("vec_id").asc_nulls_last(), F.col(vector)).limit(entries).collect()
    )
    rows = quantised(pa.array([r[1] for r in first], pa.list_(pa.float64())), width)
    return [Book(part) for part in np.split(rows, PARTS, axis=1)]


def _assigned(state: DataFrame, books: list[Book], width: int, vector: str | None, last: bool) -> DataFrame:
    """One round over ``state``: (vec_id, label, vector) rows at first, then rows of ``_STATE``; the last one needs no sums."""
    shared = state.sparkSession.sparkContext.broadcast(books)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        k, d = len(books[0].entries), width // PARTS
        n, far = np.zeros((PARTS, k), np.int64), np.zeros((PARTS, k), np.int64)
        total = np.zeros((PARTS, k, d), np.int64)
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            if vector:
                rows, before = quantised(batch.column(2), width), None
                q = None if last else packed(rows)
            else:
                q, rows = batch.column(2), unpacked(batch.column(2), width)
                before = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(-1, PARTS)
            codes, apart = np.empty((len(rows), PARTS), np.uint8), np.empty((len(rows), PARTS), np.int64)
            for p, book in enumerate(books):
                part = rows[:, p * d : (p + 1) * d]
                found, apart[:, p] = book.assign(part, None if before is None else before[:, p])
                codes[:, p] = found
                n[p] += np.bincount(found, minlength=k)
                np.maximum.at(far[p], found, apart[:, p])
                np.add.at(total[p], found, part)
            data = codes.tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.nulls(len(rows), _TYPES[2]) if last else q,
                    pa.array([data[i : i + PARTS] for i in range(0, len(data), PARTS)], pa.binary()),
                    pa.ListArray.from_arrays(np.arange(0, apart.size + 1, PARTS, dtype=np.int32), apart.ravel()),
                    pa.nulls(len(rows), _TYPES[-1]),
                ],
                names=_NAMES,
            )
        used = [
            {"part": p, "entry": e, "n": int(n[p, e]), "far": int(far[p, e]), "total": total[p, e].tolist()}
            for p, e in zip(*np.nonzero(n), strict=True)
        ]
        if used and not last:
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, t) for t in _TYPES[:-1]), pa.array([used], _TYPES[-1])], names=_NAMES)

    return state.mapInArrow(assign, _STATE)


def _moved(state: DataFrame, books: list[Book]) -> list[Book]:
    """New entries: the floor of each entry's mean; unused ones stay. At most ``PARTS`` x ``ENTRIES`` rows are collected."""
    rows = state.filter("sums is not null").select(F.explode("sums").alias("s")).select("s.*")
    width = books[0].entries.shape[1]
    sums = rows.groupBy("part", "entry").agg(
        F.sum("n").alias("n"), F.max("far").alias("far"), F.array(*[F.sum(F.col("total")[i]) for i in range(width)]).alias("total")
    )
    entries = [book.entries.copy() for book in books]
    radii = [np.zeros(len(book.entries)) for book in books]
    for r in sums.collect():
        new = np.array([t // r["n"] for t in r["total"]], np.int64)
        shift = new - books[r["part"]].entries[r["entry"]]
        radii[r["part"]][r["entry"]] = np.sqrt(float(r["far"])) + np.sqrt(float((shift * shift).sum()))
        entries[r["part"]][r["entry"]] = new
    return [Book(e, r) for e, r in zip(entries, radii, strict=True)]


def coded(
    vectors: DataFrame, vector: str = "embedding", entries: int = ENTRIES, rounds: int = ROUNDS
) -> tuple[DataFrame, list[np.ndarray]]:
    """``vec_id, label, codes`` (a byte for each part) and ``d`` (squared distances by part), and the codebooks."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has one byte for each part, so there are 1 to 256 entries")
    rows = kept(vectors.select("vec_id", F.col("label").cast("int").alias("label"), vector), vector)
    longest = rows.agg(F.max(F.size(vector))).first()[0] or 0
    width = max(PARTS, -(-longest // PARTS) * PARTS)
    books = _first_books(rows, vector, width, entries)
    state = rows
    if len(books[0].entries):
        for turn in range(rounds):
            state = saved(_assigned(state, books, width, None if turn else vector, False), "vectors")
            books = _moved(state, books)
            state = state.filter("sums is null")
        state = saved(_assigned(state, books, width, None if rounds else vector, True), "vectors")
    else:
        state = vectors.sparkSession.createDataFrame([], _STATE)
    return state.select("vec_id", "label", "codes", "d"), [book.entries for book in books]


def decoded(codes: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """``codes`` plus ``approx``: the vector that the code stands for."""
    table = [[[float(v) / SCALE for v in entry] for entry in book] for book in books]
    shared = codes.sparkSession.sparkContext.broadcast(table)

    @F.arrow_udf("array<double>")
    def back(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(
                [[x for book, c in zip(shared.value, code, strict=True) for x in book[c]] for code in batch.to_pylist()],
                pa.list_(pa.float64()),
            )

    return codes.withColumn("approx", back("codes"))


def report(vectors: DataFrame) -> DataFrame:
    rows, books = coded(vectors)
    digest = hashlib.sha256(",".join(str(int(v)) for book in books for entry in book for v in entry).encode()).hexdigest()
    error = sum((F.col("d")[i] for i in range(1, PARTS)), F.col("d")[0])
    # labels are counted before they meet the rows, so a label of a third of all rows is one row of this side
    keyed = rows.withColumn("error", error).withColumn("_l", F.coalesce(F.col("label").cast("string"), F.lit("")))
    by_label = keyed.groupBy("_l").agg(F.sum("error").alias("label_error"))
    return keyed.join(by_label, "_l").select(
        "vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256")
    )


def _sql() -> str:
    steps = [
        f"""v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS r, vec_id, label,
         list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
w AS (SELECT (max(len(q)) // {PARTS}) AS d FROM v),
x AS MATERIALIZED (
  SELECT r, p, q[p * d + 1 : p * d + d] AS q FROM v, w, (SELECT unnest(range({PARTS})) AS p)),
c0 AS MATERIALIZED (SELECT p, r AS e, q FROM x WHERE r < {ENTRIES})"""
    ]
    for k in range(ROUNDS + 1):
        steps.append(
            f"""a{k} AS MATERIALIZED (
  SELECT r, x.p, min({{'d': list_sum(list_transform(list_zip(x.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, 'e': c.e}}) AS m
  FROM x JOIN c{k} c ON x.p = c.p GROUP BY r, x.p)"""
        )
        if k < ROUNDS:
            steps.append(
                f"""s{k} AS (
  SELECT p, e, i, sum(t)::BIGINT AS t, count(*) AS n
  FROM (SELECT a{k}.p, m.e AS e, unnest(q) AS t, generate_subscripts(q, 1) AS i FROM a{k} JOIN x ON a{k}.r = x.r AND a{k}.p = x.p)
  GROUP BY p, e, i),
n{k} AS (SELECT p, e, list((t - ((t % n) + n) % n) // n ORDER BY i) AS q FROM s{k} GROUP BY p, e),
c{k + 1} AS MATERIALIZED (
  SELECT c.p, c.e, coalesce(n.q, c.q) AS q FROM c{k} c LEFT JOIN n{k} n ON c.p = n.p AND c.e = n.e)"""
            )
    body = ",\n".join(steps)
    return f"""
WITH {body},
f AS (
  SELECT r, string_agg(lower(printf('%02x', m.e)), '' ORDER BY p) AS code, sum(m.d)::BIGINT AS error FROM a{ROUNDS} GROUP BY r),
h AS (
  SELECT sha256(string_agg(array_to_string(q, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{ROUNDS})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM v JOIN f USING (r), h
"""


SQL = _sql()
