"""Language identification with bit-sliced Bloom filters over character n-grams.

For every language the frequent n-grams of its labelled texts go into a Bloom filter. The filters are stored bit-sliced:
slot ``p`` of one table holds one bit per language, so the AND of an n-gram's few slots is the set of all languages
that contain it. A text's n-grams vote with these sets; each language's count ``c`` of ``n`` votes is corrected for the
filter's false-positive rate ``f`` as ``(c - n f) / (1 - f)``, and the largest count decides.

Texts are lower-cased; every character that is no letter counts as a blank; n-grams lie within a word and the blanks
beside it. An n-gram is kept for a language if it makes up at least ``min_share`` of that language's n-grams, which
bounds a filter at ``1 / min_share`` entries. Training takes about ``sample_docs`` documents of each language (chosen
by a hash of the row, so the bound holds at any corpus size); prediction sees text alone.

Defined cases: null texts and texts without letters are ``und`` with score 0; so is everything when nothing was learned;
ties go to the language that sorts first; repeated rows are predicted alike; labels of null are never learned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.base import saved, small_batches

GRAMS = (3, 4)
SLOTS_LOG2 = 20
HASHES = 3
MIN_SHARE = 1e-5
SAMPLE_DOCS = 20_000
#: Texts are handled in pieces of about this many characters, so memory does not depend on the batch.
CHUNK = 1 << 18
#: Rows handed to the model at a time.
ROWS = 1000

_MIX = np.uint64(0x9E3779B97F4A7C15)
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Whether a code point is a letter."""
    if not _LETTERS:
        _LETTERS.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    return _LETTERS[0]


def _hashed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _pieces(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """(first index, texts) with about ``CHUNK`` characters each."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= CHUNK:
            yield first, texts[first : i + 1]
            first, size = i + 1, 0
    if first < len(texts):
        yield first, texts[first:]


def grams_of(texts: list[str], sizes: tuple[int, ...] = GRAMS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of ``texts`` and the index of the text each one is from, in order of size, then text."""
    texts = [t.lower() for t in texts]
    padded = " " + "  ".join(texts) + " "
    points = np.frombuffer(padded.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    lengths = np.fromiter((len(t) + 2 for t in texts), np.int64, len(texts))
    owner = np.repeat(np.arange(len(texts)), lengths)
    codes = np.where(letter, points, 32).astype(np.uint64)
    hashes, owners = [], []
    for n in sizes:
        if len(codes) < n:
            continue
        m = len(codes) - n + 1
        inside = letter[1 : 1 + m].copy()
        for i in range(2, n - 1):
            inside &= letter[i : i + m]
        if n < 3:
            inside = letter[:m]
        value = np.full(m, n, np.uint64)
        for i in range(n):
            value = value * _MIX + codes[i : i + m] + np.uint64(1)
        at = np.flatnonzero(inside)
        hashes.append(_hashed(value[at]))
        owners.append(owner[at])
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(hashes), np.concatenate(owners)


class Model:
    """Languages, the bit-sliced table (slots x 64-bit words of language bits) and false-positive rates."""

    def __init__(self, grams: dict[str, np.ndarray], slots_log2: int = SLOTS_LOG2, sizes: tuple[int, ...] = GRAMS):
        self.languages = sorted(grams)
        self.sizes = sizes
        self.slots_log2 = slots_log2
        self.table = np.zeros((-(-max(1, len(grams)) // 64), 1 << slots_log2), np.uint64)
        self.false = np.zeros(len(grams))
        for k, language in enumerate(self.languages):
            bit = np.uint64(1 << (k % 64))
            row = self.table[k // 64]
            for at in self._slots(grams[language]):
                row[at] |= bit
            self.false[k] = np.count_nonzero(row & bit) / len(row)
        self.false **= HASHES

    def _slots(self, hashes: np.ndarray) -> list[np.ndarray]:
        mask = np.uint64((1 << self.slots_log2) - 1)
        step = 64 // HASHES
        return [((hashes >> np.uint64(step * i)) & mask).astype(np.int64) for i in range(HASHES)]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [], []
        for _, piece in _pieces([t or "" for t in texts]):
            hashes, owner = grams_of(piece, self.sizes)
            total = np.bincount(owner, minlength=len(piece)).astype(float)
            counts = np.zeros((len(self.languages), len(piece)))
            slots = self._slots(hashes)
            for word, row in enumerate(self.table):
                members = row[slots[0]]
                for at in slots[1:]:
                    members = members & row[at]
                for k in range(64 * word, min(64 * word + 64, len(self.languages))):
                    has = (members >> np.uint64(k % 64)) & np.uint64(1)
                    counts[k] = np.bincount(owner, has, minlength=len(piece))
            fixed = np.maximum(0.0, counts - total * self.false[:, None]) / (1 - self.false[:, None])
            known = total > 0
            if not self.languages:
                known[:] = False
                fixed = np.zeros((1, len(piece)))
            best = fixed.argmax(axis=0)
            share = np.divide(fixed.max(axis=0), total, out=np.zeros(len(piece)), where=known)
            names += [self.languages[b] if ok else "und" for b, ok in zip(best, known, strict=True)]
            scores += np.minimum(share, 1.0).tolist()
        return names, scores


def learn(
    labelled: DataFrame, sample_docs: int = SAMPLE_DOCS, min_share: float = MIN_SHARE, sizes: tuple[int, ...] = GRAMS
) -> Model:
    """Fit on (text, lang) rows. Only ``1 / min_share`` n-gram hashes of a language reach the driver."""
    rows = labelled.select(F.col("text").alias("t"), F.col("lang").alias("l")).dropna()
    sizes_by = {r["l"]: r["count"] for r in rows.groupBy("l").count().collect()}
    if not sizes_by:
        return Model({}, sizes=sizes)
    spread = F.pmod(F.xxhash64("t", "l"), F.lit(1_000_000)) / F.lit(1_000_000.0)
    if max(sizes_by.values()) > sample_docs:
        share = F.create_map(*[F.lit(x) for l, n in sizes_by.items() for x in (l, min(1.0, sample_docs / n))])
        rows = rows.filter(spread < share[F.col("l")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            languages = np.array(batch.column(1).to_pylist(), object)
            texts = batch.column(0).to_pylist()
            for language in sorted(set(languages)):
                for _, piece in _pieces([t for t, l in zip(texts, languages, strict=True) if l == language]):
                    found, n = np.unique(grams_of(piece, sizes)[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([language] * len(found)), pa.array(found.view(np.int64)), pa.array(n)],
                        names=["l", "gram", "n"],
                    )

    counted = rows.mapInArrow(count, "l string, gram long, n long").groupBy("l", "gram").agg(F.sum("n").alias("n"))
    total = counted.groupBy("l").agg(F.sum("n").alias("total"))
    kept = counted.join(total, "l").filter(F.col("n") >= F.col("total") * F.lit(min_share))
    grams = {l: [] for l in sizes_by}
    with small_batches(labelled.sparkSession):
        for r in kept.select("l", "gram").toLocalIterator():
            grams[r["l"]].append(r["gram"])
    return Model({l: np.array(g, np.int64).view(np.uint64) for l, g in grams.items()}, sizes=sizes)


def _identified(docs: DataFrame, model: Model) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double")
    def predict(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            names: list[str] = []
            scores: list[float] = []
            for first in range(0, len(batch), ROWS):
                some = shared.value.predict(batch.slice(first, ROWS).to_pylist())
                names += some[0]
                scores += some[1]
            yield pa.StructArray.from_arrays(
                [pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["lang_pred", "score"]
            )

    return docs.withColumn("_language", predict("text"))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` plus ``lang_pred`` and ``score``: the share of a text's n-grams that its language explains.

    Columns of these names that ``docs`` has already are replaced.
    """
    found = _identified(docs.drop("lang_pred", "score"), model)
    return found.select("*", "_language.*").drop("_language")


def held_out(doc_id: str = "doc_id"):
    """Documents that are never learned from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def report(docs: DataFrame) -> DataFrame:
    model = learn(docs.filter(~held_out()))
    return identify(docs.select("doc_id", held_out().alias("held_out"), "text"), model).select(
        "doc_id", "held_out", "lang_pred", "score"
    )


#: Share of n-grams that some language must explain for a document to count as text in that language.
MIN_SCORE = 0.15


def keep_identified(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """Documents whose language is known; ``und`` and what no language explains goes. Columns unchanged.

    The result is written here and read again, as the size of a batch is fixed by the job that makes it: whole rows wait
    beside it for its answer.
    """
    model = learn(docs.filter(~held_out()))
    kept = _identified(docs, model).filter(
        (F.col("_language.lang_pred") != "und") & (F.col("_language.score") >= min_score)
    ).select(docs.columns)
    with small_batches(docs.sparkSession):
        return saved(kept, "language")
