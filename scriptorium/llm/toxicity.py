"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashes of its words, of neighbouring pairs, and of pairs with one or two words between
them (lower case, 30 bits). FTRL-proximal keeps per coordinate the sum ``n`` of squared gradients, which sets its own
learning rate, and ``z``; a weight is zero as long as ``|z|`` is below the L1 threshold. The weights that are not zero
are a few thousand numbers: they are broadcast, and a text's score is the logistic function of the sum over its features.

The learner is sequential, so it sees a bounded sample: of each label at most about ``SAMPLE_DOCS`` texts and
``SAMPLE_WORDS`` words, of texts up to ``LEARN_WORDS`` words, equal texts of one label once. Rows count by the inverse
of their label's share, so scores stay those of the whole. Ids are sampled before texts are touched, features are made in
tasks, and one task runs the epochs over them; its result does not depend on the order in which rows arrive. Scoring
covers every text whole: long ones in pieces that overlap by the longest skip-gram.

Defined cases: null texts and texts without words have no features and get the score of the bias alone; rows without a
label, or whose id is null, are not learned; an id with two different labels is learned under both; without any
labelled text all scores are 0.5; repeated rows are scored alike; extra columns do not matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.base import saved, text_or_empty, word_count

#: The learning sample, for each label.
SAMPLE_DOCS, SAMPLE_WORDS, LEARN_WORDS = 5_000, 2_500_000, 20_000
BITS = 30
#: Features in fewer sampled texts are not learned.
MIN_DOCS = 3
ALPHA, BETA, L1, L2 = 3.0, 1.0, 6.0, 1.0
EPOCHS = 4
THRESHOLD = 0.3
#: A text is split into words about so many characters at a time, and hashed so many words at a time.
PIECE, CHUNK = 1 << 20, 1 << 18
#: Distances of the two words of a feature; 0 is a word alone.
SPANS = (0, 1, 2, 3)

_WORD, _EDGE = re.compile(r"\w+"), re.compile(r"\W")
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


def _pieces(text: str) -> Iterator[str]:
    """``text`` cut between words into pieces of about ``PIECE`` characters."""
    at = 0
    while at < len(text):
        edge = _EDGE.search(text, at + PIECE) if at + PIECE < len(text) else None
        stop = edge.start() if edge else len(text)
        yield text[at:stop]
        at = stop


class Words:
    """64-bit hashes of words; those of short words are remembered, up to a fixed number."""

    KNOWN, LETTERS = 200_000, 40

    def __init__(self) -> None:
        self._known: dict[str, int] = {}

    def _new(self, word: str) -> int:
        value = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) | 1
        if len(word) <= self.LETTERS and len(self._known) < self.KNOWN:
            self._known[word] = value
        return value

    def hashed(self, words: list[str]) -> np.ndarray:
        known, new = self._known.get, self._new
        return np.fromiter((known(w) or new(w) for w in words), np.uint64, len(words))


def _features(ids: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, feature) of all words and pairs inside one owner."""
    owners, features = [], []
    for span in SPANS:
        first, last = ids[: max(0, len(ids) - span)], ids[span:]
        value = first * _MIX[span] + (last * _MIX[4] if span else np.uint64(0)) + np.uint64(span)
        value ^= value >> np.uint64(29)
        value *= _MIX[0]
        inside = owner[: len(first)] == owner[span:]
        owners.append(owner[span:][inside])
        features.append((value >> np.uint64(64 - BITS)).astype(np.uint32)[inside])
    return np.concatenate(owners), np.concatenate(features)


def features_of(texts: list[str | None], words: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(index of the text, feature), repeats included, a bounded number at a time."""
    ids, owners, held = [], [], 0

    def joined() -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate(ids), np.concatenate(owners)

    for i, text in enumerate(texts):
        for piece in _pieces(text or ""):
            found = words.hashed(_WORD.findall(piece.lower()))
            ids.append(found)
            owners.append(np.full(len(found), i))
            held += len(found)
            if held >= CHUNK:
                a, b = joined()
                yield _features(a, b)
                # the last words stay, for pairs that reach into the next piece
                ids, owners, held = [a[-max(SPANS) :]], [b[-max(SPANS) :]], 0
    if ids:
        yield _features(*joined())


@dataclass
class Model:
    """The weights that are not zero, in order of their feature, and the bias."""

    features: np.ndarray
    weights: np.ndarray
    bias: float = 0.0

    def __post_init__(self) -> None:
        self._maybe = np.zeros(1 << 20, bool)
        self._maybe[self.features >> np.uint32(BITS - 20)] = True

    def scores(self, texts: list[str | None], words: Words) -> np.ndarray:
        pairs = []
        for owner, feature in features_of(texts, words):
            # nearly all features end here
            some = np.flatnonzero(self._maybe[feature >> np.uint32(BITS - 20)])
            feature, owner = feature[some], owner[some]
            at = np.searchsorted(self.features, feature)
            at[at == len(self.features)] = 0
            hit = self.features[at] == feature if len(self.features) else np.zeros(len(feature), bool)
            pairs.append(owner[hit].astype(np.int64) << 32 | at[hit])
        total = np.full(len(texts), self.bias)
        if pairs:
            once = np.unique(np.concatenate(pairs))
            total += np.bincount(once >> 32, self.weights[once & 0xFFFFFFFF], minlength=len(texts))
        return 1.0 / (1.0 + np.exp(-np.clip(total, -50, 50)))


def fit(rows: list[tuple[np.ndarray, int, float]], epochs: int = EPOCHS, l1: float = L1, min_docs: int = MIN_DOCS) -> Model:
    """FTRL-proximal over (distinct features, label, importance); the order is that of a fixed shuffle."""
    if not rows:
        return Model(np.empty(0, np.uint32), np.empty(0))
    names, docs = np.unique(np.concatenate([r[0] for r in rows]), return_counts=True)
    names = names[docs >= min_docs]
    found = []
    for features, label, importance in rows:
        at = np.searchsorted(names, features)
        at[at == len(names)] = 0
        found.append((at[names[at] == features] if len(names) else at[:0], label, importance))
    z, n = np.zeros(len(names)), np.zeros(len(names))
    bias_z = bias_n = 0.0
    for epoch in range(epochs):
        for k in np.random.default_rng(epoch).permutation(len(found)):
            at, label, importance = found[k]
            z_at, n_at = z[at], n[at]
            root = np.sqrt(n_at)
            w = np.where(np.abs(z_at) <= l1, 0.0, (np.sign(z_at) * l1 - z_at) / ((BETA + root) / ALPHA + L2))
            bias = -bias_z / ((BETA + np.sqrt(bias_n)) / ALPHA)
            p = 1.0 / (1.0 + np.exp(-min(50.0, max(-50.0, w.sum() + bias))))
            g = importance * (p - label)
            z[at] = z_at + g - (np.sqrt(n_at + g * g) - root) / ALPHA * w
            n[at] = n_at + g * g
            bias_z += g - (np.sqrt(bias_n + g * g) - np.sqrt(bias_n)) / ALPHA * bias
            bias_n += g * g
    w = np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    some = np.flatnonzero(w)
    return Model(names[some], w[some], float(-bias_z / ((BETA + np.sqrt(bias_n)) / ALPHA)))


def _share(key: Column) -> Column:
    """A number in [0, 1) that depends on ``key`` alone."""
    return F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(1_000_000)) / F.lit(1_000_000.0)


def _sampled(rows: DataFrame, key: str, sizes: dict[int, float], bound: float) -> DataFrame:
    """Of each label the share of ``rows`` that keeps its size near ``bound``."""
    limit = F.lit(0.0)
    for label, size in sizes.items():
        limit = F.when(F.col("y") == label, F.lit(min(1.0, bound / max(size, 1.0)))).otherwise(limit)
    return rows.filter(_share(F.col(key)) < limit)


def learn(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_words: int = SAMPLE_WORDS) -> Model:
    """Fit on ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic); see the module for the sample."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("y")).filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1))
    known = known.distinct()
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    chosen = _sampled(known, "doc_id", counts, sample_docs)
    # about two times sample_docs ids, whatever the number of labels
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "y")
    short = texts.withColumn("words", word_count(text_or_empty())).filter(F.col("words").between(1, LEARN_WORDS))
    distinct = saved(short.withColumn("key", F.xxhash64("text")).dropDuplicates(["key", "y"]), "toxicity-texts")
    sizes = {r["y"]: (r["n"], r["words"]) for r in distinct.groupBy("y").agg(F.count("*").alias("n"), F.sum("words").alias("words")).collect()}
    sample = _sampled(distinct, "key", {y: max(n / sample_docs, w / sample_words) for y, (n, w) in sizes.items()}, 1.0)
    featured = saved(sample.select("key", "y", "text").mapInArrow(_featured, "key long, y int, features array<int>"), "toxicity-features")
    # each label weighs as much as it does among all labelled rows
    drawn = {r["y"]: r["count"] for r in featured.groupBy("y").count().collect()}
    every = sum(counts[y] for y in drawn) or 1
    weights = {y: counts[y] / every * sum(drawn.values()) / n for y, n in drawn.items()}

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            keys, ys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows += [(k, y, batch.column(2)[i].values.to_numpy().view(np.uint32)) for i, (k, y) in enumerate(zip(keys, ys, strict=True))]
        rows.sort(key=lambda r: r[:2])
        model = fit([(f, y, weights[y]) for _, y, f in rows])
        names = np.append(model.features.astype(np.int64), -1)
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(np.append(model.weights, model.bias))], names=["feature", "weight"])

    found = saved(featured.coalesce(1).mapInArrow(train, "feature long, weight double"), "toxicity-weights")
    rows = sorted((r["feature"], r["weight"]) for r in found.collect())
    bias = [w for f, w in rows if f < 0]
    rows = [r for r in rows if r[0] >= 0]
    return Model(np.array([f for f, _ in rows], np.uint32), np.array([w for _, w in rows]), bias[0] if bias else 0.0)


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = Words()
    for batch in batches:
        for i in range(0, batch.num_rows, 100):
            part = batch.slice(i, 100)
            found = [
                np.unique(np.concatenate([f for _, f in features_of([t], words)] or [np.empty(0, np.uint32)])).view(np.int32)
                for t in part.column(2).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(found, pa.list_(pa.int32()))], names=["key", "y", "features"]
            )


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` plus ``score``; a column of this name is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words = Words()
        for batch in batches:
            parts = [shared.value.scores(batch.slice(i, 1000).to_pylist(), words) for i in range(0, len(batch), 1000)]
            yield pa.array(np.concatenate(parts) if parts else np.empty(0))

    return docs.withColumn("score", score("text"))


def held_out(doc_id: str = "doc_id") -> Column:
    """Documents whose labels are never learned: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = learn(docs, labels.filter(~held_out()))
    return scored(docs.select("doc_id", held_out().alias("held_out"), "text"), model).select(
        "doc_id", "held_out", "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted")
    )
