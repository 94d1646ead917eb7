"""Token counts by longest-match word pieces, with a linear automaton that never builds a piece.

The vocabulary's pieces form two tries, one for pieces that start a word and one for pieces that continue it. Every
node has a failure link to where matching goes on when no child fits, and the number of pieces that are then complete.
A word is read one character at a time, each character moves the match or follows failure links, and the counts along
the way add up to the greedy (longest-match-first) number of pieces; no position is read twice.

A word that the vocabulary cannot cover counts as one unknown token. Words are runs of word characters and single
other characters that are no white space. A task keeps the counts of recent words (up to ``CACHE`` of them).

Vocabulary files: a list with one piece a line, ``##`` before pieces that continue a word; or a ``.model`` file of
sentencepiece, whose pieces with a leading mark start a word. The driver reads the file; tasks get the automaton, whose
size is bounded by the vocabulary.

Defined cases: null and empty texts have no words and no tokens; an empty vocabulary makes every word unknown; white
space alone gives no tokens; repeated rows are counted alike.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
CACHE = 500_000
_WORD = re.compile(r"\w+|[^\w\s]")
_COUNTS = StructType([StructField(n, LongType()) for n in ("n_words", "n_tokens", "n_unknown")])


def read_vocabulary(path: str) -> tuple[set[str], set[str]]:
    """Pieces that start a word and pieces that continue one."""
    if path.endswith(".model"):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        pieces, mark = [model.id_to_piece(i) for i in ids], "▁"
        return {p[1:] for p in pieces if p[:1] == mark and len(p) > 1}, {p for p in pieces if p[:1] != mark}
    with open(path, encoding="utf-8") as lines:
        pieces = [line.rstrip("\r\n") for line in lines]
    return {p for p in pieces if p and p[:2] != "##"}, {p[2:] for p in pieces if p[:2] == "##" and len(p) > 2}


class PieceCounter:
    """Trie nodes as integers: 0 starts a word, 1 continues it. ``fail`` is -1 where no match can go on."""

    def __init__(self, starts: Iterable[str], continues: Iterable[str]):
        self.child: list[dict[str, int]] = [{}, {}]
        ends = set()
        for root, pieces in ((0, starts), (1, continues)):
            for piece in pieces:
                at = root
                for c in piece:
                    if c not in self.child[at]:
                        self.child[at][c] = len(self.child)
                        self.child.append({})
                    at = self.child[at][c]
                ends.add(at)
        self.fail = [-1] * len(self.child)
        self.popped = [0] * len(self.child)
        level = [0, 1]
        while level:
            below = []
            for node in level:
                for c, to in self.child[node].items():
                    below.append(to)
                    if to in ends:
                        self.fail[to], self.popped[to] = 1, 1
                        continue
                    back, count = self.fail[node], self.popped[node]
                    while back >= 0 and c not in self.child[back]:
                        count += self.popped[back]
                        back = self.fail[back]
                    if back >= 0:
                        self.fail[to], self.popped[to] = self.child[back][c], count
            level = below

    def count(self, word: str) -> int:
        """Number of pieces of a word, or 0 if the vocabulary cannot cover it."""
        child, fail, popped = self.child, self.fail, self.popped
        node = total = 0
        for c in word:
            to = child[node].get(c)
            while to is None:
                total += popped[node]
                node = fail[node]
                if node < 0:
                    return 0
                to = child[node].get(c)
            node = to
        while node != 1:
            total += popped[node]
            node = fail[node]
            if node < 0:
                return 0
        return total


class _Known(dict):
    def __init__(self, counter: PieceCounter):
        self.counter = counter

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = n = self.counter.count(word)
        return n


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, lower: bool = False) -> DataFrame:
    """``docs`` plus ``n_words``, ``n_tokens`` (unknown words count as one) and ``n_unknown``, replacing such columns."""
    shared = docs.sparkSession.sparkContext.broadcast(PieceCounter(*read_vocabulary(vocabulary)))

    @F.arrow_udf(_COUNTS)
    def count(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = _Known(shared.value)
        for batch in texts:
            rows = []
            for text in batch:
                text = text.as_py() or ""
                pieces = list(map(known.__getitem__, _WORD.findall(text.lower() if lower else text)))
                unknown = pieces.count(0)
                rows.append((len(pieces), sum(pieces) + unknown, unknown))
            columns = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=_COUNTS.names)

    counted = docs.drop(*_COUNTS.names).withColumn("_pieces", count("text"))
    return counted.select("*", "_pieces.*").drop("_pieces")


def report(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    return count_tokens(docs.select("doc_id", "text"), vocabulary).drop("text")
