"""Toxicity, fill-in-the-middle and vector codes against brute force, round trips and held-out labels."""

from __future__ import annotations

import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from odd import documents, no_documents

from scriptorium.llm import middle, queries, toxicity, vectors

SF = "/root/testdata/sf0.01"


# -- fill in the middle ---------------------------------------------------------------------------


def cut_by_hand(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    low, high = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    parts = ["".join(units[:low]), "".join(units[low:high]), "".join(units[high:])]
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 20:
        return len(units), "spm", len(parts[0]), len(parts[1]), f"<S>{parts[2]}<P>{parts[0]}<M>{parts[1]}"
    return len(units), "psm", len(parts[0]), len(parts[1]), f"<P>{parts[0]}<S>{parts[2]}<M>{parts[1]}"


TRICKY = ["a", "<P", "<S<M", "x<P>y", "a<b>c <S", "é́ \U0001f600z", "\x1f\x1e sep", "a\r\n\tb\x00c", ">P<S", "ab" * 5000, " " * 300]


def test_middle_equals_brute_force(spark):
    rows = [(i, text) for i, text in enumerate(TRICKY * 8)] + [(None, "no id"), (7, None), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2).union(documents(spark).select("doc_id", "text"))
    found = middle.restored(middle.transformed(docs)).collect()
    assert len(found) == len(rows) + documents(spark).count()
    for r in found:
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == cut_by_hand(r["doc_id"], r["text"])
        assert r["restored"] == (r["text"] or "")
    assert {r["form"] for r in found} == {"plain", "psm", "spm"}


def test_middle_in_slices_and_without_rows(spark, monkeypatch):
    monkeypatch.setattr(middle, "SLICE_BYTES", 3)
    import pyarrow as pa

    texts = pa.array(["abcd ef", "", "x", "long text " * 20, "\x1f"])
    sizes = list(middle._slices(texts))
    assert [a for a, _ in sizes] == [0, 1, 3, 4] and sum(n for _, n in sizes) == 5
    none = middle.restored(middle.transformed(no_documents(spark)))
    assert none.collect() == [] and none.columns[-1] == "restored"
    # a column of docs that is named like a result is replaced, the others stay
    one = middle.transformed(documents(spark)).filter("doc_id = 6").first()
    assert one["n"] > 1000 and one["key"] == "k" and one["score"] == 0.5


# -- vector codes ---------------------------------------------------------------------------------


def full_search(x, entries):
    apart = ((x[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
    return apart.argmin(axis=1), apart.min(axis=1)


def codes_by_hand(rows, entries=256, rounds=4):
    """(codes, squared distances, books) by full search; ``rows`` in order of id."""
    parts = np.split(rows, 4, axis=1)
    codes, apart, books = [], [], []
    for part in parts:
        book = part[:entries].copy()
        for _ in range(rounds):
            found, _ = full_search(part, book)
            for e in np.unique(found):
                book[e] = part[found == e].sum(axis=0) // (found == e).sum()
        found, d = full_search(part, book)
        codes.append(found), apart.append(d), books.append(book)
    return np.stack(codes, 1), np.stack(apart, 1), books


@pytest.mark.parametrize("spread", [2, 40, 9000, 1 << 24])
def test_balls_give_the_entries_of_a_full_search(spread):
    rng = np.random.default_rng(spread)
    for k in (1, 2, 30, 256):
        part = rng.integers(-spread, spread, (700, 5))
        book = vectors.Book(part[:k].copy())
        found, apart = book.assign(part, None)
        for _ in range(3):
            radii, entries = np.zeros(k), book.entries.copy()
            for e in np.unique(found):
                entries[e] = part[found == e].sum(axis=0) // (found == e).sum()
                shift = entries[e] - book.entries[e]
                radii[e] = math.sqrt(apart[found == e].max()) + math.sqrt((shift**2).sum())
            book = vectors.Book(entries, radii)
            found, apart = book.assign(part, found.astype(np.uint8))
            wanted, distance = full_search(part, entries)
            assert (found == wanted).all() and (apart == distance).all()


def test_far_entries_are_never_compared(monkeypatch):
    centres = np.arange(0, 256_000, 1000).reshape(-1, 1) * np.ones((1, 4), int)
    part = np.repeat(centres, 5, axis=0) + np.tile([[0], [1], [-3], [200], [490]], (256, 4))
    book = vectors.Book(centres, np.full(256, 1000.0))
    compared = []
    monkeypatch.setattr(vectors, "_nearest", lambda x, e, n, f=vectors._nearest: compared.append(len(x) * len(e)) or f(x, e, n))
    found, _ = book.assign(part, np.repeat(np.arange(256), 5).astype(np.uint8))
    assert (found == np.repeat(np.arange(256), 5)).all() and sum(compared) == 0


def test_vector_codes_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i) * 3, rng.normal(0, 0.2, 10).astype(np.float32).tolist(), int(i) % 4) for i in range(400)]
    rows += [(5, rows[9][1], None), (5, rows[9][1], None), (None, rows[3][1], 1), (None, [0.5] * 3, 2), (7, [], 1)]
    rows += [(8, [20000.0, -1e30] + [0.0] * 8, 1), (9, [-33.0] * 10, 2)]
    bad = [(1, None, 1), (2, [0.1, None], 1), (3, [float("nan")] * 10, 1), (4, [float("inf")], 1), (4, [float("-inf")], 1)]
    schema = "vec_id long, embedding array<float>, label int, d string, codes int, error string, q int"
    frame = spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows + bad], schema).repartition(3)
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    limit = 1 << 24
    ints = np.array([[int(max(-limit, min(limit, math.floor(1024 * np.float64(np.float32(x)))))) for x in r[1]] + [0] * (12 - len(r[1])) for r in order])
    codes, apart, books = codes_by_hand(ints)
    label = {}
    for r, d in zip(order, apart.sum(axis=1), strict=True):
        label[r[2]] = label.get(r[2], 0) + int(d)
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    wanted = sorted(
        (str(r[0]), bytes(c.astype(np.uint8)).hex(), int(d.sum()), label[r[2]], digest) for r, c, d in zip(order, codes, apart, strict=True)
    )
    assert sorted((str(r[0]), *r[1:]) for r in vectors.report(frame).collect()) == wanted
    few, table = vectors.coded(frame, entries=7, rounds=2)
    codes, apart, books = codes_by_hand(ints, 7, 2)
    assert sorted(bytes(r["codes"]) for r in few.collect()) == sorted(bytes(c.astype(np.uint8)) for c in codes)
    assert all((a == b).all() for a, b in zip(table, books, strict=True))
    near = vectors.decoded(few, table).first()
    assert near["approx"] == [v / 1024 for book, c in zip(books, near["codes"], strict=True) for v in book[c].tolist()]


def test_vector_codes_without_rows(spark):
    none = vectors.report(spark.createDataFrame([(1, None, 1)], "vec_id long, embedding array<float>, label int"))
    assert none.collect() == [] and none.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


# -- toxicity -------------------------------------------------------------------------------------


def features_by_hand(text):
    words = re.findall(r"\w+", (text or "").lower())
    hasher, out = toxicity.Words(), set()
    for span in toxicity.SPANS:
        for i in range(len(words) - span):
            pair = hasher.hashed([words[i], words[i + span]])
            owner = np.zeros(2, int)
            kinds = list(zip(*toxicity._features(pair, owner), strict=True))
            # a pair alone has its two words, then one feature of the distance 1
            if span == 0:
                out.add(int(kinds[0][1]))
            else:
                first, last = pair
                with np.errstate(over="ignore"):
                    value = first * toxicity._MIX[span] + last * toxicity._MIX[4] + np.uint64(span)
                    value = (value ^ (value >> np.uint64(29))) * toxicity._MIX[0]
                out.add(int(value >> np.uint64(64 - toxicity.BITS)))
    return out


def test_features_do_not_depend_on_pieces(monkeypatch):
    texts = ["one", None, "", "Zwei drei", "a b c d e f g h " * 40, "é-ü " * 9, "x" * 500 + " y"]
    for piece, chunk in ((1 << 20, 1 << 18), (7, 5), (1, 1)):
        monkeypatch.setattr(toxicity, "PIECE", piece)
        monkeypatch.setattr(toxicity, "CHUNK", chunk)
        found = {i: set() for i in range(len(texts))}
        for owner, feature in toxicity.features_of(texts, toxicity.Words()):
            for o, f in zip(owner.tolist(), feature.tolist(), strict=True):
                found[o].add(f)
        assert list(found.values()) == [features_by_hand(t) for t in texts]


def test_scores_are_sums_over_distinct_features():
    text = "bad day, bad bad day"
    names = sorted(features_by_hand(text))
    weights = np.linspace(-1, 2, len(names))
    model = toxicity.Model(np.array(names, np.uint32), weights, -0.5)
    odd = [text, None, "", text * 3, "nothing of it"]
    wanted = []
    for t in odd:
        hit = features_by_hand(t)
        wanted.append(1 / (1 + math.exp(0.5 - sum(w for n, w in zip(names, weights, strict=True) if n in hit))))
    assert model.scores(odd, toxicity.Words()) == pytest.approx(wanted)


def test_learner_equals_the_textbook_loop():
    """The same recursion, coordinate by coordinate."""
    rng = np.random.default_rng(5)
    rows = [(np.unique(rng.integers(0, 12, 5)).astype(np.uint32), int(rng.integers(0, 2)), float(rng.integers(1, 3))) for _ in range(60)]
    model = toxicity.fit(rows, epochs=2, l1=0.5, min_docs=1)
    z, n = dict.fromkeys([*range(12), "b"], 0.0), dict.fromkeys([*range(12), "b"], 0.0)

    def weight(i):
        l1, l2 = (0.0, 0.0) if i == "b" else (0.5, toxicity.L2)
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + l2)

    for epoch in range(2):
        for k in np.random.default_rng(epoch).permutation(len(rows)):
            names, y, importance = rows[k]
            used = [*names.tolist(), "b"]
            p = 1 / (1 + math.exp(-sum(weight(i) for i in used)))
            g = importance * (p - y)
            for i in used:
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / toxicity.ALPHA
                z[i], n[i] = z[i] + g - sigma * weight(i), n[i] + g * g
    wanted = {i: weight(i) for i in range(12) if weight(i)}
    assert dict(zip(model.features.tolist(), model.weights.tolist(), strict=True)) == pytest.approx(wanted)
    assert model.bias == pytest.approx(weight("b"))


def test_toxicity_on_held_out_labels(spark):
    found = {r["doc_id"]: r for r in queries.op11_toxicity(spark, "/root/testdata/sf0.1").collect()}
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()
    held = [r for r in labels if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert all(found[r["doc_id"]]["held_out"] for r in held) and len(found) == 10_000
    caught = [found[r["doc_id"]]["predicted"] for r in held if r["toxic"] == 1]
    wrong = [found[r["doc_id"]]["predicted"] for r in held if r["toxic"] == 0]
    # the English words are learned from this many labels, those of the rarer languages only in part
    assert sum(caught) / len(caught) >= 0.8 and sum(wrong) / len(wrong) <= 0.01


def test_toxicity_of_odd_rows(spark):
    plant = [(100 + i, ("awful thing here" if i % 3 == 0 else "fine thing here") + f" w{i}") for i in range(300)]
    docs = documents(spark).select("doc_id", "text", "score", "key").union(
        spark.createDataFrame([(*r, 0.0, "k") for r in plant], "doc_id long, text string, score double, key string")
    )
    labels = spark.createDataFrame(
        [(r[0], int(r[0] % 3 == 1), "x") for r in plant] + [(None, 1, "x"), (6, 0, "x"), (6, 1, "x"), (3, 1, "x"), (1, None, "x"), (102, 7, "x")],
        "doc_id long, toxic int, text string",
    )
    found = toxicity.report(docs, labels).collect()
    assert len(found) == docs.count()
    by_id = {r["doc_id"]: r for r in found}
    assert by_id[103]["predicted"] == 1 and by_id[104]["predicted"] == 0 and 0 <= by_id[3]["score"] <= 1
    again = toxicity.report(docs.repartition(5), labels.repartition(3)).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))
    none = toxicity.report(docs, labels.filter("false")).collect()
    assert {r["score"] for r in none} == {0.5}
    assert toxicity.report(no_documents(spark), labels).collect() == []


def test_copies_do_not_crowd_the_sample(spark):
    copies = [(i, "the same words again") for i in range(400)] + [(1000 + i, f"vile text {i} x{i % 7}") for i in range(60)]
    docs = spark.createDataFrame(copies, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i >= 1000)) for i, _ in copies], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels, sample_docs=100)
    scores = model.scores(["vile text", "the same words again"], toxicity.Words())
    assert scores[0] > 0.3 > scores[1]
