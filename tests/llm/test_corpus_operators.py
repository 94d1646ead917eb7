"""Fingerprints, personal data, Jaccard join, mixing and the pipeline, beside brute-force versions."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import odd
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from scriptorium.llm import components, decontaminate, groupjoin, langid, mixing, omh, pii

BLANKS = re.compile("[\x20\x09-\x0d]+")


# Order MinHash


def _signed(x: int) -> int:
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >= 1 << 63 else x


def _hash_longs(values: list[int], seed: int = 42) -> int:
    for v in values:
        seed = xxhash.xxh64_intdigest((v & ((1 << 64) - 1)).to_bytes(8, "little"), seed)
    return seed


def _fingerprint(text: str | None, k: int, l: int, m: int) -> list[int]:
    place = (1 << 22) - 1
    words = BLANKS.split(text or "")
    grams = []
    for i in range(max(len(words) - k + 1, 1)):
        h = 42
        for w in words[i : i + k]:
            h = xxhash.xxh64_intdigest(w.encode(), h)
        grams.append(_signed(h) & ~place)
    circle, seen = [], Counter()
    for i, g in enumerate(grams, 1):
        n = seen[g]
        seen[g] += 1
        if n:
            h = xxhash.xxh64_intdigest((g & ((1 << 64) - 1)).to_bytes(8, "little"), 42)
            g = _signed(xxhash.xxh64_intdigest(n.to_bytes(4, "little"), h)) & ~place
        circle.append(g | (i & place))
    circle.sort()
    out = []
    for j in range(m):
        mark = -(1 << 63) + j * ((1 << 64) // m)
        first = sum(x < mark for x in circle)
        chosen = [circle[(first + t) % len(circle)] for t in range(l)]
        tails = sorted(_signed(((x & place) << 41) | ((x & ((1 << 64) - 1)) >> 23)) for x in chosen)
        out.append(_hash_longs([t & ((1 << 41) - 1) for t in tails]) & 0xFFFF)
    return out


def test_order_minhash_equals_brute_force(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice("a b c d".split()) for _ in range(n)) for n in (0, 1, 3, 5, 6, 9, 40, 300)] + [None, "ä ö\tü\n" * 30]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("fp", omh.fingerprint(F.col("t"), 3, 2, 16)).collect()
    for r in rows:
        assert r["fp"] == _fingerprint(r["t"], 3, 2, 16), r["t"]


def test_order_minhash_sees_order(spark):
    rng = random.Random(4)
    parts = [" ".join(str(rng.random()) for _ in range(60)) for _ in range(6)]
    text, moved, edited = " ".join(parts), " ".join(parts[::-1]), " ".join([*parts[:5], "x y z"])
    row = spark.createDataFrame([(text, moved, edited)], "a string, b string, c string").select(
        *[omh.fingerprint(F.col(c)).alias(c) for c in "abc"]
    ).select(omh.likeness(F.col("a"), F.col("b")).alias("moved"), omh.likeness(F.col("a"), F.col("c")).alias("edited")).first()
    # the reversed parts share nearly all shingles but only half of the pairs keep their order
    assert row["edited"] > 0.55 > row["moved"]


def test_order_minhash_report(spark):
    docs = odd.documents(spark)
    rows = omh.report(docs).collect()
    assert len(rows) == len(odd.ROWS)
    ids = sorted({r[0] for r in odd.ROWS if r[0] is not None})
    texts = {r[0]: r[1] or "" for r in odd.ROWS if r[0] is not None}
    prints = defaultdict(set)
    for r in rows:
        if r["doc_id"] is None:
            assert r["near_next"] == 0
            continue
        text, after = texts[r["doc_id"]], texts[ids[(ids.index(r["doc_id"]) + 1) % len(ids)]]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and r["n_chars"] == len(text)
        prints[text].add(r["fingerprint"])
        prints[edited].add(r["edited_fingerprint"])
    assert all(len(p) == 1 for p in prints.values())
    assert omh.report(odd.no_documents(spark)).count() == 0
    one = omh.report(docs.filter("doc_id = 1")).collect()
    assert [r["near_next"] for r in one] == [1.0]


# Personal data

RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _valid(kind: str, found: str) -> bool:
    digits = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    if kind == "card":
        doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
        return 12 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in doubled) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def _base(text: str) -> str:
    spans = sorted(
        (m.start(), i, m.end(), kind)
        for i, (kind, rule) in enumerate(RULES.items())
        for m in re.finditer(rule, text)
        if _valid(kind, m[0])
    )
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in spans)


def test_base_spans_equal_the_rules(spark):
    rng = random.Random(8)
    alphabet = ["a", "Z", "0", "1", "25", "4111 1111 1111 1111", "+1 (555) 010-9999", ".", "@", "_", "-", " ", "+", "(", "é", "\U0001f600", "b@c.d", "10.0.0.1", "\n"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 25))) for _ in range(1500)]
    texts += ["a@b.c_d@e.f", "x@y.z.@q.r", "1.2.3.4.5.6.7.8", "0001.00255.0.256", "999.1.1.1.1", " ".join(["10.0.0.1"] * 1200), "7" * 50_000, "a" * 100_000 + "@"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").repartition(8).select("t", pii.as_text(pii.base_spans(F.col("t"))).alias("s")).collect()
    for r in rows:
        assert r["s"] == _base(r["t"]), r["t"][:200]


def test_contexts_discover_unseen_identifiers(spark):
    rng = random.Random(1)
    texts = [f"please write to contact mail: user{i}@host{i}.example.com today" for i in range(12)]
    texts += ["please write to contact mail: jane[at]corp-77 today, and again contact mail: jane[at]corp-77 now"]
    texts += [f"lot number {rng.randint(10**6, 10**7)} was sold for item code B{i}77-XY" for i in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in pii.report(docs).collect()}
    at = [texts[12].index("jane"), texts[12].rindex("jane")]
    assert rows[12]["spans"] == ",".join(f"email:{a}:{a + 15}" for a in at) and rows[12]["n_email"] == 0
    assert rows[0]["spans"] == _base(texts[0]) and rows[0]["n_email"] == 1
    assert all(not rows[i]["spans"] for i in range(13, len(texts)))
    clean = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert clean[12].count("[EMAIL]") == 2 and "jane" not in clean[12] and clean[20] == texts[20]
    assert clean[3] == "please write to contact mail: [EMAIL] today"


def test_contexts_discover_identifiers_of_any_form(spark):
    long = "jane[at]" + "corp" * 40 + ".example"
    found = ["jane[at]corp.example", "j[at]c", "k-7", long]
    texts = [f"please write to contact mail: user{i}@host{i}.example.com today" for i in range(30)]
    texts += [f"please write to contact mail: {value} today, and again {value} now" for value in found]
    texts += [f"please call the w{c}x office or read the notes of room {c} today" for c in "abcdefghijklm"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in pii.report(docs).collect()}
    clean = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    for i, value in enumerate(found, 30):
        at = [texts[i].index(value), texts[i].rindex(value)]
        assert rows[i]["spans"] == ",".join(f"email:{a}:{a + len(value)}" for a in at) and rows[i]["n_discovered"] == 2
        assert clean[i] == "please write to contact mail: [EMAIL] today, and again [EMAIL] now"
    assert all(not rows[i]["spans"] and clean[i] == texts[i] for i in range(34, len(texts)))
    assert all(rows[i]["spans"] == _base(texts[i]) for i in range(30))


def test_short_and_long_seeds_teach_contexts(spark):
    seeds = [f"{c}@b.c" for c in "abc"] + [c * 130 + "@host.example.com" for c in "abc"]
    texts = [f"the box of {seed} here" for seed in seeds] + ["the box of jane[at]corp-77 here"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in pii.report(docs).collect()}
    assert rows[6]["spans"] == "email:11:26" and rows[6]["n_discovered"] == 1


def test_rows_of_one_id_get_their_own_spans(spark):
    texts = [f"please write to contact mail: user{i}@host{i}.example.com today" for i in range(12)]
    rows = list(enumerate(texts))
    other = "these are quite other words, long enough to reach any place of that text"
    for i in (50, None):
        rows += [(i, "please write to contact mail: jane[at]corp-77 today"), (i, other)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    clean = Counter((r["doc_id"], r["text"]) for r in pii.redact(docs).filter("doc_id is null or doc_id = 50").collect())
    assert clean == Counter((i, t) for i in (50, None) for t in ("please write to contact mail: [EMAIL] today", other))


def test_personal_data_of_odd_rows(spark):
    docs = odd.documents(spark).withColumn("text", F.concat("text", F.lit(" +1 (555) 010-9999, 4111 1111 1111 1111")))
    rows = pii.report(docs).collect()
    assert len(rows) == len(odd.ROWS)
    for r in rows:
        assert (r["n_phone"], r["n_email"]) == ((0, 0) if r["doc_id"] == 3 else (1, 0))
    kept = pii.redact(docs)
    assert kept.columns == docs.columns and kept.count() == len(odd.ROWS)
    assert pii.report(odd.no_documents(spark)).count() == pii.redact(odd.no_documents(spark)).count() == 0


def test_redaction_of_overlapping_spans(spark):
    spans = [(2, 0, 5, "email"), (4, 2, 8, "card"), (6, 1, 7, "ip"), (9, 3, 10, "phone")]
    frame = spark.createDataFrame([("0123456789ab", spans)], "t string, s array<struct<start:int,order:int,end:int,kind:string>>")
    assert frame.select(pii.redacted(F.col("t"), F.col("s"))).first()[0] == "01[EMAIL]8[PHONE]ab"


# Jaccard join


def _shingles(text: str | None) -> frozenset:
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in BLANKS.split(folded) if w]
    return frozenset(tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))) if words else frozenset()


def _components(texts: dict) -> dict:
    sets = {i: _shingles(t) for i, t in texts.items()}
    low = {i: i for i in texts}

    def top(i):
        while low[i] != i:
            i = low[i]
        return i

    ids = sorted(texts)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
                a, b = sorted((top(x), top(y)))
                low[b] = a
    return {i: top(i) for i in texts}


def _near_copies(seed: int) -> dict:
    rng = random.Random(seed)
    texts, shared = {}, [f"s{i}" for i in range(40)]
    for g in range(12):
        base = [f"w{rng.randint(0, 10**6)}" for _ in range(rng.choice([2, 4, 6, 30, 80, 160]))]
        for _ in range(rng.randint(1, 7)):
            words = list(base)
            for _ in range(rng.randint(0, 4)):
                at = rng.randrange(len(words))
                words[at : at + rng.randint(0, 2)] = [f"n{rng.randint(0, 10**6)}"] * rng.randint(0, 2)
                words = words or ["x"]
            if rng.random() < 0.4:
                words += shared
            texts[len(texts)] = " ".join(words)
    return texts | {900: None, 901: "", 902: " \n"}


def test_join_equals_brute_force(spark):
    for seed in (1, 2):
        texts = _near_copies(seed)
        docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
        expected = _components(texts)
        assert len(set(expected.values())) < len(texts) - 15
        got = {r["doc_id"]: r for r in groupjoin.report(docs).collect()}
        assert {i: r["component_id"] for i, r in got.items()} == expected
        assert all(r["n_shingles"] == len(_shingles(texts[i])) for i, r in got.items())
    assert {r["doc_id"] for r in groupjoin.keep_one(docs).collect()} == set(expected.values())


def test_join_puts_frequent_shingles_last(spark):
    rng = random.Random(6)
    hot = " ".join(f"h{i}" for i in range(30))
    texts = {i: hot + " " + " ".join(f"w{rng.randint(0, 10**7)}" for _ in range(40)) for i in range(120)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(2)
    found, times = groupjoin.frequent_shingles(docs, 5, 32, 1000)
    assert len(found) == 26 and min(times) == 120 and (found[1:] > found[:-1]).all()
    rows = groupjoin.saved(groupjoin.profiles(docs), "test")
    frequent = set(found.view(groupjoin.np.int64).tolist())
    assert not any(frequent & set(r["prefix"]) for r in rows.collect())
    assert {r["component_id"] for r in groupjoin.report(docs).collect()} == set(texts)


def test_join_of_odd_rows(spark):
    docs = odd.documents(spark)
    rows = groupjoin.report(docs).collect()
    assert Counter((r["doc_id"], r["component_id"]) for r in rows)[(2, 1)] == 2 and len(rows) == len(odd.ROWS)
    assert all(r["component_id"] == r["doc_id"] for r in rows if r["doc_id"] in (3, 4, 5))
    kept = groupjoin.keep_one(docs)
    assert kept.columns == docs.columns and kept.filter("doc_id = 2").count() == 0 and kept.filter("doc_id = 1").count() == 1
    assert groupjoin.report(odd.no_documents(spark)).count() == 0


def test_one_row_of_each_component_stays_for_null_and_repeated_ids(spark):
    text = lambda w: " ".join(f"{w}{i}" for i in range(30))
    rows = [(None, text("a")), (None, text("b")), (None, text("b")), (5, text("c")), (5, text("d")), (5, text("d")), (6, text("e")), (None, text("e") + " x")]
    rows += [(7, text("f")), (7, text("g") + " x"), (3, text("g")), (8, ""), (8, " "), (None, None), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    expected = [(None, text("a")), (None, text("b")), (5, text("c")), (5, text("d")), (6, text("e")), (7, text("f")), (3, text("g")), *rows[-4:]]
    kept = groupjoin.keep_one(docs)
    assert kept.columns == docs.columns and Counter(map(tuple, kept.collect())) == Counter(expected)


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(35)] + [(i, i + 1) for i in range(100, 130)]
    low = {i: i for e in edges for i in e}
    for _ in range(200):
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
    found = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    own = {a for a, b in edges if a != b} | {b for a, b in edges if a != b}
    assert {r["node"]: r["component"] for r in found} == {i: low[i] for i in own} and len(found) == len(own)


# Mixing


def _targets(sizes: dict, weights: dict, most: int = 3) -> dict:
    open_, target, left = set(sizes), {}, float(sum(sizes.values()))
    while open_:
        total = sum(weights[s] for s in open_)
        over = {s for s in open_ if left * weights[s] / total > most * sizes[s]}
        if not over:
            return target | {s: left * weights[s] / total for s in open_}
        for s in over:
            target[s] = float(most * sizes[s])
            left -= target[s]
        open_ -= over
    return target


def test_mixing_equals_iterated_capping(spark):
    rng = random.Random(3)
    docs = []
    for s in ["a", "b", "c", "dd", "é", None]:
        docs += [(len(docs) + i, "w " * rng.randint(0, 60), s) for i in range(rng.choice([1, 5, 80, 400]))]
    docs = [(i, t, s) for i, (_, t, s) in enumerate(docs)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string")
    rows = mixing.report(frame).collect()
    assert sorted(rows) == sorted(mixing.report(frame.repartition(5)).collect())
    sizes, largest = Counter(), Counter()
    for _, t, s in docs:
        sizes[s] += len(t.split())
        largest[s] = max(largest[s], len(t.split()))
    order = sorted((s for s in sizes if s is not None)) + [None]
    targets = _targets(sizes, {s: i % 3 + 1 for i, s in enumerate(order)})
    taken, source = Counter(), {i: s for i, _, s in docs}
    for r in rows:
        s = source[r["doc_id"]]
        assert abs(r["target"] - targets[s]) < 1e-6 * max(1, targets[s]) and r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= largest[s] / 2 + 1e-6, s
    by = {r["doc_id"]: r for r in rows}
    for r in mixing.mix(frame).collect():
        assert r["repeats"] * by[r["doc_id"]]["size"] == by[r["doc_id"]]["taken"] and r["repeats"] > 0


def test_mixing_of_odd_rows(spark):
    rows = mixing.report(odd.documents(spark)).collect()
    assert len(rows) == len(odd.ROWS) and all(r["size"] == r["taken"] == 0 for r in rows if r["doc_id"] in (3, 4, 5))
    assert mixing.report(odd.no_documents(spark)).count() == 0
    assert mixing.mix(odd.documents(spark)).columns == [*odd.documents(spark).columns, "repeats"]


# Pipeline


def test_pipeline_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = [(str(r["item_id"]), decontaminate.words_of(r["text"].encode())) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    frame = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.learn(frame.filter(~langid.held_out()))
    predicted = dict(zip(docs, zip(*model.predict([d["text"] for d in docs.values()]), strict=True), strict=True))
    kept = {i: d["text"] for i, d in docs.items() if predicted[i][0] != "und" and predicted[i][1] >= langid.MIN_SCORE}
    groups = _components(kept)
    kept = {i: t for i, t in kept.items() if groups[i] == i}
    clean = {}
    for i, t in kept.items():
        spans = [m.span() for m in re.finditer(r"[0-9A-Za-z\u0080-\U0010ffff]+", t)]
        words = decontaminate.words_of(t.encode())
        hit = set()
        for _, w in items:
            n = min(10, len(w))
            for a in range(len(w) - n + 1):
                for b in range(len(words) - n + 1):
                    if words[b] == w[a] and words[b : b + n] == w[a : a + n]:
                        hit |= set(range(b, b + n))
        if len(hit) > len(words) * decontaminate.MAX_COVERAGE:
            continue
        runs, out, at = [], [], 0
        for j in sorted(hit):
            if runs and runs[-1][1] == j:
                runs[-1][1] = j + 1
            else:
                runs.append([j, j + 1])
        for a, b in runs:
            out.append(t[at : spans[a][0]])
            at = spans[b - 1][1]
        clean[i] = "".join(out) + t[at:]
    sources = {i: docs[i]["source"] for i in clean}
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert set(got) <= set(clean) and 0 < len(got)
    marks = r"\[(?:EMAIL|IP|CARD|PHONE)\]"
    for i, r in got.items():
        spans = [s.split(":") for s in _base(clean[i]).split(",") if s]
        assert not _base(r["text"]) and (spans or r["text"] == clean[i])
        assert re.split(marks, r["text"])[0] == clean[i][: int(spans[0][1])] if spans else True
        assert (r["lang"], r["source"], r["n_chars"]) == (docs[i]["lang"], sources[i], docs[i]["n_chars"])
    steps = frame
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, steps = steps, groupjoin.saved(stage(spark, steps, sf), name)
        assert steps.columns == before.columns
    assert {r["doc_id"] for r in steps.collect()} == set(clean)
    sizes = Counter()
    for r in steps.collect():
        sizes[r["source"]] += len(r["text"].split())
    targets = _targets(sizes, {s: k % 3 + 1 for k, s in enumerate(sorted(sizes))})
    taken = Counter()
    for r in got.values():
        taken[r["source"]] += r["repeats"] * len(r["text"].split())
        assert 1 <= r["repeats"] <= 3
    longest = max(len(r["text"].split()) for r in steps.collect())
    assert all(abs(taken[s] - targets[s]) <= longest / 2 + 1 for s in sizes)
    assert corpus_pipeline.ORACLE_SQL is None


def test_pipeline_stages_take_odd_and_no_rows(spark, tmp_path):
    spark.createDataFrame([(1, "one two three")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for docs in (odd.documents(spark), odd.no_documents(spark)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = groupjoin.saved(stage(spark, docs, str(tmp_path)), "test")
            assert docs.columns == odd.documents(spark).columns
        assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() <= docs.count()


def test_personal_data_tests_a_token_by_the_word_before_it_once(spark, monkeypatch):
    monkeypatch.setattr(pii, "saved", lambda frame, label: frame)
    docs = spark.createDataFrame([(1, "call Anna at noon")], "doc_id long, text string")
    confident = spark.createDataFrame([("1|call",)], "pattern string")
    found = pii._in_slots(docs, confident)
    assert [tuple(r) for r in found.select("pattern", "value").collect()] == [("1|call", "anna")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.splitlines() if "Filter" in line and "xxhash64" in line]
    assert filters and all(line.count("translate(") == 1 for line in filters)


def test_personal_data_tokens_by_single_characters_are_those_by_ranges(spark):
    unit = (
        pii.PATTERNS["phone"]
        + r"|(?<!\S)[0-9](?:[\x20-]?[0-9]){11,18}+(?![0-9A-Za-z])"
        + r"|(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
    )
    token = r"[^\s0-9@+]++(?!\S)|" + unit + r"|(?:[^\s+]++|(?!" + pii.PATTERNS["phone"] + r")\+)++"
    every = "".join(f"{a}{chr(c)}{b} " for c in range(0x3000) for a, b in (("", ""), ("x", "y"), ("7", "+")))
    text = every + "a+b +1 (234) 567-8901 4111 1111 1111 1111 4111 1111 1111 1111x ++ +x a@b.c "
    docs = spark.createDataFrame([(text,)], "t string")
    for old, new in ((unit, pii._UNIT), (token, pii._TOKEN)):
        assert docs.filter(F.regexp_extract_all("t", F.lit(old), F.lit(0)) == F.regexp_extract_all("t", F.lit(new), F.lit(0))).count() == 1
    words = docs.select(F.explode(F.split("t", " ")).alias("w"))
    old = F.regexp_replace(F.regexp_replace("w", "^[^A-Za-z0-9+]++", ""), "(?<![^A-Za-z0-9])[^A-Za-z0-9]++$", "")
    assert words.filter(~pii._core(F.col("w")).eqNullSafe(old)).count() == 0


def test_join_hands_python_small_batches(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "bytes"])

    rows = spark.range(0, 6000, 1, 1).select(F.repeat(F.lit("x"), F.when(F.col("id") < 4000, 1).otherwise(20_000)).alias("t"))
    before = {name: spark.conf.get(name) for name in groupjoin._BATCHES}
    seen = groupjoin.saved(rows.mapInArrow(sizes, "n long, bytes long"), "sizes").collect()
    assert sum(r["n"] for r in seen) == 6000
    assert max(r["n"] for r in seen) <= 1000 and max(r["bytes"] for r in seen) < 12 * 1024**2
    assert {name: spark.conf.get(name) for name in before} == before


def test_large_component_meets_small_ones_in_few_rows(spark):
    """Entries that cannot fit and shingles that follow a common one add no rows; the pairs that fit are all found."""
    schema = "shingle long, component long, group long, n long, place long, known long, end struct<times: long, last: long>, possible long, previous long"

    def entries(groups, places):
        found = []
        for group, (component, first) in groups.items():
            for i in range(5):
                found.append((100 + i, component, group, 100, first + i, i, (0, 200), 99, 99 + i if i else places.get(group)))
        return spark.createDataFrame(found, schema)

    large = {g: (1, 0 if g < 3 else 30) for g in range(40)}
    small = {g: (g, 0) for g in range(1000, 1030)}
    rows = entries(large | small, {})
    one, two = groupjoin._sides(rows, 80)
    held = groupjoin._held(one, two, 80)
    # the three that fit, and of the small ones each with those after it
    assert held.count() == 3 * 30 + 30 * 29 // 2
    pairs = {(r["g1"], r["g2"]) for r in groupjoin._meeting(rows, 80).collect()}
    assert pairs == {(a, b) for a in [0, 1, 2, *small] for b in small if a < b}
    # a shingle before theirs that only some have does not hide a pair
    apart = entries({0: (1, 0), 1000: (2, 0), 1001: (3, 0)}, {0: 7, 1000: 8})
    assert {(r["g1"], r["g2"]) for r in groupjoin._meeting(apart, 80).collect()} == {(0, 1000), (0, 1001), (1000, 1001)}


def test_join_of_copies_around_a_common_passage_equals_brute_force(spark):
    rng = random.Random(11)
    passage = [f"p{i}" for i in range(60)]
    texts = {}
    for i in range(90):
        words, own = list(passage), rng.choice([1, 3, 6, 9, 14])
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(60)] = f"x{rng.randint(0, 5)}"
        at = rng.choice([0, 60])
        words[at:at] = [f"o{rng.randint(0, 10**6)}" for _ in range(own)]
        texts[i] = " ".join(words)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    expected = _components(texts)
    assert 3 < len(set(expected.values())) < 88
    assert {r["doc_id"]: r["component_id"] for r in groupjoin.report(docs).collect()} == expected
